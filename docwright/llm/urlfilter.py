"""URL filters as a temporal list join.

Dated list events (add, remove) of a pattern become validity intervals; each capture is joined to
the entries that were active on the day it was fetched. Patterns are hosts (a pattern also covers
hosts below it) or a host with a path prefix of whole segments. A capture's own keys, every host
suffix and every path prefix, make this an equi-join with a range check; of the active entries the
longest pattern decides, and "allow" wins a tie. A list of up to BROADCAST_ENTRIES intervals is
broadcast, so keys that no entry has never leave their task. A longer one is shuffled, and the rows
of a key that many captures have are dealt to several tasks.

Defined cases: a url is anything with an authority after "//", with or without a scheme; user, port, letter case and
dots at the host's end don't count; an IP address, in brackets or not, is one key without suffixes; a null url or one
without a host has no keys and the verdict "keep"; a null day matches nothing; events of one pattern on one day act in the
order remove, add; repeated captures are all returned; an empty table gives an empty result;
columns beyond id, url and day are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from docwright.session import saved, spread_join, table

BROADCAST_ENTRIES = 500_000
FOREVER = 2**31 - 1
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+([^?#]*)"
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def keys(url: Column) -> Column:
    """Every host suffix, and the host with every prefix of whole path segments."""
    name = host(url)
    labels = F.when(name.rlike(ADDRESS), F.array(name)).otherwise(F.split(name, r"\."))
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda s: s != "")
    prefixes = F.transform(parts, lambda _, i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(events: DataFrame) -> DataFrame:
    """(list, pattern, since, until) from events (list, pattern, day, action): active from an add to the next event."""
    in_time = W.partitionBy("list", "pattern").orderBy("day", F.when(F.col("action") == "remove", 0).otherwise(1))
    spans = events.withColumn("until", F.coalesce(F.lead("day").over(in_time), F.lit(FOREVER)))
    return spans.filter("action = 'add' AND day < until").select("list", "pattern", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, events: DataFrame, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """(page_id, host, day, n_active, pattern, verdict) for captures (page_id, url, day)."""
    entries = saved(intervals(events), "intervals")
    rows = captures.select("page_id", "url", "day")
    keyed = rows.select("*", F.explode(keys(F.col("url"))).alias("pattern"))
    met = keyed.join(F.broadcast(entries), "pattern") if entries.count() <= most else spread_join(saved(keyed, "keys"), entries, "pattern")
    hits = met.filter((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")))
    rank = F.struct(F.length("pattern").alias("n"), F.when(F.col("list") == "allow", 1).otherwise(0).alias("allow"), "pattern", "list")
    # Each capture also comes once without an entry: captures that meet none stay, and repeated ones are counted.
    every = hits.select("page_id", "url", "day", rank.alias("entry")).unionByName(rows, allowMissingColumns=True)
    best = every.groupBy("page_id", "url", "day").agg(F.count("entry").alias("hits"), F.count_if(F.col("entry").isNull()).alias("times"), F.max("entry").alias("best"))
    verdict = F.when(F.col("best.list") == "block", "drop").otherwise("keep")
    out = best.withColumn("turn", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.select("page_id", host(F.col("url")).alias("host"), "day", F.floor(F.col("hits") / F.col("times")).alias("n_active"), F.col("best.pattern").alias("pattern"), verdict.alias("verdict"))


def planned_events(pages: DataFrame) -> DataFrame:
    """A dated list for the test pages, by rule: from the md5 of each host and of its last two labels."""
    hosts = pages.select(host(F.col("url")).alias("h")).filter("h <> ''").distinct()
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("int")
    hosts = hosts.withColumn("x", number(F.col("h")))
    event = lambda kind, pattern, day, action: F.struct(F.lit(kind).alias("list"), pattern.alias("pattern"), day.cast("int").alias("day"), F.lit(action).alias("action"))
    x, h = F.col("x"), F.col("h")
    own = F.when(x % 4 < 2, F.array(event("block", h, x % 300, "add"), event("block", h, x % 300 + 90, "remove"))).otherwise(F.array())
    allow = F.when(x % 4 == 1, F.array(event("allow", F.concat(h, F.lit("/en")), x % 200, "add"))).otherwise(F.array())
    by_host = hosts.select(F.explode(F.concat(own, allow)).alias("e")).select("e.*")
    domains = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("h")).filter("h <> ''").distinct().withColumn("x", number(F.col("h")))
    wide = domains.filter(x % 3 == 0).select(F.explode(F.array(event("block", h, F.lit(100), "add"), event("block", h, F.lit(250), "remove"))).alias("e")).select("e.*")
    return by_host.unionByName(wide)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages.withColumn("day", (F.col("page_id") * 37 % 365).cast("int")), planned_events(pages))


OP5_SQL = r"""
WITH caps AS (
  SELECT page_id, url, (page_id * 37 % 365)::INT AS day,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]+)', 1)), '\.+$', '') AS host,
    [s FOR s IN string_split(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+([^?#]*)', 1), '/') IF s <> ''] AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host AS h, ('0x' || substr(md5(host), 1, 7))::INT AS x FROM caps WHERE host <> ''),
domains AS (
  SELECT DISTINCT d AS h, ('0x' || substr(md5(d), 1, 7))::INT AS x
  FROM (SELECT regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS d FROM hosts) WHERE d <> ''),
dated AS (
  SELECT 'block' AS list, h AS pattern, unnest([x % 300, x % 300 + 90]) AS day, unnest(['add', 'remove']) AS action FROM hosts WHERE x % 4 < 2
  UNION ALL SELECT 'allow', h || '/en', x % 200, 'add' FROM hosts WHERE x % 4 = 1
  UNION ALL SELECT 'block', h, unnest([100, 250]), unnest(['add', 'remove']) FROM domains WHERE x % 3 = 0),
spans AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY list, pattern ORDER BY day, action = 'add'), 2147483647) AS next FROM dated),
events AS (SELECT list, pattern, day AS since, next AS until FROM spans WHERE action = 'add' AND day < next),
keyed AS (
  SELECT *, unnest(CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_distinct(list_concat(
    CASE WHEN regexp_matches(host, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') THEN [host]
      ELSE [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)] END,
    [host || '/' || array_to_string(parts[:i], '/') FOR i IN range(1, len(parts) + 1)])) END) AS key
  FROM caps),
met AS (
  SELECT k.page_id, count(*) AS n_active, max(ROW(length(e.pattern), (e.list = 'allow')::INT, e.pattern, e.list)) AS best
  FROM keyed k JOIN events e ON k.key = e.pattern AND e.since <= k.day AND k.day < e.until GROUP BY k.page_id)
SELECT c.page_id, c.host, c.day, coalesce(m.n_active, 0) AS n_active, struct_extract(m.best, 3) AS pattern,
  CASE WHEN struct_extract(m.best, 4) = 'block' THEN 'drop' ELSE 'keep' END AS verdict
FROM caps c LEFT JOIN met m ON c.page_id = m.page_id
"""

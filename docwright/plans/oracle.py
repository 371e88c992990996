"""DuckDB SQL for docwright.plans.queries."""

from docwright.operators import classifier as C
from docwright.operators.extraction import PATTERNS


def kinds_sql(rows: str, key: str) -> str:
    """The classifier's rules over rows (key, text, path)."""
    quoted = lambda p: p.replace("'", "''")
    score = lambda kind: " + ".join(
        [f"CASE WHEN regexp_matches(\"{s}\", '{quoted(p)}') THEN {w} ELSE 0 END" for k, s, w, p in C.RULES if k == kind]
        + [f"CASE WHEN len(regexp_extract_all(\"{s}\", '{quoted(p)}')) > {m} THEN {w} ELSE 0 END" for k, s, p, m, w in C.COUNTED if k == kind])
    scores = ", ".join(f"{score(k)} AS s{n}" for n, k in enumerate(C.KINDS))
    names = [f"s{n}" for n in range(len(C.KINDS))]
    first = " ".join(f"WHEN s{n} = score THEN '{k}'" for n, k in enumerate(C.KINDS))
    return f"""WITH t AS (SELECT {key}, lower(coalesce(text, '')) AS "text", lower(coalesce(text, ''))[:{C.OPENING}] AS "start", lower(coalesce(path, '')) AS "path" FROM ({rows})),
x AS (SELECT *, regexp_replace(string_split("path", '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem FROM t), v AS (SELECT {key}, {scores} FROM x), m AS (SELECT *, greatest({", ".join(names)}) AS score FROM v)
SELECT {key}, CASE WHEN score < {C.LEAST} THEN '{C.OTHERWISE}' {first} END AS kind, score, round(CASE WHEN score < {C.LEAST} THEN 0.2::DOUBLE ELSE least(score / {C.FULL}, 1.0) END, 6) AS confidence FROM m"""

TERMS = r"[t FOR t IN regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+') IF t <> '']"
_BM25 = f"""
tok AS (SELECT doc_id, {TERMS.format("concat_ws(' ', source, text, lang)")} AS w FROM documents),
stat AS (SELECT count(*) AS n, avg(len(w)) AS adl FROM tok),
post AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS.format('text')})) AS term FROM benchmark),
bm AS (
  SELECT q.query_id, tf.doc_id AS id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / adl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), stat GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bm)"""
_FUSE = """
lists AS (SELECT query_id, id, rank, 'a' AS side FROM a UNION ALL SELECT query_id, id, rank, 'b' FROM b),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) FILTER (WHERE side = 'a') AS ra, min(rank) FILTER (WHERE side = 'b') AS rb FROM lists GROUP BY ALL),
f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, id)::INT AS rank FROM fused)"""

SQL = {
    "bm25_search": f"WITH {_BM25} SELECT query_id, id AS doc_id, score, rank FROM bmr WHERE rank <= 10",
    "hybrid_search": f"""WITH {_BM25}, b AS (SELECT * FROM bmr WHERE rank <= 50),
w AS (SELECT doc_id AS id, unnest({TERMS.format('text')}) AS t FROM documents), qw AS (SELECT item_id AS id, unnest({TERMS.format('text')}) AS t FROM benchmark),
h AS (SELECT t, ('0x' || substr(md5(t), 1, 7))::INT % 64 AS p, 1 - 2 * (('0x' || substr(md5(t), 8, 1))::INT % 2) AS s FROM (SELECT t FROM w UNION SELECT t FROM qw)),
dv AS (SELECT id, p, sum(s)::DOUBLE AS v FROM w JOIN h USING (t) GROUP BY id, p), qv AS (SELECT id, p, sum(s)::DOUBLE AS v FROM qw JOIN h USING (t) GROUP BY id, p),
dn AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id HAVING n > 0), qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM qv GROUP BY id HAVING n > 0),
dots AS (SELECT q.id AS query_id, x.id, sum(q.v * x.v) AS dot FROM qv q JOIN dv x USING (p) GROUP BY ALL),
far AS (SELECT query_id, dn.id, round(sqrt(greatest(0, 2 - 2 * coalesce(dot, 0) / (qn.n * dn.n))), 6) AS distance FROM (SELECT qn.id AS query_id, qn.n FROM qn) qn CROSS JOIN dn LEFT JOIN dots USING (query_id, id)),
a AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM far) WHERE rank <= 50), {_FUSE},
k AS (SELECT query_id, id, f.score AS rrf_score, rank, list_distinct({TERMS.format('m.text')}) AS asked, {TERMS.format('x.text[:512]')} AS held FROM f JOIN benchmark m ON item_id = query_id JOIN documents x ON x.doc_id = id WHERE rank <= 25),
o AS (SELECT query_id, id, rrf_score, rank AS was, round(len(list_intersect(asked, held)) / greatest(1, len(asked)), 6) AS score FROM k),
r AS (SELECT query_id, id AS doc_id, score, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was, id)::INT AS rank FROM o)
SELECT * FROM r WHERE rank <= 15 AND (score >= 0.15 OR rank <= 3)""",
    "vector_search": """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, round(1 / (1 + distance), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d) SELECT * FROM r WHERE rank <= 10""",
    "rank_fusion": f"""WITH e AS (SELECT event_type AS query_id, user_id AS id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id)::INT AS rank FROM e) WHERE rank <= 20),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id)::INT AS rank FROM e) WHERE rank <= 20), {_FUSE}
SELECT * FROM f WHERE rank <= 10""",
    "refusals": f"""WITH {_BM25}, best AS (SELECT query_id, max(score) AS best FROM bmr WHERE rank <= 10 GROUP BY query_id)
SELECT item_id AS query_id, coalesce(best >= 0.1 AND best < 40, true) AS refuse FROM benchmark LEFT JOIN best ON item_id = query_id""",
    "substring_search": "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'eren')",
    "summary_first": """WITH g AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS nth FROM documents)
SELECT source AS "group", doc_id, nth, (n_chars * c)::DOUBLE AS score FROM r JOIN g USING (source) WHERE nth <= 3""",
    "fixed_windows": """WITH s AS (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, length(coalesce(text, '')), 800)) AS s FROM documents)
SELECT doc_id, (s // 800)::INT AS number, substr(sha256(doc_id || ':chunk:' || (s // 800)), 1, 16) AS chunk_id, s::INT AS char_start, (s + 1000)::INT AS char_end, md5(substr(text, s + 1, 1000)) AS chunk_md5 FROM s""",
    "paragraph_offsets": r"""WITH l AS (SELECT doc_id, [y FOR y IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(coalesce(text, ''), chr(10))] IF y <> ''] AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS paragraph FROM l)
SELECT doc_id, paragraph::INT AS paragraph, length(t) AS n, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM u""",
    "collection_stats": "SELECT coalesce(lang, 'unknown') AS kind, count(*) AS n, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS files FROM documents GROUP BY 1",
    "metrics_rollup": """WITH e AS (SELECT *, user_id % 100 AS tokens FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type <> 'error')
SELECT event_type, user_id % 5 AS query_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(avg(tokens), 6) AS avg_tokens, round(avg(tokens / (value + 1)), 6) AS avg_rate
FROM e GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""",
    "dashboard": """SELECT count(*) AS n, count(DISTINCT event_type) AS models, round(avg(value), 6) AS avg_value, count(*) FILTER (WHERE event_type = 'error') AS errors
FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
    "latency_percentiles": """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, v[least(floor(len(v) * 0.5)::INT + 1, len(v))] AS p50, v[least(floor(len(v) * 0.95::DOUBLE)::INT + 1, len(v))] AS p95, v[least(floor(len(v) * 0.99::DOUBLE)::INT + 1, len(v))] AS p99 FROM l""",
    "category_breakdown": """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM c)
SELECT CASE WHEN k <= 8 THEN source ELSE 'Other' END AS source, sum(n)::BIGINT AS n FROM r GROUP BY 1""",
    "entity_mentions": "WITH m AS (" + " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS name, {c}::DOUBLE AS confidence FROM documents" for k, p, c in PATTERNS)
    + ") SELECT doc_id, kind, name, confidence, count(*) AS mentions FROM m GROUP BY ALL",
    "timeline": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders)
SELECT *, coalesce(lag(year(day)) OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) <> year(day), true) AS new_year FROM o""",
    "citation_check": """SELECT l_orderkey, count(*) AS n_citations, count(*) FILTER (WHERE p.p_partkey IS NULL) AS n_missing, count(*) FILTER (WHERE p.p_partkey IS NULL) = 0 AS verified
FROM lineitem LEFT JOIN part p ON l_partkey = p.p_partkey AND p.p_size >= 10 AND l_linenumber <= 4 GROUP BY 1""",
    "recall": """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, round(count(DISTINCT l_partkey) FILTER (WHERE k <= 3) / count(DISTINCT l_partkey), 6) AS recall FROM r GROUP BY 1""",
    "batch_plan": """WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents)
SELECT source, ((nth - 1) // 8)::INT AS batch, min(nth)::INT AS "first", max(nth)::INT AS "last" FROM r WHERE (nth - 1) // 8 < 8 GROUP BY 1, 2""",
    "upserted": """WITH new AS (SELECT doc_id + 5 AS doc_id, 'xx' AS lang, n_chars FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""",
    "deleted": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "recent_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "conversation_text": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1",
    "prompt_budget": """WITH c AS (SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM conversations),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c) SELECT * FROM s WHERE used <= 200""",
    "text_labels": r"""SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') || '_' || substr(md5(p_name), 1, 8) AS safe,
substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), 1, 20) AS slug,
CASE WHEN length(p_type) > 10 THEN substr(p_type, 1, 10) || '…' ELSE p_type END AS short, 'doc_' || substr(md5(p_name), 1, 8) AS key FROM part""",
    "page_text": "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages",
    "merged_edges": """WITH m AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS new FROM supplier)
SELECT coalesce(new, l_suppkey) AS source, count(*) AS edges, count(DISTINCT l_partkey) AS targets FROM lineitem LEFT JOIN m ON l_suppkey = s_suppkey GROUP BY 1""",
    "visible_edges": "SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation WHERE n_nationkey <> 3 AND n_regionkey < 3",
    "document_kinds": kinds_sql("SELECT doc_id, text, concat_ws('/', source, lang) AS path FROM documents", "doc_id"),
}


def chunks_sql(size: int, overlap: int, deepest: int = 100, slack: int = 200) -> str:
    """The adaptive chunker as a recursive query over documents."""
    ends = ", ".join(f"CASE WHEN instr(reverse(w), reverse({s})) > 0 THEN {size - slack} + length(w) - instr(reverse(w), reverse({s})) + 1 END" for s in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
c AS (SELECT doc_id, -1 AS depth, 0::BIGINT AS start, NULL::BIGINT AS stop, 'first' AS mode, 0::BIGINT AS next FROM d
UNION ALL SELECT doc_id, depth, start, stop, mode, CASE mode WHEN 'cut' THEN greatest(start, stop - {overlap}) WHEN 'window' THEN CASE WHEN stop < n THEN greatest(start + 1, stop - {overlap}) END
  WHEN 'slice' THEN CASE WHEN start + {size - overlap} < n THEN start + {size - overlap} END END AS next FROM (
  SELECT *, CASE mode WHEN 'cut' THEN start + cut WHEN 'rest' THEN n ELSE least(start + {size}, n) END AS stop FROM (
    SELECT *, CASE WHEN before IN ('window', 'slice') THEN before WHEN depth > {deepest} THEN 'slice' WHEN n - start <= {size} THEN 'rest' WHEN cut > 0 THEN 'cut' ELSE 'window' END AS mode FROM (
      SELECT *, coalesce({ends}) AS cut FROM (
        SELECT c.doc_id, c.depth + 1 AS depth, c.next AS start, c.mode AS before, d.n, substr(d.text, c.next + 1 + {size - slack}, {2 * slack}) AS w FROM c JOIN d USING (doc_id) WHERE c.next IS NOT NULL))))),
k AS (SELECT doc_id, mode, start, CASE WHEN mode = 'cut' THEN regexp_replace(substr(text, start + 1, stop - start), '\\s+$', '') ELSE substr(text, start + 1, stop - start) END AS chunk FROM c JOIN d USING (doc_id) WHERE depth >= 0)
SELECT doc_id, doc_id || '_' || substr(md5(start || ':' || chunk), 1, 12) AS chunk_id, start::INT AS char_start, (start + length(chunk))::INT AS char_end FROM k WHERE mode IN ('cut', 'rest') OR regexp_matches(chunk, '\\S')"""


SQL["adaptive_chunks"] = chunks_sql(4096, 2048)

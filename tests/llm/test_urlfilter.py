import random
import re

import pytest
from conftest_llm import SMALL, rows_of, rows_of_sql, view

from docwright.llm import urlfilter as U


def test_matches_sql(spark):
    assert rows_of(U.op5_url_filter(spark, SMALL)) == rows_of_sql(view(SMALL, "pages"), U.OP5_SQL)


def test_intervals_and_precedence(spark):
    events = spark.createDataFrame([("block", "bad.org", 10, "add"), ("block", "bad.org", 20, "remove"), ("block", "bad.org", 20, "add"), ("block", "bad.org", 30, "remove"),
                                    ("allow", "bad.org/ok", 12, "add"), ("block", "a.b.c", 0, "add"), ("allow", "a.b.c", 5, "add")], "list string, pattern string, day int, action string")
    caps = [(1, "http://bad.org/x", 9), (2, "http://sub.bad.org:80/x", 10), (3, "http://bad.org/ok/page?q", 15), (4, "http://bad.org/okay", 15), (5, "http://bad.org", 20), (6, "http://bad.org", 30),
            (7, None, 15), (8, "no url", 15), (9, "http://bad.org", None), (10, "https://u@A.B.C/", 6), (11, "http://notbad.org/", 15), (2, "http://sub.bad.org:80/x", 10)]
    got = U.judge(spark.createDataFrame(caps, "page_id long, url string, day int"), events).collect()
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert len(got) == len(caps)
    assert verdict == {1: "keep", 2: "drop", 3: "keep", 4: "drop", 5: "drop", 6: "keep", 7: "keep", 8: "keep", 9: "keep", 10: "keep", 11: "keep"}


@pytest.mark.parametrize("most", [10**6, 0])
def test_matches_brute_force(spark, most):
    """Spellings of hosts, and a list that is broadcast or shuffled."""
    r = random.Random(1)
    hosts = ["bad.org", "a.bad.org", "b.a.bad.org", "good.net", "10.0.0.1", "1.10.0.0.1", "[2001:db8::1]", "org"]
    events = [(r.choice(["block", "allow"]), r.choice(hosts) + r.choice(["", "", "/x", "/x/y"]), r.randrange(40), r.choice(["add", "add", "remove"])) for _ in range(60)]
    shapes = ["http://{}/", "https://u:p@{}:8080/x/y?q", "//{}/x", "HTTP://{}./xy", "ftp://{}..:21//x//y#f", "http://{}"]
    caps = [(i, shapes[i % 6].format(r.choice(hosts).upper() if i % 5 == 0 else r.choice(hosts)), r.randrange(45)) for i in range(400)]
    caps += [(1000, "http://bad.org", 5)] * 3 + [(1001, None, 3), (1002, "bad.org/x", 3), (1003, "http:///x", 3), (None, "http://bad.org", 9)]

    def active(day):
        held = []
        for kind, pattern in {e[:2] for e in events}:
            last = [e for e in sorted((e for e in events if e[:2] == (kind, pattern) and e[2] <= day), key=lambda e: (e[2], e[3] == "add"))][-1:]
            held += [(kind, pattern)] if last and last[0][3] == "add" else []
        return held

    want = []
    for i, url, day in caps:
        m = re.match(r"(?:\w+:)?//(?:[^/@]*@)?(\[[^]]*\]|[^/:?#\[\]]+)[^/?#]*([^?#]*)", url or "")
        host = m[1].lower().rstrip(".") if m else ""
        path = [p for p in m[2].split("/") if p] if m else []
        met = []
        for kind, pattern in active(day) if host else []:
            h, *rest = pattern.split("/")
            whole = re.fullmatch(r"\[.*\]|\d+(\.\d+){3}", host)
            under = host == h or (not rest and not whole and host.endswith("." + h))
            if under and path[: len(rest)] == rest:
                met.append((len(pattern), kind == "allow", pattern, kind))
        best = max(met) if met else None
        want.append((i, host, day, len(met), best and best[2], "drop" if best and best[3] == "block" else "keep"))
    got = U.judge(spark.createDataFrame(caps, "page_id long, url string, day int"), spark.createDataFrame(events, "list string, pattern string, day int, action string"), most)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert U.op5_url_filter(spark, str(tmp_path)).collect() == []

import hashlib
import re

from conftest_llm import SMALL, documents

from docwright.llm import fingerprint as M


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0]))
    out = {}
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest())
    return out


def test_edits_match_brute_force(spark):
    got = M.op7_fingerprints(spark, SMALL).collect()
    want = brute(documents(SMALL))
    assert len(got) == len(want) and all(want[r["doc_id"]] == (r["n_chars"], r["edited_sha256"]) for r in got)
    assert sum(r["near_edited"] for r in got) / len(got) > 0.3 > 0.2 > sum(r["near_next"] for r in got) / len(got)
    texts = {r[0]: r[1] for r in documents(SMALL)}
    by = {}
    for r in got:
        by.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def test_odd_rows(spark, odd_dir):
    got = M.op7_fingerprints(spark, odd_dir).collect()
    assert len(got) == len(documents(odd_dir)) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    rows = {r[0]: r[1] for r in documents(odd_dir)}
    assert all(r["n_chars"] == len(rows[r["doc_id"]] or "") for r in got if r["doc_id"] is not None)
    none = [r for r in got if r["n_chars"] == 0 and r["doc_id"] in (0, 3)]
    assert len({r["fingerprint"] for r in none}) == 1


def test_empty_and_single(spark, empty_dir, tmp_path):
    assert M.op7_fingerprints(spark, empty_dir).collect() == []
    spark.createDataFrame([(5, "abcd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = M.op7_fingerprints(spark, str(tmp_path)).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0


def tree(text):
    """(root, sections, nodes, leaves by paragraph) and where sections end, in plain Python; leaves are the pieces themselves."""
    paras = text.split("\n")
    nodes = [hashlib.md5(x.encode()).hexdigest() for x in paras]
    sections, run, section_of = [], "", []
    for i, n in enumerate(nodes):
        run += n
        section_of.append(len(sections))
        if n[-1] in "08" or i == len(nodes) - 1:
            sections.append(hashlib.md5(run.encode()).hexdigest())
            run = ""
    return hashlib.sha256("".join(sections).encode()).hexdigest()[:32], sections, nodes, [re.findall(M.LEAF, x) for x in paras], section_of


def like(a, b):
    (ra, _, na, la, _), (rb, _, nb, lb, _) = tree(a), tree(b)
    if ra == rb:
        return 1.0
    da, db = dict(zip(na, la)), dict(zip(nb, lb))
    shared = sum(len(da[n]) for n in da if n in db)
    x, y = ({p for n in d if n not in e for p in d[n]} for d, e in ((da, db), (db, da)))
    return 2 * (shared + len(x & y)) / max(1, 2 * shared + len(x) + len(y))


def test_columns_match_plain_trees(spark):
    rows = sorted(documents(SMALL))
    got = {r["doc_id"]: r for r in M.op7_fingerprints(spark, SMALL).collect()}
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited, r = t[: len(t) - h] + nxt[:h], got[i]
        for text, f in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            root, sections, nodes, leaves, _ = tree(text)
            parts = f.split("/")
            assert parts[:2] == [root, ".".join(sections)]
            assert [(p.split(":")[0], len(p.split(":")[1]) // 8) for p in parts[2].split(".")] == [(n, len(x)) for n, x in zip(nodes, leaves)]
        assert abs(r["near_edited"] - like(t, edited)) < 1e-9 and abs(r["near_next"] - like(t, nxt)) < 1e-9
        a, b = tree(t), tree(edited)
        assert r["n_differing_sections"] == sum(x not in a[1] for x in b[1]) and r["n_differing_paragraphs"] == sum(x not in a[2] for x in b[2])


def test_edits_are_located(spark):
    lines = [f"line {i} says something." for i in range(200)]
    a = "\n".join(lines)
    made = {"insert": [*lines[:50], "a new line.", *lines[50:]], "change": [*lines[:70], "other.", *lines[71:]], "first": ["top.", *lines], "delete": [*lines[:90], *lines[91:]], "same": lines}
    df = spark.createDataFrame([(k, a, "\n".join(v)) for k, v in made.items()], "k string, a string, b string")
    df = M.with_fingerprint(M.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = {r["k"]: (r["s"], r["p"]) for r in M.with_differences(df, "fa", "fb", "s", "p").collect()}
    assert {k: p for k, (_, p) in got.items()} == {"insert": [50], "change": [70], "first": [0], "delete": [], "same": []}
    for k, v in made.items():
        sections, section_of = tree("\n".join(v))[1], tree("\n".join(v))[4]
        assert len(got[k][0]) <= 2 and len(sections) > 10
        assert all(section_of[p] in got[k][0] for p in got[k][1])
    assert got["same"] == ([], []) and len(got["delete"][0]) == 1

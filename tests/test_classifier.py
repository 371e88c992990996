import re

from docwright.operators import classifier as C


def test_needles_are_in_every_match():
    assert C.needles(r"witness\s*statement") == ["statement"] and C.needles(r"(?:fca|pra)x?") == ["fca", "pra"] and C.needles(r"\d+[ab]") is None
    texts = ["witness statement of john", "skeleton argument", "fca decision 12", "dear sir yours faithfully", "schedule of loss", "in witness whereof", "claim no: x", "breach of rule", "page 1 of 2", "an act to amend", "costs reserved"]
    for _, _, _, p in C.RULES:
        sure = C.needles(p)
        for t in texts:
            for m in re.finditer(p, t):
                assert sure is None or any(n in m[0] for n in sure), (p, t)

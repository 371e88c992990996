"""Match expressions of the keyword search: a parser and the expression over a row's terms.

    expr   := expr OR expr | expr AND expr | expr NOT expr | ( expr ) | phrases
    phrases := phrase phrase ...          neighbours: all of them; binds before NOT, which binds before AND, then OR
    phrase := string * + string * ...     * means any term that begins so
    string := "quoted, with "" for a quote" | letters, digits, _ and anything beyond ASCII

A string's terms follow each other, as joined strings' do. A string without terms is dropped among neighbours and else finds nothing. A
bracket beside a phrase, any other sign outside quotes (a hyphen, a colon), and an open quote or bracket are errors: the caller falls back to substrings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

WORDS = re.compile(r"[^\W_]+")
TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()*+])|([A-Za-z0-9_\x1a\x80-\U0010ffff]+))')


@dataclass(frozen=True)
class Phrase:
    """Slots (term, whether a beginning) that follow each other; none finds nothing."""

    slots: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class Both:
    kind: str  # AND, OR or NOT
    left: Node
    right: Node


Node = Phrase | Both


def _tokens(expression: str) -> list[str]:
    out, at, text = [], 0, expression.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append(m[0].strip() if not m[3] else m[3])
        at = m.end()
    return out


def parse(expression: str) -> Node:
    """The expression's tree; ValueError for a broken one."""
    tokens, at = _tokens(expression), 0
    if not tokens:
        return Phrase(())

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def string() -> bool:
        return peek() is not None and peek() not in ("(", ")", "*", "+", "AND", "OR", "NOT")

    def phrase() -> Phrase:
        nonlocal at
        slots: list[tuple[str, bool]] = []
        while True:
            if not string():
                raise ValueError("a word is missing")
            said = tokens[at]
            at += 1
            words = WORDS.findall((said[1:-1].replace('""', '"') if said[0] == '"' else said).lower())
            star = peek() == "*"
            at += star
            slots += [(w, star and k == len(words) - 1) for k, w in enumerate(words)]
            if peek() != "+":
                return Phrase(tuple(slots))
            at += 1

    def primary() -> Node:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = joined(0)
            if peek() != ")":
                raise ValueError("a bracket is not closed")
            at += 1
            return inner
        out: Node = phrase()
        while string():
            more = phrase()
            out = out if not more.slots else more if out == Phrase(()) else Both("AND", out, more)
        return out

    def joined(level: int) -> Node:
        nonlocal at
        if level == 3:
            return primary()
        kind = ("OR", "AND", "NOT")[level]
        out = joined(level + 1)
        while peek() == kind:
            at += 1
            out = Both(kind, out, joined(level + 1))
        return out

    out = joined(0)
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} is out of place")
    return out


def phrases(node: Node) -> list[Phrase]:
    """The phrases with terms, each once, in order."""
    found = [node] if isinstance(node, Phrase) else phrases(node.left) + phrases(node.right)
    return list(dict.fromkeys(p for p in found if p.slots))


def holds(node: Node, leaf) -> Column:
    """The expression's value from each phrase's; leaf gives a phrase's column."""
    if isinstance(node, Phrase):
        return leaf(node) if node.slots else F.lit(False)
    a, b = holds(node.left, leaf), holds(node.right, leaf)
    return a | b if node.kind == "OR" else a & b if node.kind == "AND" else a & ~b


def in_terms(words: Column, phrase: Phrase) -> Column:
    """Whether an array of terms holds the phrase."""
    if len(phrase.slots) == 1:
        term, begins = phrase.slots[0]
        return F.exists(words, lambda w: F.startswith(w, F.lit(term))) if begins else F.array_contains(words, term)
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    if any(b for _, b in phrase.slots):
        return F.rlike(text, F.lit(" " + " ".join(t + ("[^ ]*" if b else "") for t, b in phrase.slots) + " "))
    return F.contains(text, F.lit(" " + " ".join(t for t, _ in phrase.slots) + " "))


def matches(words: Column, expression: str) -> Column:
    """Whether terms (an array) satisfy the expression."""
    return holds(parse(expression), lambda p: in_terms(words, p))

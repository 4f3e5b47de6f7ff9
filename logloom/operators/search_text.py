"""Search text with operators, read into the search classes.

Words beside one another must all occur; that binds tightest, then NOT, AND and OR. ``"..."`` is a phrase, also
``a + b``; a star after a word or phrase makes it a beginning, ``^`` before it ties it to the line's start,
``NEAR(a "b c", 5)`` wants its phrases within five words, and brackets group. Operators are in capitals. A phrase
without a word finds nothing, and is left out between other words.
"""

from __future__ import annotations

import re

from logloom.operators import search as S

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()*+^,])|([A-Za-z0-9_\x1a\u0080-\U0010ffff]+))')


class _Tokens:
    """(kind, text) pairs: ``phrase`` for what stands in quotes, ``word``, and signs and operators as themselves."""

    def __init__(self, text: str):
        self.left, at, end = [], 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the search from {text[at:].strip()!r} on")
            quoted, sign, word = m.groups()
            if quoted is not None:
                self.left.append(("phrase", quoted.replace('""', '"')))
            elif sign or word in S.OPERATOR_WORDS[:3]:
                self.left.append((sign or word, sign or word))
            else:
                self.left.append(("word", word))
            at = m.end()
        self.left.reverse()

    def next_is(self, *kinds: str) -> bool:
        return bool(self.left) and self.left[-1][0] in kinds

    def take(self, *kinds: str) -> str:
        if not self.next_is(*kinds):
            raise ValueError(f"expected {' or '.join(kinds)}, found {self.left[-1][1] if self.left else 'the end'!r}")
        return self.left.pop()[1]


def read(text: str):
    """The search that a text with operators stands for."""
    tokens = _Tokens(text)
    if not tokens.left:
        raise ValueError("nothing to search for")
    spec = _any(tokens)
    if tokens.left:
        raise ValueError(f"unexpected {tokens.left[-1][1]!r}")
    return spec


def _chain(tokens: _Tokens, operator: str, part, joined):
    parts = [part(tokens)]
    while tokens.next_is(operator):
        tokens.take(operator)
        parts.append(part(tokens))
    return parts[0] if len(parts) == 1 else joined(parts)


def _any(tokens: _Tokens):
    return _chain(tokens, "OR", _all, lambda parts: S.any_of(*parts))


def _all(tokens: _Tokens):
    return _chain(tokens, "AND", _without, lambda parts: S.all_of(*parts))


def _without(tokens: _Tokens):
    def subtract(parts):
        keep = parts[0]
        for drop in parts[1:]:
            keep = S.Not(keep, drop)
        return keep
    return _chain(tokens, "NOT", _beside, subtract)


def _beside(tokens: _Tokens):
    if tokens.next_is("("):  # brackets stand alone, or between operators
        tokens.take("(")
        inner = _any(tokens)
        tokens.take(")")
        return inner
    parts = [_one(tokens)]
    while tokens.next_is("phrase", "word", "^"):
        parts.append(_one(tokens))
    held = [p for p in parts if not (isinstance(p, S.Phrase) and not p.terms)] or parts[:1]
    return held[0] if len(held) == 1 else S.all_of(*held)


def _one(tokens: _Tokens):
    if tokens.next_is("^"):
        tokens.take("^")
        return _phrase(tokens, True)
    if tokens.next_is("word") and tokens.left[-1][1] == S.OPERATOR_WORDS[3] and tokens.left[-2:-1] == [("(", "(")]:
        return _near(tokens)
    return _phrase(tokens)


def _phrase(tokens: _Tokens, first: bool = False) -> S.Phrase:
    terms: tuple[str, ...] = ()
    while True:
        terms += S.phrase(tokens.take("phrase", "word")).terms
        prefix = tokens.next_is("*")
        if prefix:
            tokens.take("*")
        if not tokens.next_is("+"):
            return S.Phrase(terms, prefix, first)
        tokens.take("+")


def _near(tokens: _Tokens):
    tokens.take("word")
    tokens.take("(")
    phrases, distance = [], S.NEAR_DISTANCE
    while not tokens.next_is(",", ")"):
        phrases.append(_phrase(tokens))
    if tokens.next_is(","):
        tokens.take(",")
        count = tokens.take("word")
        if not (count.isascii() and count.isdigit()):
            raise ValueError(f"expected a number of words, found {count!r}")
        distance = int(count)
    tokens.take(")")
    phrases = [p for p in phrases if p.terms]
    if len(phrases) < 2:
        return phrases[0] if phrases else S.Phrase(())
    return S.Near(tuple(phrases), distance)

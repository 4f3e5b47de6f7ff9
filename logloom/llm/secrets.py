"""Secrets in texts: fixed patterns, and values beside credential words that are costly to guess.

The guess cost of a value is the cheapest way to put it together from words, dates, repeats, keyboard walks
and plain characters, found by dynamic programming over its positions. Documents are scanned where they lie;
nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm import text as X

# The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]+", re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "guess")

#: Words whose neighbour may be a credential, wider than the base pattern.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private)[_-]?key|auth)"""
                     r"""["']?[\x20\t]*(?::=|=>|[:=]|\x20is\x20)[\x20\t]*["']?([^\s"'<>,;]+)""", re.I | re.A)
_TRIGGERS = ("pass", "pwd", "secret", "token", "credential", "key", "auth")

#: Words a guesser tries first, most common first; a parameter of the operator.
COMMON = ("password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "hello", "freedom", "whatever",
          "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "michael", "jordan", "hunter",
          "secret", "token", "test", "guest", "root", "user", "default", "change", "changeme", "example", "sample", "none",
          "null", "true", "false", "your", "here", "the", "and", "for", "with", "this", "that", "love", "summer", "winter",
          "spring", "autumn", "house", "water", "money", "computer", "internet", "server", "database", "company", "office",
          "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")

_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b): 1 for row in _ROWS for a, b in zip(row, row[1:])} | {(b, a): -1 for row in _ROWS for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)", re.A)


def _plain(c: str) -> float:
    """log10 of the alphabet a brute-force guesser needs for one character."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _streaks(follows: list[bool], step: int) -> list[int]:
    """For each place how often in a row, going on by ``step``, the next place follows."""
    out = [0] * (len(follows) + step)
    for i in range(len(follows) - 1, -1, -1):
        out[i] = out[i + step] + 1 if follows[i] else 0
    return out


class _Pieces:
    """Words, dates, repeats and walks that begin at a place of one value; lengths of runs are found once."""

    def __init__(self, value: str, words: Sequence[str]):
        self.value, self.ranks = value, _ranks(tuple(words))
        low = value.lower()
        self.low = low if len(low) == len(value) else value
        self.longest = max(map(len, self.ranks), default=0)
        n = len(value)
        self.repeats = {w: _streaks([value[i:i + w] == value[i + w:i + 2 * w] for i in range(max(n - w, 0))], w) for w in (1, 2, 3, 4)}
        pairs = [_NEXT.get(p) for p in zip(self.low, self.low[1:])]
        self.walks = {step: _streaks([p == step for p in pairs], 1) for step in (1, -1)}

    def at(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses) of every piece from ``i`` on."""
        value, low = self.value, self.low
        n = len(value)
        for j in range(i + 3, min(n, i + self.longest) + 1):
            rank = self.ranks.get(low[i:j])
            if rank:
                yield j, math.log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0.0)
        m = _DATE.match(value, i)
        if m:
            yield m.end(), math.log10(365 * 120) if m.end() - i > 4 else math.log10(120)
        for width, streak in self.repeats.items():
            times = streak[i] + 1 if i < len(streak) else 1
            if times >= 2 and times * width >= 3:
                yield i + times * width, sum(map(_plain, value[i:i + width])) + math.log10(times)
        for streak in self.walks.values():
            if i < len(streak) and streak[i] >= 2:
                yield i + streak[i] + 1, math.log10(4 * len(_ROWS) * 10) + math.log10(streak[i] + 1)


def guess_cost(value: str, words: Sequence[str] = COMMON) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; 0 for the empty text."""
    pieces = _Pieces(value, words)
    best = [0.0] + [math.inf] * len(value)
    for i in range(len(value)):
        best[i + 1] = min(best[i + 1], best[i] + _plain(value[i]))
        for j, cost in pieces.at(i):
            best[j] = min(best[j], best[i] + cost + math.log10(2))
    return best[-1]


_cache: dict[tuple, dict[str, int]] = {}


def _ranks(words: tuple) -> dict[str, int]:
    if words not in _cache:
        _cache[words] = {w: k for k, w in reversed(list(enumerate(words, 1)))}
    return _cache[words]


def find(text: str, least_cost: float = 9.0, words: Sequence[str] = COMMON, may_have_hex: bool = True) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start and then by kind."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(t in low for t in _TRIGGERS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        held = [(a, b) for _, a, b in out]
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            value = m[1].rstrip(".)]}!?")
            b = a + len(value)
            if not any(s <= a and b <= e for s, e in held) and guess_cost(value, words) >= least_cost:
                out.append(("guess", a, b))
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if may_have_hex:
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True


def _hex_likely(column: pa.Array) -> np.ndarray:
    """Documents that hold eight hex digits in a row at a multiple of eight, as every run of 16 does."""
    out = np.zeros(len(column), bool)
    for block in X.blocks(column):
        n = len(block.data) // 8 * 8
        if n:
            at = np.flatnonzero(_HEX_BYTE[block.data[:n]].reshape(-1, 8).all(1)) * 8
            out[block.lo + np.searchsorted(block.offsets, at, "right") - 1] = True
    return out


def listed(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 9.0,
                 words: Sequence[str] = COMMON) -> DataFrame:
    """One row per input row: id, ``spans`` (array of kind, start, end; code points, end exclusive).

    ``least_cost`` is the log10 of guesses from which a value in a credential context is reported. A null or
    empty text has no spans; ties in start go by the order of ``KINDS``; repeated rows are scanned alike.
    """
    words = tuple(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            hexes = _hex_likely(column)
            found = [find(t, least_cost, words, bool(h)) if t else [] for t, h in zip(column.to_pylist(), hexes)]
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found],
                             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["id", "spans"])

    ids = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = ids.schema["id"].dataType.simpleString()
    return (ids.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
            .withColumnRenamed("id", id_col))

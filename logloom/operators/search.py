"""Full-text search over log lines through an inverted index.

``build_index`` makes one row per (line, term) without a shuffle. ``search`` reads only the
terms asked for, gathers them per line in one aggregation on the (unique) line id, and
decides the whole expression there - so a term found in a third of all lines is spread by
id, and any mix of AND, OR, NOT, phrase and NEAR costs one scan and one shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import words as W
from logloom.operators import signals
from logloom.session import shared_dir, staged

# Default NEAR distance, ranking constants, and the characters that mean an expression.
NEAR_DISTANCE = 10
BM25_K1, BM25_B, BM25_MIN_IDF = 1.2, 0.75, 1e-6
OPERATOR_WORDS = ("AND", "OR", "NOT", "NEAR")
OPERATOR_CHARS = '"*()^'


@dataclass(frozen=True)
class Phrase:
    """Words in a row; ``prefix`` lets the last be a beginning, ``first`` ties it to the line's start."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = NEAR_DISTANCE


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    """Lines matching ``keep`` but not ``drop``."""

    keep: object
    drop: object


@dataclass(frozen=True)
class Where:
    """A predicate on the row itself, for scans that combine it with a search."""

    pred: Column


def phrase(text: str, prefix: bool = False, first: bool = False) -> Phrase:
    """One or more words as written; they are folded and stemmed, also before a prefix search."""
    found = tuple(W.term(w) for w in regex.findall(W.WORD, text))
    return Phrase(found, prefix, first)


def near(*texts: str, distance: int = NEAR_DISTANCE) -> Near:
    return Near(tuple(phrase(t) for t in texts), distance)


def all_of(*parts) -> And:
    return And(tuple(parts))


def any_of(*parts) -> Or:
    return Or(tuple(parts))


def is_expression(text: str) -> bool:
    """Whether search-bar text uses operators, and so is not a plain list of words."""
    return any(t in OPERATOR_WORDS or any(c in OPERATOR_CHARS for c in t) for t in text.split())


def match_spec(text: str):
    """Search-bar text as a match: with operators as they say, else every word, as a prefix."""
    if is_expression(text):
        from logloom.operators import search_text  # reads into the classes of this module
        return search_text.read(text)
    specs = tuple(p for p in (phrase(t, prefix=True) for t in text.split()) if p.terms)
    if not specs:
        raise ValueError("nothing to search for")
    return And(specs)


# --- the index -------------------------------------------------------------------------

def build_index(logs: DataFrame, text: str = "raw", asked=None) -> DataFrame:
    """``term, id, positions, words`` (words of the line) and ``dt`` when the table has it.

    With a search as ``asked`` it has the entries that this search reads, and no others: for an index that is used once.
    """
    keys = _keys(logs)
    listed = logs.select(*keys, W.words(F.col(text)).alias("_w"))
    found = W.postings("_w", None if asked is None else _atoms(asked))
    hits = listed.select(*keys, F.size("_w").alias("words"), F.explode(found).alias("_p"))
    return hits.select("_p.term", *keys, "_p.positions", "words")


def write_index(index: DataFrame, path: str, stored: bool = False) -> None:
    """Stores an index clustered by term; a term of any frequency is cut at line ids into several files.

    An index that is ``stored`` already, as when segments are joined, is read twice and not written aside first.
    """
    order = [c for c in ("dt", "term", "id") if c in index.columns]
    with nullcontext(index) if stored else staged(index, "index") as entries:
        out = entries.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append")
        (out.partitionBy("dt") if "dt" in index.columns else out).parquet(path)


# --- matching --------------------------------------------------------------------------

Atom = tuple[str, bool]


def _phrases(spec) -> list[Phrase]:
    if isinstance(spec, Phrase):
        return [spec]
    if isinstance(spec, Where):
        return []
    parts = spec.phrases if isinstance(spec, Near) else (spec.keep, spec.drop) if isinstance(spec, Not) else spec.parts
    return [p for part in parts for p in _phrases(part)]


def _atoms(spec) -> list[Atom]:
    out: dict[Atom, None] = {}
    for p in _phrases(spec):
        for i, t in enumerate(p.terms):
            out[t, p.prefix and i == len(p.terms) - 1] = None
    return list(out)


def _needs_positions(spec) -> bool:
    if isinstance(spec, Phrase):
        return len(spec.terms) > 1 or spec.first
    if isinstance(spec, (Near, Where)):
        return isinstance(spec, Near)
    return any(_needs_positions(p) for p in ((spec.keep, spec.drop) if isinstance(spec, Not) else spec.parts))


def _term_is(atom: Atom, col: Column) -> Column:
    return col.startswith(atom[0]) if atom[1] else col == atom[0]


def _minus(n: int):
    return lambda x: x - n


def _within(latest: Column, back: int):
    return lambda x: (x <= latest) & (x >= latest - back)


def _entry_of(atom: Atom):
    return lambda entry: _term_is(atom, entry["term"])


def _starts(p: Phrase, at: dict[Atom, Column]) -> Column:
    """Positions where a phrase begins."""
    last = len(p.terms) - 1
    shifted = []
    for i, t in enumerate(p.terms):
        where = at[t, p.prefix and i == last]
        shifted.append(F.transform(where, _minus(i)) if i else where)
    starts = reduce(F.array_intersect, shifted)
    return F.filter(starts, lambda x: x == 0) if p.first else starts


def _near(spec: Near, at: dict[Atom, Column]) -> Column:
    starts = [_starts(p, at) for p in spec.phrases]

    def together(latest: Column) -> Column:
        return reduce(lambda a, b: a & b, [
            F.exists(s, _within(latest, len(p.terms) + spec.distance))
            for p, s in zip(spec.phrases, starts)])

    return F.exists(F.concat(*starts), together)


def _holds(spec, at: dict[Atom, Column], positions: bool) -> Column:
    if isinstance(spec, Phrase):
        if not spec.terms:
            return F.lit(False)
        return F.size(_starts(spec, at)) > 0 if positions else at[spec.terms[0], spec.prefix]
    if isinstance(spec, Near):
        return _near(spec, at)
    if isinstance(spec, Where):
        return F.coalesce(spec.pred, F.lit(False))
    if isinstance(spec, Not):
        return _holds(spec.keep, at, positions) & ~_holds(spec.drop, at, positions)
    parts = [_holds(p, at, positions) for p in spec.parts]
    return reduce((lambda a, b: a & b) if isinstance(spec, And) else (lambda a, b: a | b), parts)


def _candidates(index: DataFrame, atoms: Sequence[Atom]) -> DataFrame:
    return index.filter(reduce(lambda a, b: a | b, [_term_is(a, F.col("term")) for a in atoms]))


def search(index: DataFrame, spec) -> DataFrame:
    """Ids of the matching lines, each once (with ``dt`` when the index has it)."""
    atoms = _atoms(spec)
    hits = _candidates(index, atoms)
    keys = _keys(index)
    if isinstance(spec, Phrase) and len(atoms) == 1 and not atoms[0][1] and not _needs_positions(spec):
        return hits.select(*keys)  # one exact term has one row per line
    positions = _needs_positions(spec)
    none = F.array().cast("array<int>")

    def gather(a: Atom) -> Column:
        if not positions:
            return F.coalesce(F.max(F.when(_term_is(a, F.col("term")), True)), F.lit(False))
        mine = F.flatten(F.collect_list(F.when(_term_is(a, F.col("term")), F.col("positions"))))
        return F.coalesce(mine, none)

    per_line = hits.groupBy(*keys).agg(*[gather(a).alias(f"_{i}") for i, a in enumerate(atoms)])
    at = {a: F.col(f"_{i}") for i, a in enumerate(atoms)}
    return per_line.filter(_holds(spec, at, positions)).select(*keys)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("id", "dt") if c in df.columns]


def scan(rows: DataFrame, spec, text: str = "raw") -> DataFrame:
    """Matching rows without an index, row by row: for streams and one-off scans."""
    atoms = _atoms(spec)
    df = rows.withColumn("_postings", W.postings(W.words(F.col(text)), atoms))
    for i, a in enumerate(atoms):
        mine = F.filter("_postings", _entry_of(a))
        df = df.withColumn(f"_{i}", F.flatten(F.transform(mine, lambda p: p["positions"])))
    at = {a: F.col(f"_{i}") for i, a in enumerate(atoms)}
    return df.filter(_holds(spec, at, True)).select(*rows.columns)


def combine(logs: DataFrame, ids: DataFrame, pred: Column | None = None, op: str = "and") -> DataFrame:
    """Search hits with a filter: both or either; the columns stay those of ``logs``."""
    if op == "or":
        return signals.either(logs, ids, F.lit(False) if pred is None else pred)
    return signals.both(logs if pred is None else logs.filter(pred), ids)


# --- ranking and excerpts --------------------------------------------------------------

def corpus_size(logs: DataFrame, text: str = "raw") -> tuple[int, float]:
    """Number of lines and their mean length in words, for ranking."""
    n = F.size(W.words(F.col(text)))
    r = logs.agg(F.count("*").alias("n"), F.avg(n).alias("mean")).first()
    return r.n, r.mean or 0.0


def bm25(index: DataFrame, phrases: Sequence[Phrase], lines: int, mean_words: float) -> DataFrame:
    """``id, rank`` of lines holding every phrase; lower ranks are better. A phrase counts as often as it occurs."""
    phrases = [p for p in phrases if p.terms]
    if not phrases:
        raise ValueError("nothing to rank by")
    atoms = _atoms(And(tuple(phrases)))
    none = F.array().cast("array<int>")
    at = {a: F.coalesce(F.flatten(F.collect_list(F.when(_term_is(a, F.col("term")), F.col("positions")))), none) for a in atoms}
    # what matches any word; a line's positions of the words asked for meet in one row
    per_line = _candidates(index, atoms).groupBy("id").agg(F.max("words").alias("words"), *[at[a].alias(f"_{i}") for i, a in enumerate(atoms)])
    held_at = {a: F.col(f"_{i}") for i, a in enumerate(atoms)}
    counted = per_line.select("id", "words", *[F.size(_starts(p, held_at)).alias(f"_f{i}") for i, p in enumerate(phrases)])
    # read twice, and small beside the index
    shared_dir(index.sparkSession)
    counted = counted.checkpoint()
    # the weight of a phrase counts all lines that hold it
    held = counted.agg(*[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"d{i}") for i in range(len(phrases))]).first()
    score = F.lit(0.0)
    for i in range(len(phrases)):
        f = F.col(f"_f{i}").cast("double")
        score = score + F.lit(_idf(lines, held[f"d{i}"])) * f * (BM25_K1 + 1) / (
            f + BM25_K1 * (1 - BM25_B + BM25_B * F.col("words") / F.lit(mean_words or 1.0)))
    both = reduce(lambda a, b: a & b, [F.col(f"_f{i}") > 0 for i in range(len(phrases))])
    return counted.filter(both).select("id", (-score).alias("rank"))


def _idf(lines: int, held: int) -> float:
    import math
    return max(math.log((lines - held + 0.5) / (held + 0.5)), BM25_MIN_IDF)


def highlight(text: Column, surface: str, left: str, right: str) -> Column:
    """The text with every word that begins with ``surface`` marked."""
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])({re.escape(surface)}[\p{{L}}\p{{N}}]*)"
    return F.regexp_replace(text, pattern, f"{left}$1{right}")


def like_scan(logs: DataFrame, needle: str, text: str = "raw") -> DataFrame:
    """The substring baseline: ASCII case is ignored, ``%`` and ``_`` are wildcards."""
    return logs.filter(F.col(text).ilike(f"%{needle}%"))

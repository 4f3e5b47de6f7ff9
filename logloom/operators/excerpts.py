"""What a search found, shown in the line: marked words and snippets, by the words' stems.

A line is its words and the text between them, so that everything is put together from arrays in the JVM; only
stems come from the index's Arrow function. Meant for lines that matched: their words are taken apart again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import words as W
from logloom.operators import search as S

SNIPPET_WORDS, MORE = 12, "…"


def _hits(spec, at: dict) -> list[Column]:
    """For each phrase, where it occurs: an array of (first, last) word.

    Nothing below NOT is shown, of alternatives only those that the line holds, and a NEAR group's phrases only where
    they stand together.
    """
    def spans(p: S.Phrase, starts: Column) -> Column:
        return F.transform(starts, lambda x: F.struct(x.alias("first"), (x + (len(p.terms) - 1)).alias("last")))

    if isinstance(spec, S.Phrase):
        return [spans(spec, S._starts(spec, at))] if spec.terms else []
    if isinstance(spec, S.Where):
        return []
    if isinstance(spec, S.Not):
        return _hits(spec.keep, at)
    if isinstance(spec, S.And):
        return [h for part in spec.parts for h in _hits(part, at)]
    if isinstance(spec, S.Or):
        none = F.array().cast("array<struct<first:int,last:int>>")
        return [F.when(S._holds(part, at, True), h).otherwise(none) for part in spec.parts for h in _hits(part, at)]
    starts = [S._starts(p, at) for p in spec.phrases]

    def together(latest: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.exists(s, S._within(latest, len(p.terms) + spec.distance))
                                           for p, s in zip(spec.phrases, starts)])

    ends = F.filter(F.concat(*starts), together)
    return [spans(p, F.filter(s, _near_any(ends, len(p.terms) + spec.distance))) for p, s in zip(spec.phrases, starts)]


def _near_any(ends: Column, back: int):
    return lambda x: F.exists(ends, lambda latest: (x <= latest) & (x >= latest - back))


def _merged(spans: Column) -> Column:
    """Sorted runs of words; those that overlap become one."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def add(runs: Column, s: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))
        return F.when((F.size(runs) > 0) & (s["first"] <= F.try_element_at(runs, F.lit(-1))["last"]), joined).otherwise(F.concat(runs, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def _opened(rows: DataFrame, spec, text: str) -> tuple[DataFrame, list[str]]:
    """Rows with ``_w`` (words), ``_g`` (the text around them) and a column of spans for each phrase."""
    atoms = S._atoms(spec)
    df = rows.withColumn("_w", W.words(F.col(text))).withColumn("_g", F.split(F.col(text), W.WORD, -1))
    df = df.withColumn("_postings", W.postings("_w", atoms))
    for i, a in enumerate(atoms):
        df = df.withColumn(f"_{i}", F.flatten(F.transform(F.filter("_postings", S._entry_of(a)), lambda p: p["positions"])))
    at = {a: F.col(f"_{i}") for i, a in enumerate(atoms)}
    hits = _hits(spec, at)
    names = [f"_h{k}" for k in range(len(hits))]
    return df.withColumns(dict(zip(names, hits))), names


def _marked(runs: Column, first: Column, last: Column, left: str, right: str) -> Column:
    """Words ``first`` to ``last`` with the text between them; runs of words are marked."""
    def word(i: Column) -> Column:
        before = F.when(F.exists(runs, lambda r: r["first"] == i), F.lit(left)).otherwise("")
        after = F.when(F.exists(runs, lambda r: r["last"] == i), F.lit(right)).otherwise("")
        gap = F.when(i > first, F.get("_g", i)).otherwise("")
        return F.concat(gap, before, F.get("_w", i), after)

    return F.when(last >= first, F.array_join(F.transform(F.sequence(first, last), word), "")).otherwise("")


def highlight(rows: DataFrame, spec, left: str, right: str, text: str = "raw", into: str = "marked") -> DataFrame:
    """The rows with every occurrence of the search's phrases marked; occurrences that overlap are marked as one.

    A null text stays null; ``_hits`` says which occurrences count.
    """
    df, names = _opened(rows, spec, text)
    runs = _merged(F.concat(*names)) if names else F.array().cast("array<struct<first:int,last:int>>")
    n = F.size("_w")
    whole = F.concat(F.get("_g", F.lit(0)), _marked(F.col("_runs"), F.lit(0), n - 1, left, right), F.when(n > 0, F.get("_g", n)).otherwise(""))
    return df.withColumn("_runs", runs).select(*[F.col(f"`{c}`") for c in rows.columns], whole.alias(into))


def _best(names: list[str], words: int) -> Column:
    """(kinds, width, first) of the run of words that counts, null without one; ``names`` hold the spans of each phrase.

    Occurrences are passed once, from the last one back, with the next end of every phrase at hand: the occurrences
    of one phrase are of one length, so that the next is the one that ends first.
    """
    none = 2 ** 31 - 1

    def tagged(name: str, k: int) -> Column:
        return F.transform(name, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.lit(k).alias("phrase")))

    fits = F.filter(F.concat(*[tagged(n, k) for k, n in enumerate(names)]), lambda s: s["last"] - s["first"] < words)

    def step(acc: Column, s: Column) -> Column:
        ends = [F.when(s["phrase"] == k, s["last"]).otherwise(acc[f"end{k}"]) for k in range(len(names))]
        held = [e - s["first"] < words for e in ends]
        kinds = reduce(lambda a, b: a + b, [F.when(h, 1).otherwise(0) for h in held])
        # the span in which every phrase that the run can hold has occurred once
        reach = F.greatest(s["last"], *[F.when(h, e).otherwise(-1) for h, e in zip(held, ends)])
        run = F.struct((-kinds).alias("kinds"), (reach - s["first"] + 1).alias("width"), s["first"].alias("first"))
        return F.struct(F.least(acc["best"], run).alias("best"), *[e.alias(f"end{k}") for k, e in enumerate(ends)])

    start = F.struct(F.lit(None).cast("struct<kinds:int,width:int,first:int>").alias("best"), *[F.lit(none).alias(f"end{k}") for k in range(len(names))])
    return F.aggregate(F.reverse(F.array_sort(fits)), start, step, lambda acc: acc["best"])


def snippet(rows: DataFrame, spec, left: str, right: str, words: int = SNIPPET_WORDS, more: str = MORE, text: str = "raw",
            into: str = "snippet") -> DataFrame:
    """The rows with the run of ``words`` words that shows most of the search, marked, and ``more`` where text is left out.

    Of the runs that begin with an occurrence, the one that holds the most different phrases counts, then the one
    whose occurrences span the fewest words, then the first. What it has room for is added on both sides alike. A line
    without an occurrence gives its beginning, a null text null.
    """
    df, names = _opened(rows, spec, text)
    every = F.concat(*names) if names else F.array().cast("array<struct<first:int,last:int>>")
    df = df.withColumn("_best", _best(names, words) if names else F.lit(None))
    n = F.size("_w")
    room = (F.col("_best.first") - F.floor((words - F.col("_best.width")) / 2)) if names else F.lit(0)
    first = F.greatest(F.lit(0), F.least(F.coalesce(room, F.lit(0)), n - words)).cast("int")
    df = df.withColumn("_first", first).withColumn("_last", F.least(F.col("_first") + words, n) - 1)
    # occurrences outside do not change which words of the run are marked
    near = F.filter(every, lambda s: (s["last"] >= F.col("_first")) & (s["first"] <= F.col("_last")))
    df = df.withColumn("_runs", _merged(near))
    shown = _marked(F.col("_runs"), F.col("_first"), F.col("_last"), left, right)
    out = F.concat(F.when(F.col("_first") > 0, F.lit(more)).otherwise(F.get("_g", F.lit(0))), shown,
                   F.when(F.col("_last") < n - 1, F.lit(more)).when(n > 0, F.get("_g", n)).otherwise(""))
    return df.select(*[F.col(f"`{c}`") for c in rows.columns], out.alias(into))

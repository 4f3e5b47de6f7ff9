"""Mixing sources to target weights by repetition rates.

Tokens are added up per source; targets share a total by weight, none above ``cap`` times its source, what
exceeds a cap being shared again among the others (a common level per unit of weight). A document is then
taken ``floor(rate)`` times, and once more if its hash falls below the fraction of the rate.

Sources are ranked over range-sorted parts, so there may be any number of them, and the level is found by a
few aggregates over the table of sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import storage

#: A word is anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranked(sources: DataFrame, by: str) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) in code point order, null last."""
    spark = sources.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = storage.table(sources.repartitionByRange(n, F.col(by).asc_nulls_last())
                           .sortWithinPartitions(F.col(by).asc_nulls_last())
                           .withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    # one row per part, of which there are as many as shuffle partitions
    before = (placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n"))
    return (placed.join(F.broadcast(before), part == F.col("part"))
            .withColumn("rank", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before"))
            .drop("at", "part", "before"))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> tuple[DataFrame, int]:
    """(source, source_size, target) for rows of (source, size), and the number of sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = storage.table(ranked(per, "source").withColumn("weight", weight).drop("rank"), "weights")
    total, count = per.agg(F.sum("source_size"), F.count("*")).first()
    goal, level, capped = share * float(total or 0), 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > F.lit(cap) * F.col("source_size")
        n, filled, free = per.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))),
                                  F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped:
            break
        capped = n
        level = (goal - cap * float(filled or 0)) / float(free) if free else level
    target = F.least(F.lit(level) * F.col("weight"), F.lit(cap) * F.col("source_size"))
    return per.select("source", "source_size", target.alias("target")), count


def rates(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2),
          share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, int]:
    """(sized documents as a written table of id, source, size; targets per source; number of sources)."""
    sized = storage.table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                      word_count(F.col(text_col)).alias("size")), "sizes")
    per, count = targets(sized, weights, share, cap)
    return sized, per, count


def copies(id_: Column, seed: int) -> Column:
    """How often a document of a row with ``target`` and ``source_size`` is taken."""
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    return (F.floor(rate) + (draw(id_, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per input row: id, size, source_size, target (of its source), taken (words, repeats counted).

    A null text has size 0; a null source is a source of its own; a source without words has target 0; rows
    with one id draw alike. An empty table gives an empty result; other columns are not read.
    """
    sized, per, count = rates(docs, id_col=id_col, **how)
    return storage.join_few(sized, per, "source", count).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * copies(F.col("id"), seed)).alias("taken"))


def mixture(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``.

    Rows without words are taken as often as their source's rate says and add nothing to its target; a null source
    is a source, one without words is left out. Rows with one id draw alike, those without an id share one draw.
    """
    _, per, count = rates(docs, id_col=id_col, source_col=source_col, **how)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"))
    taken = storage.join_few(whole, per, "source", count).withColumn("n", copies(F.col(f"row.`{id_col}`"), seed))
    return (taken.filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
            .select("row.*"))

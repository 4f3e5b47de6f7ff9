"""Ordered functions per key that stay spread out when one key holds most of the rows.

A plain window sends all rows of a key to one task. Here the rows are range-partitioned on
(key, order) - the order ends in a unique column, so any key can be cut anywhere - and each
cut is a chunk. A window runs inside (key, chunk); one summary row per (key, chunk) carries
what came before it. The chunks are checkpointed once, so the cuts are the same wherever
they are read, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import shared_dir


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with a ``_chunk`` number: ascending in (keys, order), one range partition each."""
    shared_dir(df.sparkSession)
    return (df.repartitionByRange(*keys, *order)
            .withColumn("_chunk", F.spark_partition_id()).checkpoint())


def _with_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Each row beside its (key, chunk) summary; a NULL key is a key like any other."""
    at = [*keys, "_chunk"]
    right = carried.withColumnsRenamed({k: f"_at{i}" for i, k in enumerate(at)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(at)])
    return rows.join(right, same, how).drop(*[f"_at{i}" for i in range(len(at))])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds ``row_number`` and ``running_sum`` of ``value`` per key, in ``order`` (ending in a unique column)."""
    chunks = ordered_chunks(df, keys, order)
    per_chunk = chunks.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
                              F.sum("_s").over(earlier).alias("_s_before"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    here = (chunks.withColumn("_n", F.row_number().over(w))
            .withColumn("_s", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    total = F.coalesce(F.col("_s") + F.col("_s_before"), F.col("_s"), F.col("_s_before"))
    return (_with_carried(here, before, keys)
            .withColumn("row_number", F.col("_n") + F.col("_n_before"))
            .withColumn("running_sum", total)
            .drop("_chunk", "_n", "_s", "_n_before", "_s_before"))


def lag_delta(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds ``previous`` and ``delta`` of ``value`` per key, in ``order`` (ending in a unique column)."""
    chunks = ordered_chunks(df, keys, order)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    last = (chunks.groupBy(*keys, "_chunk")
            .agg(F.max_by(value, F.struct(*order)).alias("_last")))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carried = last.select(*keys, "_chunk", F.lag("_last").over(over_chunks).alias("_before"))
    here = (chunks.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w)))
    return (_with_carried(here, carried, keys)
            .withColumn("previous", F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_lag")))
            .withColumn("delta", F.col(value) - F.col("previous"))
            .drop("_chunk", "_rn", "_lag", "_before"))


def _frame_parts(chunks: DataFrame, group: Sequence[str], forward: bool) -> DataFrame:
    """Per event the merged parts of all rows before it in its group, itself included; after it if not ``forward``.

    A group that several chunks share gets the parts of its other chunks from one summary row each. Only such groups
    are summed up, and a chunk has two borders, so that there are at most two summary rows a chunk.
    """
    merge = {"_n": F.sum, "_s": F.sum, "_lo": F.min, "_hi": F.max}
    step = [F.col(c) if forward else F.desc(c) for c in ("_at", "_kind")]
    w = Window.partitionBy(*group, "_chunk").orderBy(*step).rowsBetween(Window.unboundedPreceding, 0)
    here = chunks.select("*", *[f(c).over(w).alias(f"_here{c}") for c, f in merge.items()])
    cut = Window.partitionBy(*group)
    others = cut.orderBy("_chunk" if forward else F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (chunks.groupBy(*group, "_chunk").agg(*[f(c).alias(c) for c, f in merge.items()])
               .withColumn("_chunks", F.count("*").over(cut)).filter(F.col("_chunks") > 1)
               .select(*group, "_chunk", *[f(c).over(others).alias(f"_far{c}") for c, f in merge.items()]))
    both = _with_carried(here, carried, group, how="left")
    parts = {"_n": F.coalesce("_here_n", F.lit(0)) + F.coalesce("_far_n", F.lit(0)),
             "_s": F.coalesce(F.col("_here_s") + F.col("_far_s"), "_here_s", "_far_s"),
             "_lo": F.least("_here_lo", "_far_lo"), "_hi": F.greatest("_here_hi", "_far_hi")}
    return both.select(*group, "_of", "_kind", *[p.alias(c) for c, p in parts.items()])


def sliding(df: DataFrame, keys: Sequence[str], order: str, span: int, value: str) -> DataFrame:
    """Adds ``frame_rows``, ``frame_sum``, ``frame_min`` and ``frame_max`` of ``value`` over the rows of the same keys
    whose ``order``, an integer such as a time, is at most ``span`` below the row's own and not above it.

    That is ``RANGE BETWEEN span PRECEDING AND CURRENT ROW``, spread out: keys are cut into bins of ``span``. A frame
    starts in one bin and ends in the next, so it is the end of the former and the beginning of the latter, two running
    aggregates whatever the number of rows in the frame. Where many rows share a bin, chunks cut it. Nothing is
    subtracted, so minima work like sums.

    Rows that share an order share a frame; null values count as rows only. A null key is a key. Rows without an order
    are in no frame and get nulls. ``span`` is at least 1.
    """
    if span < 1:
        raise ValueError("the span of a frame is at least 1")
    names = [f"_key{i}" for i in range(len(keys))]
    at = F.col(order).cast("long")
    instants = (df.filter(F.col(order).isNotNull())
                .groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], at.alias("_of"))
                .agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    # a probe where the frame starts, before the rows there, and the rows themselves
    ends = F.explode(F.array(*[F.struct((F.col("_of") - F.lit(back).cast("long")).alias("_at"), F.lit(kind).alias("_kind"))
                               for kind, back in ((0, span), (1, 0))]))
    events = instants.select(*names, "_of", ends.alias("_end"), "_n", "_s", "_lo", "_hi")
    row = F.col("_end._kind") == 1
    start = F.col("_end._at") - F.pmod(F.col("_end._at"), F.lit(span).cast("long"))
    events = events.select(*names, start.alias("_bin"), "_of", "_end.*", *[F.when(row, F.col(c)).alias(c) for c in ("_n", "_s", "_lo", "_hi")])
    group = [*names, "_bin"]
    chunks = ordered_chunks(events, group, ["_at", "_kind"])
    parts = (_frame_parts(chunks, group, True).filter("_kind = 1")
             .unionByName(_frame_parts(chunks, group, False).filter("_kind = 0")))
    frames = parts.groupBy(*names, "_of").agg(F.sum("_n").alias("frame_rows"), F.sum("_s").alias("frame_sum"),
                                              F.min("_lo").alias("frame_min"), F.max("_hi").alias("frame_max"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], at == F.col("_of"))
    return df.join(frames, same, "left").drop(*names, "_of")


def sliding_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, value: str) -> DataFrame:
    """As ``sliding``, over the row and the ``rows - 1`` before it in ``order`` (ending in a unique column); also adds
    ``row_number`` and ``running_sum``. ``rows`` is at least 2."""
    return sliding(running(df, keys, order, value), keys, "row_number", rows - 1, value)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key, numbered ``rn``; each map task keeps only ``k`` per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def rank_groups(groups: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rank`` and ``dense_rank`` of already aggregated rows inside ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return groups.withColumn("rank", F.rank().over(w)).withColumn("dense_rank", F.dense_rank().over(w))

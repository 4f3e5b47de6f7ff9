"""Broadcast bitmaps of key hashes, past which most rows of a large table need no join and so no shuffle.

A row whose bit is not set surely has none of the keys; the others are joined as ever. So the bitmap decides what is
shuffled, never what comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 64 MB at most.
MOST_BITS = 1 << 29

#: Bits of one broadcast row, which is 4096 bytes, as Spark's bitmap functions have it.
PAGE = 8 * 4096


def _marked(rows: DataFrame, by: Sequence[str], keys: DataFrame, bits_a_key: int, most_bits: int) -> tuple[DataFrame, Column]:
    """``rows`` with what the test needs, and the test: whether the columns ``by`` may be a row of ``keys``."""
    n = keys.count()
    if n > most_bits:  # it would let all pass
        return rows, F.lit(True)
    bits = PAGE * (min(bits_a_key * n, most_bits) // PAGE + 1)

    def at(names: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(bits))

    set_bits = keys.select(at(keys.columns).alias("__at")).withColumn("__page", F.expr(f"__at div {PAGE}")).repartition("__page")
    pages = set_bits.groupBy("__page").agg(F.expr(f"bitmap_construct_agg(__at % {PAGE})").alias("__bitmap"))
    # as integers, which are tested faster than bytes are cut out
    word = "cast(conv(hex(substring(__bitmap, 4 * i + 1, 4)), 16, 10) as bigint)"
    words = F.expr(f"transform(sequence(0, {PAGE // 32 - 1}), i -> cast({word} - if({word} >= 2147483648, 4294967296, 0) as int))")
    marked = (rows.withColumn("__at", at(by))
              .join(F.broadcast(pages.select("__page", words.alias("__words"))), F.expr(f"__at div {PAGE} = __page"), "left"))
    place = f"cast(__at % {PAGE} as int)"
    return marked, F.expr(f"coalesce((shiftright(get(__words, {place} div 32), ({place} % 32) ^ 24) & 1) = 1, false)")


def split(rows: DataFrame, by: Sequence[str], keys: DataFrame, bits_a_key: int = 16,
          most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose columns ``by`` are surely no row of ``keys``, and the rest. No key may be null."""
    marked, maybe = _marked(rows, by, keys, bits_a_key, most_bits)
    return marked.filter(~maybe).select(*rows.columns), marked.filter(maybe).select(*rows.columns)


def likely(rows: DataFrame, by: Sequence[str], keys: DataFrame, bits_a_key: int = 16, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose columns ``by`` may be a row of ``keys``: all that are, and one in ``bits_a_key`` of the others."""
    return split(rows, by, keys, bits_a_key, most_bits)[1]

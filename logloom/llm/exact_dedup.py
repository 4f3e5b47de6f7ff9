"""Exact duplicates by digest, with heavy hitters taken out before the shuffle.

1. Texts become digests once, in a narrow written table.
2. A Misra-Gries summary per digest shard (Spark's ``approx_top_k``, whose sketch is the Misra-Gries
   counter set with purging by median) names the digests that may be frequent. Partial summaries are made
   map-side, and shards merge in parallel.
3. The named digests are counted exactly and their winners decided; at most ``shards * per_shard`` rows
   (bounded whatever the input), which are broadcast, so copies of hot texts never meet in a task.
4. All other digests are shuffled and decided there. What the summary missed is merely decided there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import storage

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def frequent(digests: DataFrame, shards: int, per_shard: int, tracked: int, heavy_from: int) -> DataFrame:
    """Keys (64-bit) of digests that the summaries count at least ``heavy_from`` times."""
    return (digests.groupBy(F.pmod("key", F.lit(shards)).alias("shard"))
            .agg(F.expr(f"approx_top_k(key, {per_shard}, {tracked})").alias("top"))
            .select(F.explode("top").alias("t"))
            .filter(F.col("t.count") >= heavy_from).select(F.col("t.item").alias("key")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 64,
                per_shard: int = 32, tracked: int = 256, heavy_from: int = 64) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they agree after ASCII white space is deleted. Of equal texts the row with the most
    code points stays, then the smallest id. A null text counts as empty; null ids lose to all others; of
    rows equal in all of this one stays. An empty table gives an empty result; other columns are not read.
    """
    digests = storage.table(
        docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("hex"),
                    F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"))
        .select("id", F.unhex("hex").alias("digest"), F.xxhash64("hex").alias("key"), "chars",
                F.monotonically_increasing_id().alias("row")), "digests")
    order = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), "id", "row")

    hot = F.broadcast(frequent(digests, shards, per_shard, tracked, heavy_from))
    winners = (digests.join(hot, "key", "left_semi").groupBy("digest")
               .agg(F.count("*").alias("size"), F.min(order).alias("best"))
               .withColumnRenamed("digest", "hot_digest"))
    tagged = digests.join(F.broadcast(winners), F.col("digest") == F.col("hot_digest"), "left")

    group = Window.partitionBy("digest")
    rest = (tagged.filter(F.col("hot_digest").isNull()).drop("size", "best")
            .withColumn("size", F.count("*").over(group)).withColumn("best", F.min(order).over(group)))
    every = tagged.filter(F.col("hot_digest").isNotNull()).select("id", "digest", "row", "size", "best").unionByName(
        rest.select("id", "digest", "row", "size", "best"))
    return every.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
                        (F.col("best.row") == F.col("row")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import storage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), a written table; the label is the smallest node of its component.

    Every round a node takes the smallest node beside it and then the label of its label. Edges go on as pairs of labels,
    those within one label end, so a round has at most half the nodes of the one before. Labels are combined map-side,
    and each round is a written table: nothing is gathered per node or on the driver.
    """
    edges, rounds = edges.select("a", "b").filter("a != b"), []
    while not edges.isEmpty():
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("end")
        labels = storage.table(edges.select(ends).groupBy(F.col("end.a").alias("node")).agg(F.min("end.b").alias("label"))
                               .select("node", F.least("node", "label").alias("label")), "labels")
        # every label is a node, too
        top = labels.withColumnsRenamed({"node": "at", "label": "top"})
        labels = storage.table(labels.join(top, F.col("label") == F.col("at")).select("node", F.col("top").alias("label")), "labels")
        a = labels.withColumnsRenamed({"node": "at_a", "label": "label_a"})
        b = labels.withColumnsRenamed({"node": "at_b", "label": "label_b"})
        edges = storage.table(edges.join(a, F.col("a") == F.col("at_a")).join(b, F.col("b") == F.col("at_b")).filter("label_a != label_b")
                              .select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), "edges")
        rounds.append(labels)
    if len(rounds) < 2:
        return rounds[0] if rounds else edges.toDF("node", "label")
    out = rounds[0]
    for later in rounds[1:]:
        top = later.withColumnsRenamed({"node": "at", "label": "top"})
        out = out.join(top, F.col("label") == F.col("at"), "left").select("node", F.coalesce("top", "label").alias("label"))
    return storage.table(out, "labels")

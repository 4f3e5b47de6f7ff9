"""Toxicity scores: logistic regression by FTRL-proximal over hashed words, word pairs and skip pairs.

Each coordinate has its own learning rate, and the L1 term keeps the weights of what says nothing at exactly
zero, so the model is a short list of coordinates, at most ``2 ** bits``, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import text as X

_PAIR, _SKIP = np.uint64(0x51ED270B7F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled sample that is learned from: about so many rows, chosen by a hash of their ids.

    ``positive`` is what an error on a toxic row weighs, as toxic rows are few.
    """

    bits: int = 20
    most_rows: int = 24_000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.1
    positive: float = 4.0


def features(block: X.Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate), each pair once and sorted: words, neighbours, and words with one between them."""
    w = X.words(block, X.ALNUM)
    doc = np.repeat(np.arange(len(block.offsets) - 1, dtype=np.int64), np.diff(w.first))
    parts, docs = [w.hash], [doc]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = doc[gap:] == doc[:-gap]
        parts.append(X.mix(w.hash[:-gap] * salt + w.hash[gap:])[same])
        docs.append(doc[gap:][same])
    at = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    pair = np.unique((np.concatenate(docs) << bits) | at)
    return pair >> bits, pair & ((1 << bits) - 1)


class Ftrl:
    """The per-coordinate state of FTRL-proximal; coordinate ``2 ** bits`` is the bias, which has no penalty."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == 1 << s.bits, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(w.sum()) - label) * (self.s.positive if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    """Nonzero weights by coordinate, sorted, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def scores(self, block: X.Block) -> np.ndarray:
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.at] = self.weight
        doc, at = features(block, self.bits)
        return _sigmoid(self.bias + np.bincount(doc, dense[at], minlength=len(block.offsets) - 1))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows (id, label 0 or 1). An id labelled more than once counts once, as toxic if any says so.

    About ``settings.most_rows`` labelled ids at most are learned from; their features, not their texts, go to
    the one task that runs the epochs. The driver gets the nonzero weights.
    """
    s = settings
    labelled = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
                .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    order = F.xxhash64(F.lit("toxic"), "id")
    count = labelled.count()
    share = min(1.0, s.most_rows / max(count, 1))
    sample = labelled.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).withColumn("order", order)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch.column(2)):
                doc, at = features(block, s.bits)
                bounds = np.searchsorted(doc, np.arange(block.hi - block.lo + 1))
                rows = batch.slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), X.binary_rows(at.astype(np.int32), bounds)],
                                                 ["order", "label", "at"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(label, np.frombuffer(at, np.int32)) for b in batches
                for label, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        state, bias = Ftrl(s), np.array([1 << s.bits])
        for _ in range(s.epochs):
            for label, at in rows:
                state.learn(np.concatenate([at, bias]), label)
        w = state.weights(np.arange((1 << s.bits) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["at", "weight"])

    # the sample has a bounded number of rows of two numbers each
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = texts.select("order", "label", "text").mapInArrow(featured, "order bigint, label int, at binary")
    weights = (rows.repartition(1).sortWithinPartitions("order", "label", "at")
               .mapInArrow(learned, "at bigint, weight double").orderBy("at").collect())
    at = np.array([r["at"] for r in weights], np.int64)
    w = np.array([r["weight"] for r in weights])
    own = at < 1 << s.bits
    return Model(at[own], w[own].astype(np.float32), float(w[~own].sum()), s.bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1). A null or empty text has the score of the bias alone.

    Texts are read whole; repeated rows get equal scores; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.scores(block) for block in X.blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())],
                                             ["id", "score"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its letters: the vectors, each rotated by its
place, are multiplied. A document bundles (adds) its trigram vectors; a language's prototype bundles its unit
document vectors; a document goes to the prototype with the largest cosine after the mean of all prototypes,
which carries what languages share, is taken from both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import text as X

UNDETERMINED = "und"

#: Symbols: 0 for whatever separates words, 1-26 for a-z, the rest shared by all other letters.
SYMBOLS = 64

#: Documents encoded at a time, which bounds the count matrix.
_DOCS = 256

#: Unit vectors are added as whole numbers, so that sums do not depend on their order.
_UNIT = 1 << 20


@lru_cache(1)
def _symbols() -> np.ndarray:
    """The symbol of every code point: letters by their lower case, all else 0."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 0x60 if 0x61 <= low <= 0x7A else 27 + low * 2654435761 % 4294967296 % (SYMBOLS - 27)
    return out


@lru_cache(4)
def letter_vectors(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))


def _trigrams(block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram) of a block in order, and whether each document has a letter."""
    symbol = _symbols()[np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    chars = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=chars[1:])
    doc = np.repeat(np.arange(len(block.offsets) - 1, dtype=np.int64), np.diff(chars[block.offsets]))
    keep = symbol != 0
    letters = np.bincount(doc[keep], minlength=len(block.offsets) - 1) > 0
    # one gap between words: a gap stays if a letter of the same document precedes it
    keep[1:] |= (symbol[:-1] != 0) & (doc[1:] == doc[:-1])
    symbol, doc = symbol[keep].astype(np.int64), doc[keep]
    same = doc[2:] == doc[:-2]
    gram = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
    return doc[2:][same], gram[same], letters


def encode(block: X.Block, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of every document of a block, and whether it has a letter."""
    doc, gram, letters = _trigrams(block)
    n = len(block.offsets) - 1
    used = np.flatnonzero(np.bincount(gram, minlength=SYMBOLS ** 3))
    place = np.zeros(SYMBOLS ** 3, np.int64)
    place[used] = np.arange(len(used))
    counts = np.bincount(doc * len(used) + place[gram], minlength=n * len(used)).reshape(n, len(used)).astype(np.float32)
    v = letter_vectors(dim, seed)
    bound = v[used // SYMBOLS ** 2] * np.roll(v, 1, 1)[used // SYMBOLS % SYMBOLS] * np.roll(v, 2, 1)[used % SYMBOLS]
    return counts @ bound, letters


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class Profiles:
    """What was learned: one prototype per language, in order of ``languages``."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    dim: int
    seed: int

    def predict(self, block: X.Block) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, -1 if undetermined; score in 0..1) of every document of a block."""
        vectors, letters = encode(block, self.dim, self.seed)
        if not self.languages:
            return np.full(len(letters), -1), np.zeros(len(letters))
        mean = _unit(self.prototypes).mean(0) if len(self.languages) > 1 else np.zeros(self.dim)
        cosine = _unit(_unit(vectors) - mean) @ _unit(_unit(self.prototypes) - mean).T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return np.where(letters, best, -1), np.where(letters, score, 0)


def remainder(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % n


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = 512, seed: int = 11) -> Profiles:
    """Learns from all rows with a language: each partition adds its documents, Spark adds the partitions.

    The driver gets ``dim`` numbers per language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for block in X.blocks(batch.column(1), docs=_DOCS):
                vectors, letters = encode(block, dim, seed)
                whole = np.rint(_unit(vectors) * _UNIT).astype(np.int64)
                own = langs[block.lo:block.hi]
                for lang in set(own[letters]):
                    sums[lang] = sums.get(lang, 0) + whole[(own == lang) & letters].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                          pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    known = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    parts = known.filter("lang is not null and text is not null").mapInArrow(run, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    languages = tuple(sorted({r["lang"] for r in sums}))
    out = np.zeros((len(languages), dim))
    for r in sums:
        out[languages.index(r["lang"]), r["k"]] = r["v"] / _UNIT
    return Profiles(languages, out, dim, seed)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score``. A null text, or one without a letter, is ``und`` with score 0.

    Repeated rows get equal answers; of tied languages the first by name is taken; without any learned language
    all is ``und``. Texts are read whole; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)  # ``dim`` numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.value.languages, UNDETERMINED]
        for batch in batches:
            best, score = _over(batch.column(1), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[k] for k in best], pa.string()),
                                              pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, lang_pred string, score double")
            .withColumnRenamed("id", id_col))


def _over(column: pa.Array, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    parts = [profiles.predict(block) for block in X.blocks(column, docs=_DOCS)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*parts))


def accepted(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with a score of ``least`` or more.

    Null texts, texts without a letter and, without any learned language, all texts go; rows are judged one by one,
    so repeated rows stay or go together. Only the text leaves the JVM, and one flag comes back.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("boolean")
    def fits(texts: pa.Array) -> pa.Array:
        best, score = _over(texts, model.value)
        return pa.array((best >= 0) & (score >= least))

    return docs.filter(fits(F.col(text_col)))

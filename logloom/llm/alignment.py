"""Which tokens of two tokenizers end together, counted over a corpus and looked up again for every document.

Both tokenizers see a space and the text. Tokens of both that end at the same byte are a link, and cut the text into
groups. The first pass counts links by task; the distinct pairs get a minimal perfect hash, and the tasks' counts,
as dense vectors over its places, are summed in a tree. The second pass aligns the documents again and looks their
pairs up.

Two tokens that end together are the ends of one another's bytes, so there are fewer distinct pairs than the
vocabularies have token bytes (about 490,000 for the two here), whatever the corpus. That bounds the hash, the
vectors and what is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import perfect_hash, storage

#: The folder of the vocabulary files. A parameter; it must lie on every executor.
FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Fixed value: how the byte-level vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What neither tokenizer's tokens cross: the place before one space or line end between two characters that are no white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

#: Parts of text, and ids of parts, that a worker remembers; beyond it starts anew. Results do not depend on it.
REMEMBERED, REMEMBERED_IDS = 1 << 18, 1 << 23

#: Tokens of the first tokenizer that are aligned at a time; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 18

#: Places of a count vector that are summed as one row.
SEGMENT = 1 << 13


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers over parts of text that do not influence one another, each distinct part tokenized once."""

    def __init__(self, folder: str):
        with open(f"{folder}/{BYTE_LEVEL}", encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        special = {i: t for t, i in vocabulary.items() if any(c not in letters for c in t) or t.startswith("<|")}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i not in special}
        self.a = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        self.bytes_b = [self._piece(i) for i in range(len(self.b))]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in map(self.b.id_to_piece, range(len(self.b)))):
            raise ValueError("a piece crosses the places where texts are cut")
        self.size_a = max(vocabulary.values()) + 1
        self.long_a = np.zeros(self.size_a, np.int64)
        for t, i in ranks.items():
            self.long_a[i] = len(t)
        self.long_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self._forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.void: set[int] = set()
        self.ids = [np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)]
        self.bounds = [np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)]

    def _both(self, joined: str) -> tuple[list[int], list[int]]:
        # the second puts a space before what it is given, which is a token of its own before a line end
        ids = self.b.encode(joined[1:] if joined[0] == " " else joined)
        return self.a.encode_ordinary(joined), ids if joined[0] == " " else ids[1:]

    def _learn(self, parts: list[str]) -> None:
        """Tokenizes parts in one go, those that end in white space last, as nothing may follow them."""
        parts.sort(key=lambda p: p[-1].isspace())
        if sum(p[-1].isspace() for p in parts) > 1:
            raise ValueError("only the last part of a text ends in white space")
        joined = "".join(parts)
        found, first = self._both(joined), len(self.known)
        if b"".join(map(self.bytes_b.__getitem__, found[1])) == joined.encode():
            size = np.array([len(p) if p.isascii() else len(p.encode()) for p in parts], np.int64)
            ends = np.cumsum(size)
            self._note(found, [np.searchsorted(np.cumsum(long[np.array(ids, np.int64)]), ends) + 1
                               for long, ids in zip((self.long_a, self.long_b), found)])
        else:
            each = [self._both(p) for p in parts]
            self.void |= {first + k for k, (p, (_, ids)) in enumerate(zip(parts, each))
                          if b"".join(map(self.bytes_b.__getitem__, ids)) != p.encode()}
            self._note([list(chain.from_iterable(x)) for x in zip(*each)], [np.cumsum([len(x) for x in z]) for z in zip(*each)])
        self.known.update(zip(parts, range(first, first + len(parts))))

    def _note(self, found, ends) -> None:
        first = len(self.known)
        for which, (ids, end) in enumerate(zip(found, ends)):
            bounds, used = self.bounds[which], self.bounds[which][first]
            while len(bounds) <= first + len(end):
                bounds = np.concatenate([bounds, np.zeros_like(bounds)])
            bounds[first + 1:first + 1 + len(end)] = used + end
            while len(self.ids[which]) < used + len(ids):
                self.ids[which] = np.concatenate([self.ids[which], np.zeros_like(self.ids[which])])
            self.bounds[which] = bounds
            self.ids[which][used:used + len(ids)] = ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both for a space and ``text``, which is not empty; None if the bytes of either differ from that."""
        n = len(self.known)
        if n > REMEMBERED or self.bounds[0][n] > REMEMBERED_IDS:
            self._forget()
        parts = _CUT.split(" " + text)
        get = self.known.get
        at = [get(p, -1) for p in parts]
        if -1 in at:
            self._learn(list(dict.fromkeys(p for p, k in zip(parts, at) if k < 0)))
            at = [self.known[p] for p in parts]
        if self.void and not self.void.isdisjoint(at):
            return None
        at = np.array(at, np.int64)
        out = []
        for ids, bounds in zip(self.ids, self.bounds):
            start, size = bounds[at], bounds[at + 1] - bounds[at]
            ends = np.cumsum(size)
            out.append(ids[np.repeat(start - ends + size, size) + np.arange(ends[-1])])
        return tuple(out)


@lru_cache(2)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


@dataclass
class Aligned:
    """Rows ``lo`` to ``hi`` of a batch: their tokens in a row, the tokens that end together, and where documents end."""

    lo: int
    hi: int
    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    ends_links: np.ndarray


def _aligned(t: Tokenizers, lo: int, rows: list) -> Aligned:
    none = np.zeros(0, np.int32)
    rows = [r or (none, none) for r in rows]
    a, b = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    ends_a, ends_b = (np.cumsum([len(r[k]) for r in rows]) for k in (0, 1))
    over_a, over_b = np.cumsum(t.long_a[a]), np.cumsum(t.long_b[b])
    at = np.searchsorted(over_a, over_b)
    same = np.flatnonzero(over_a[at] == over_b) if len(b) else np.zeros(0, np.int64)
    return Aligned(lo, lo + len(rows), a, b, at[same], same, ends_a, ends_b, np.searchsorted(same, ends_b))


def aligned(t: Tokenizers, column: pa.Array) -> Iterator[Aligned]:
    """All texts of a column in blocks. Empty, null and differing texts have no tokens."""
    rows, lo, held = [], 0, 0
    for k, text in enumerate(column):
        text = text.as_py()
        rows.append(t.encode(text) if text else None)
        held += len(rows[-1][0]) if rows[-1] else 0
        if held >= BLOCK_TOKENS or k + 1 == len(column):
            yield _aligned(t, lo, rows)
            rows, lo, held = [], k + 1, 0


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, from the left, with room for one more character, and their numbers."""
    width = len(str(n - 1)) + 1
    size = np.ones(n, np.int64)
    for k in range(1, width):
        size[10 ** k:] += 1
    place = size[:, None] - 1 - np.arange(width)
    return np.where(place >= 0, np.arange(n)[:, None] // 10 ** np.maximum(place, 0) % 10 + 48, 0).astype(np.uint8), size


def written(block: Aligned, digits: np.ndarray, size: np.ndarray) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` for every document of a block, as bytes."""
    first_a = np.concatenate([[0], block.link_a[:-1] + 1])[:len(block.link_a)]
    first_b = np.concatenate([[0], block.link_b[:-1] + 1])[:len(block.link_b)]
    n_a, n_b = block.link_a + 1 - first_a, block.link_b + 1 - first_b
    at_a = np.arange(len(block.a)) + np.repeat(first_b, n_a)
    at_b = np.arange(len(block.b)) + np.repeat(block.link_a + 1, n_b)
    ids = np.zeros(len(block.a) + len(block.b), np.int64)
    ids[at_a], ids[at_b] = block.a, block.b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[at_a[block.link_a]], mark[at_b[block.link_b]] = ord("|"), ord(";")
    rows, long = digits[ids], size[ids]
    rows[np.arange(len(ids)), long] = mark
    flat = rows[np.arange(digits.shape[1]) <= long[:, None]]
    over = np.concatenate([[0], np.cumsum(long + 1)])[np.concatenate([[0], block.ends_a + block.ends_b])]
    view = memoryview(flat)
    return [view[i:max(i, j - 1)] for i, j in zip(over[:-1].tolist(), over[1:].tolist())]


def _keys(t: Tokenizers, block: Aligned) -> np.ndarray:
    return block.a[block.link_a].astype(np.int64) * len(t.bytes_b) + block.b[block.link_b]


def _links_by_task(texts: DataFrame, folder: str) -> DataFrame:
    """(key, n): every task's distinct pairs with their links in it; a task holds one number a distinct pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(folder)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for block in aligned(t, batch.column(0)):
                more, n = np.unique(_keys(t, block), return_counts=True)
                keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)]), pa.array(counts[at:at + (1 << 16)])], ["key", "n"])

    return texts.mapInArrow(run, "key bigint, n bigint")


def _vectors(links: DataFrame, hashed) -> DataFrame:
    """(segment, branch, v): the counts of every task as dense vectors over the places of the hash, in segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, out = hashed.value, None
        for batch in batches:
            out = np.zeros(len(h.keys), np.int64) if out is None else out
            np.add.at(out, h.places(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        if out is not None:
            yield from _segments({k: out[k * SEGMENT:(k + 1) * SEGMENT] for k in range(-(-len(out) // SEGMENT))},
                                 TaskContext.get().partitionId())

    return links.select("key", "n").mapInArrow(run, "segment int, branch int, v binary")


def _segments(sums: dict[int, np.ndarray], branch: int) -> Iterator[pa.RecordBatch]:
    for segment, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([branch], pa.int32()),
                                          pa.array([v.tobytes()], pa.binary())], ["segment", "branch", "v"])


def _summed(vectors: DataFrame, *by) -> DataFrame:
    """One level of the tree: vectors that meet in a task are added as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, v in zip(batch.column(0).to_pylist(), batch.column(2)):
                sums[segment] = sums.get(segment, 0) + np.frombuffer(v.as_buffer(), np.int64)
        yield from _segments(sums, TaskContext.get().partitionId())

    return vectors.repartition(*by).mapInArrow(run, vectors.schema)


@dataclass(frozen=True)
class Table:
    """Every distinct pair of the corpus with its links: ``counts`` by place, and whether that is the most of its second id."""

    hashed: perfect_hash.PerfectHash
    counts: np.ndarray
    best: np.ndarray
    size_b: int

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first id, second id, links) of every pair."""
        return self.hashed.keys // self.size_b, self.hashed.keys % self.size_b, self.counts


def most_pairs(t: Tokenizers) -> int:
    """A bound of the distinct pairs: of two tokens that end together the shorter is an end of the longer."""
    return int(t.long_a.sum() + t.long_b.sum())


def learn(docs: DataFrame, text_col: str = "text", folder: str = FOLDER) -> Table:
    """Counts the links of all texts. The driver gets the distinct pairs and one number for each, see ``most_pairs``."""
    spark, t = docs.sparkSession, tokenizers(folder)
    links = storage.table(_links_by_task(docs.select(F.col(text_col).cast("string").alias("text")), folder), "links")
    distinct = links.select("key").distinct().limit(most_pairs(t) + 1).toArrow().column("key").to_numpy()
    if len(distinct) > most_pairs(t):
        raise RuntimeError("more distinct pairs than the vocabularies allow")
    hashed = perfect_hash.build(distinct)
    shared = spark.sparkContext.broadcast(hashed)
    # a tree of two levels, each adding about the square root of the vectors
    vectors = _vectors(links, shared)
    fan = max(1, round(links.rdd.getNumPartitions() ** 0.5))
    level = _summed(vectors, F.col("segment"), F.col("branch") % fan)
    counts = np.zeros(len(hashed.keys), np.int64)
    for row in _summed(level, F.col("segment")).toLocalIterator():
        counts[row.segment * SEGMENT:(row.segment + 1) * SEGMENT] += np.frombuffer(row.v, np.int64)
    second = hashed.keys % len(t.bytes_b)
    top = np.zeros(len(t.bytes_b), np.int64)
    np.maximum.at(top, second, counts)
    return Table(hashed, counts, counts == top[second], len(t.bytes_b))


def align(docs: DataFrame, table: Table, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """One row per input row: id, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    ``groups`` is the SHA-256 of the written groups, empty without tokens. A text that is null, empty, or whose
    tokens' bytes are not those of a space and the text, has no tokens: zeros. Rows are judged one by one, whatever
    their id (null and repeated ids too); repeated rows count as often as they stand there. Texts are read whole;
    other columns are not read. ``table`` must come from ``learn`` over texts that include these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = tokenizers(folder), shared.value
        digits, size = _digits(max(t.size_a, len(t.bytes_b)))
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            hashes: list[str] = []
            for block in aligned(t, batch.column(1)):
                place = known.hashed.places(_keys(t, block))
                if len(place) and place.min() < 0:
                    raise RuntimeError("a text holds a pair that was not counted")
                ends = np.concatenate([[0], block.ends_links])

                def by_document(x: np.ndarray) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(x)])[ends])

                n_links = np.diff(ends)
                for column, x in zip(columns, (np.diff(block.ends_a, prepend=0), np.diff(block.ends_b, prepend=0), n_links,
                                               by_document(known.best[place].astype(np.int64)), by_document(known.counts[place]))):
                    column.append(x.astype(np.int64))
                hashes += [hashlib.sha256(w).hexdigest() if n else "" for w, n in zip(written(block, digits, size), n_links.tolist())]
            n_a, n_b, links, best, total = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_a, n_b, links, links, best, total, pa.array(hashes, pa.string())],
                                             ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint,"
                                 " count_sum bigint, groups string").withColumnRenamed("id", id_col))

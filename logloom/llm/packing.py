"""Token ids packed into rows of one length: best-fit decreasing with a segment tree over capacities.

Documents are tokenized where they lie and packed in batches of a bounded number of tokens, so nothing is
shuffled and no task holds more than a batch. A document longer than a row is cut into parts of a row's length;
parts and the rest are packed like documents, and (document, part) says where each piece belongs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import text as X

#: A rank file: one ``base64 rank`` pair a line. A parameter; the file must lie on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary's byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Tokens packed together.
BATCH_TOKENS = 1 << 22

#: Pieces of text whose ids a worker remembers; beyond it starts anew. Results do not depend on it.
REMEMBERED = 1 << 19


#: A run of letters with the space before it, or a run of anything else up to such a space.
_PIECE = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"
                    r"|(?:[^ A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]| (?![A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]))+")


class Tokenizer:
    """Byte-level BPE over pieces of text that do not influence one another, each distinct piece tokenized once.

    ``PATTERN`` starts a new unit at every border between a run of letters and what is no letter. Two kinds of
    pieces may go together with what follows, an apostrophe and several white spaces, and are joined with it; a
    text with letters beyond ``_PIECE`` is tokenized as a whole.
    """

    _JOINED, _WHOLE = -1, -2

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)  # the id after the vocabulary ends a document
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _learn(self, piece: str, joined: bool = False) -> int:
        if not joined and not piece[-1].isalpha():
            if piece[-1] == "'" or piece[-2:].isspace() and len(piece) > 1:
                return self.known.setdefault(piece, self._JOINED)
        if not joined and not piece.lstrip(" ").isalpha() and not piece.isascii() and any(c.isalpha() or c.isnumeric() for c in piece):
            return self.known.setdefault(piece, self._WHOLE)
        ids = self.coder.encode_ordinary(piece)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if self.count == len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used:self.used + len(ids)] = ids
        self.start[self.count], self.size[self.count] = self.used, len(ids)
        self.used += len(ids)
        self.count += 1
        if not joined:
            self.known[piece] = self.count - 1
        return self.count - 1

    def encode(self, text: str) -> np.ndarray:
        if self.count > REMEMBERED:
            self._forget()
        pieces = _PIECE.findall(text)
        get = self.known.get
        at = [k if (k := get(p)) is not None else self._learn(p) for p in pieces]
        if at and min(at) < 0:
            if self._WHOLE in at:
                return np.array(self.coder.encode_ordinary(text), np.int32)
            at = self._join(pieces, at)
        at = np.array(at, np.int64)
        size = self.size[at]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def _join(self, pieces: list[str], at: list[int]) -> list[int]:
        out, held = [], ""
        for piece, k in zip(pieces, at):
            if k == self._JOINED:
                held += piece
            elif held:
                out.append(self._learn(held + piece, True))
                held = ""
            else:
                out.append(k)
        return out + ([self._learn(held, True)] if held else [])


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Capacities:
    """A segment tree over the room left in open rows: the least room that still holds a piece, in log(row) steps."""

    def __init__(self, row: int):
        self.leaves = 1 << row.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(row + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of ``size`` or more, which is taken out; None if there is none."""
        node = size + self.leaves
        if not self.count[node]:
            # climb to the first subtree to the right that holds a row, then go down its left side
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: np.ndarray, row: int) -> list[list[int]]:
    """Pieces (by number, none larger than ``row``) in each row: largest first, each into the fullest row that holds it."""
    open_rows, rows = Capacities(row), []
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        found = open_rows.take(size)
        room, at = found if found else (row, len(rows))
        if not found:
            rows.append([])
        rows[at].append(int(k))
        if room > size:
            open_rows.add(room - size, at)
    return rows


def _rows(ids: list, tokens: list[np.ndarray], row: int, pad: int, first: int, id_type: pa.DataType) -> pa.RecordBatch:
    """One batch of documents as packed rows, numbered from ``first``."""
    owner, part, pieces = [], [], []
    for k, t in enumerate(tokens):
        for n, a in enumerate(range(0, len(t), row)):
            owner.append(k)
            part.append(n)
            pieces.append(t[a:a + row])
    packs = best_fit(np.array([len(p) for p in pieces]), row)
    matrix = np.full((len(packs), row), pad, "<i4")
    ends = []
    for r, pack in enumerate(packs):
        flat = np.concatenate([pieces[k] for k in pack])
        matrix[r, :len(flat)] = flat
        ends.append(np.concatenate([[0], np.cumsum([len(pieces[k]) for k in pack])]))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first, first + len(packs)), pa.int64()), X.binary_rows(matrix.reshape(-1), np.arange(len(packs) + 1) * row),
         pa.array([int(e[-1]) for e in ends], pa.int32()), pa.array([e.tolist() for e in ends], pa.list_(pa.int32())),
         pa.array([e[:-1].tolist() for e in ends], pa.list_(pa.int32())),
         pa.array([[ids[owner[k]] for k in pack] for pack in packs], pa.list_(id_type)),
         pa.array([[part[k] for k in pack] for pack in packs], pa.list_(pa.int32()))],
        ["row", "ids", "n_tokens", "cu_seqlens", "resets", "docs", "parts"])


def packed(docs: DataFrame, row: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Packed rows: ``row`` number, ``ids`` (little-endian int32 of one length, padded), ``n_tokens`` before the padding,
    ``cu_seqlens`` (0 and the end of each segment), ``resets`` (where positions start again at 0), ``docs`` and ``parts``
    (the document of each segment, and which of its parts it is).

    Every document ends with the end id, which also pads; a null or empty text is that id alone. A document longer
    than a row is cut into parts, so no token is lost. Ties in length keep the order of the input; repeated rows
    are packed each; an empty table gives no rows. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        end = np.array([t.end], np.int32)
        number = TaskContext.get().partitionId() << 32
        ids, tokens, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(id_)
                tokens.append(np.concatenate([t.encode(text.as_py() or ""), end]))
                held += len(tokens[-1])
                if held >= BATCH_TOKENS:
                    out = _rows(ids, tokens, row, t.end, number, kind)
                    number += len(out)
                    ids, tokens, held = [], [], 0
                    yield out
        if ids:
            yield _rows(ids, tokens, row, t.end, number, kind)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row bigint, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, docs array<{kind}>, parts array<int>")


def segments(rows: DataFrame) -> DataFrame:
    """The segments of packed rows: doc, part, tokens (array of int). Concatenated by part they are the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part, tokens = [], [], []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i4")
                for d, p, a, b in zip(r["docs"], r["parts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                    doc.append(d)
                    part.append(p)
                    tokens.append(ids[a:b].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("docs").type.value_type), pa.array(part, pa.int32()),
                                              pa.array(tokens, pa.list_(pa.int32()))], ["doc", "part", "tokens"])

    kind = rows.schema["docs"].dataType.elementType.simpleString()
    return rows.select("ids", "cu_seqlens", "docs", "parts").mapInArrow(run, f"doc {kind}, part int, tokens array<int>")

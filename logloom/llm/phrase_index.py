"""A distributed positional inverted index, and benchmark decontamination by phrase search in it.

The index is split by document: a segment holds the postings of a few megabytes of whole documents, made in
one task and written as a table, so building needs no shuffle and no list grows with the corpus. A search
takes the postings of its terms, gathers them per segment, starts from the rarest term of each phrase and
intersects the lists of the others, shifted by their offsets. Phrases are searched in blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import bitmap, storage
from logloom.llm import text as X

#: Text of one segment; a longer document is a segment of its own.
SEGMENT_BYTES = 5 << 20

#: Phrases (with the item they belong to) sent to the executors at once, which bounds every broadcast.
PHRASES = 50_000

#: Bits a key of the bitmap of found documents: a clean document is joined once in so many.
ROW_BITS = 64

#: What a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as the index has them; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _rows_of(segment: int, block: X.Block, ids: pa.Array) -> list[pa.RecordBatch]:
    """The rows of one segment; the arrays they are made of are gone before the next one is begun."""
    names = ["segment", "term", "count", "postings", "ids", "sizes"]
    w = X.words(block, X.ALNUM)
    order = np.argsort(w.hash, kind="stable")
    ranked = w.hash[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(order) else order
    steps = np.diff(order, prepend=0)
    steps[new] = order[new]
    first, bounds = order[new], np.append(new, len(order))
    del order, ranked
    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    rows = [pa.RecordBatch.from_arrays(
        [pa.array([segment], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
         own, pa.array([np.diff(w.first)], pa.list_(pa.int32()))], names)]
    if len(new):
        rows.append(pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(new), segment), pa.int64()), _strings(X.ALNUM[block.data], w.start[first], w.end[first]),
             pa.array(np.diff(bounds), pa.int64()), X.binary_rows(steps.astype(np.uint32), bounds),
             pa.nulls(len(new), own.type), pa.nulls(len(new), pa.list_(pa.int32()))], names))
    return rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index. Rows with a term: segment, term, count, postings (word positions in the segment, as steps).

    Each segment also has one row without a term: the ids of its documents and their numbers of words, in order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in X.blocks(batch.column(1), SEGMENT_BYTES):
                yield from _rows_of(segment, block, batch.column(0).slice(block.lo, block.hi - block.lo))
                segment += 1

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return storage.table(rows.mapInArrow(
        run, f"segment bigint, term string, count bigint, postings binary, ids array<{kind}>, sizes array<int>"), "index")


def documents_of(index: DataFrame) -> DataFrame:
    """segment, doc (its number there), id, n_words of every indexed document."""
    return (index.filter("term is null").select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("doc", "d"))
            .select("segment", "doc", F.col("d.ids").alias("id"), F.col("d.sizes").cast("long").alias("n_words")))


@dataclass
class Segment:
    """The postings of one segment for the terms of a search, as one sorted list of (term, position)."""

    terms: dict[str, int]
    keys: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Segment:
        term = rows.column("term").to_pylist()
        at = [k for k, t in enumerate(term) if t is not None]
        lists = [np.cumsum(np.frombuffer(p, np.uint32), dtype=np.int64)
                 for p in rows.column("postings").to_pylist() if p is not None]
        sizes = next(s for s in rows.column("sizes").to_pylist() if s is not None)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        keys = np.concatenate([x + (k << 32) for k, x in enumerate(lists)]) if lists else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return cls({term[k]: n for n, k in enumerate(at)}, keys, bounds, np.repeat(np.arange(len(sizes)), sizes), first)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), bool)
        key = (term << 32) + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0)

    def starts(self, phrases: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every exact occurrence; all phrases are intersected side by side, rarest terms first."""
        known = [k for k, p in enumerate(phrases) if p and all(t in self.terms for t in p)]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array([len(phrases[k]) for k in known])
        term = np.full((len(known), size.max()), -1, np.int64)
        for row, k in enumerate(known):
            term[row, :size[row]] = [self.terms[t] for t in phrases[k]]
        often = np.where(term >= 0, np.diff(self.bounds)[term], np.iinfo(np.int64).max)
        order = np.argsort(often, 1, kind="stable")
        lead = term[np.arange(len(known)), order[:, 0]]
        count = self.bounds[lead + 1] - self.bounds[lead]
        row = np.repeat(np.arange(len(known)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        position = (self.keys[np.repeat(self.bounds[lead], count) + inner] & 0xFFFFFFFF) - order[row, 0]
        for step in range(1, term.shape[1]):
            offset = order[row, step]
            want = term[row, offset]
            keep = want < 0
            keep[~keep] = self.has(want[~keep], position[~keep] + offset[~keep])
            row, position = row[keep], position[keep]
        keep = position >= 0
        row, position = row[keep], position[keep]
        inside = self.doc[position] == self.doc[position + size[row] - 1]
        return np.array(known)[row[inside]], position[inside]

    def near(self, terms: Sequence[str], within: int) -> np.ndarray:
        """Positions (of one of the terms) from which ``within`` words of one document hold every term."""
        if not terms or any(t not in self.terms for t in terms):
            return np.zeros(0, np.int64)
        lists = [self.keys[self.bounds[k]:self.bounds[k + 1]] & 0xFFFFFFFF for k in {self.terms[t] for t in terms}]
        start = np.unique(np.concatenate(lists))
        rarest = min(lists, key=len)
        for x in [rarest, *lists]:
            at = np.searchsorted(x, start)
            start, at = start[at < len(x)], at[at < len(x)]
            end = x[at]
            start = start[(end - start < within) & (self.doc[end] == self.doc[start])]
        return start


def _postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of the index that a search for ``terms`` (a bounded list) needs."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return (index.filter("term is not null").join(F.broadcast(wanted), "term", "left_semi").select("segment", "term", "postings", "sizes")
            .unionByName(index.filter("term is null").select("segment", "term", "postings", "sizes")))


def search(index: DataFrame, phrases: Sequence[Sequence[str]], within: int | None = None) -> DataFrame:
    """Matches of a bounded list of phrases, one row per document that has any: segment, doc, ``found`` (phrase, at).

    ``at`` is the number of the word, from 0, at which the phrase starts; with ``within``, the word from which
    so many words hold all words of the phrase, in any order.
    """
    phrases = [list(p) for p in phrases]

    def run(rows: pa.Table) -> pa.Table:
        s = Segment.of(rows)
        if within is None or not phrases:
            which, at = s.starts(phrases)
        else:
            hits = [(np.full(len(x), k), x) for k, p in enumerate(phrases) for x in [s.near(p, within)]]
            which, at = (np.concatenate(x) for x in zip(*hits))
        doc = s.doc[at]
        order = np.lexsort((which, at))
        which, at, doc = which[order], at[order], doc[order]
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        found = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), pa.StructArray.from_arrays(
            [pa.array(which, pa.int32()), pa.array(at - s.first[doc], pa.int64())], ["phrase", "at"]))
        segment = rows.column("segment")[0].as_py()
        return pa.table({"segment": pa.array([segment] * len(new), pa.int64()), "doc": pa.array(doc[new], pa.int32()), "found": found})

    terms = sorted({t for p in phrases for t in p})
    return _postings(index, terms).groupBy("segment").applyInArrow(
        run, "segment bigint, doc int, found array<struct<phrase:int,at:bigint>>")


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase) for each run of ``size`` words of an item; an item of fewer, but not none, is one phrase."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))
    return own.select("item", F.explode(runs).alias("phrase")).distinct()


def _hits(index: DataFrame, rows: list) -> DataFrame:
    """segment, doc, ``runs`` (first word, end; merged) and ``items`` of the documents that hold phrases of one block."""
    number: dict[tuple, int] = {}
    items: list[list[str]] = []
    for r in rows:
        k = number.setdefault(tuple(r["phrase"]), len(number))
        if k == len(items):
            items.append([])
        if r["item"] is not None:
            items[k].append(r["item"])
    phrases = list(number)
    sent = index.sparkSession.sparkContext.broadcast((phrases, items))  # a block of phrases

    def run(rows: pa.Table) -> pa.Table:
        phrases, items = sent.value
        s = Segment.of(rows)
        which, at = s.starts(phrases)
        size = np.array([len(p) for p in phrases])[which] if len(which) else which
        edge = np.zeros(len(s.doc) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0])
        start = np.concatenate([hit[1:] & (~hit[:-1] | np.concatenate([[True], s.doc[1:] != s.doc[:-1]])), [False]])
        begin = np.flatnonzero(start)
        change = np.flatnonzero(start | ~np.append(hit[1:], False))
        end = change[np.searchsorted(change, begin, "right")] if len(begin) else begin
        doc = np.unique(s.doc[at])
        runs = [[{"first": int(a - s.first[d]), "end": int(b - s.first[d])} for a, b in zip(begin[s.doc[begin] == d], end[s.doc[begin] == d])] for d in doc]
        own = [sorted({i for k in np.unique(which[s.doc[at] == d]) for i in items[k]}) for d in doc]
        return pa.table({"segment": pa.array([rows.column("segment")[0].as_py()] * len(doc), pa.int64()), "doc": pa.array(doc, pa.int32()),
                         "runs": pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                         "items": pa.array(own, pa.list_(pa.string()))})

    terms = sorted({t for p in phrases for t in p})
    return _postings(index, terms).groupBy("segment").applyInArrow(
        run, "segment bigint, doc int, runs array<struct<first:bigint,end:bigint>>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", phrases_at_once: int = PHRASES) -> DataFrame:
    """One row per document: id, n_words, ``runs`` (of words inside occurrences of item windows), ``items`` (ids found).

    A null or empty text has no words. An item without words has no window; the windows of an item with a null id
    count for ``runs``, but it is not listed. Repeated rows are found alike; windows never cross documents. An
    empty table on either side gives rows without runs, or none. Other columns are not read.
    """
    index = build_index(docs, id_col, text_col)
    own = storage.table(windows(items, window, item_id_col), "windows")
    parts = -(-own.count() // phrases_at_once)
    block = F.pmod(F.xxhash64("phrase"), F.lit(max(parts, 1)))
    found = None
    for k in range(parts):
        hits = _hits(index, own.filter(block == k).collect())
        found = hits if found is None else found.union(hits)
    every = documents_of(index)
    if found is None:
        return every.select(F.col("id").alias(id_col), "n_words", F.array().cast("array<struct<first:bigint,end:bigint>>").alias("runs"),
                            F.array().cast("array<string>").alias("items"))
    if parts > 1:
        found = found.groupBy("segment", "doc").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
                                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return (every.join(storage.table(found, "hits"), ["segment", "doc"], "left")
            .select(F.col("id").alias(id_col), "n_words",
                    F.coalesce("runs", F.array().cast("array<struct<first:bigint,end:bigint>>")).alias("runs"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def covered(runs: Column) -> Column:
    """The number of words in sorted runs, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(runs, start, lambda acc, r: F.struct(
        F.greatest(acc["to"], r["end"]).alias("to"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(acc["to"], r["first"]))).alias("n")), lambda acc: acc["n"])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows, with all their columns, of documents that hold no item window. Rows that repeat an id share its fate;
    a row with a null id is judged by its own text."""
    text_col = how.get("text_col", "text")
    # rows travel as one column, so that none of theirs meets another of its name
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                        F.sha2(F.when(F.col(id_col).isNull(), F.col(text_col)), 256).alias("own"))

    def clean(rows: DataFrame, key: str, judged: DataFrame) -> DataFrame:
        """The rows that are not found; those a bitmap of the found ones lets pass are not joined, so not shuffled."""
        bad = contamination(judged, items, window, id_col, **how).filter(F.size("runs") > 0).select(F.col(id_col).alias("bad"))
        bad = storage.table(bad.filter("bad is not null").distinct(), "found")
        stay, doubtful = bitmap.split(rows, [key], bad, ROW_BITS)
        return stay.union(doubtful.join(bad, F.col(key) == F.col("bad"), "left_anti"))

    named = clean(whole.filter("id is not null"), "id", docs)
    nameless = whole.filter("id is null")
    if nameless.isEmpty():
        return named.select("row.*")
    texts = docs.filter(F.col(id_col).isNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.sha2(F.col(text_col), 256).alias(id_col), text_col).distinct()
    return named.union(clean(nameless, "own", texts)).select("row.*")

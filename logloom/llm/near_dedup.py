"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

1. Each document becomes the hash of its shingle set and its band keys. One permutation cuts the hash range
   into bins, the least hash of a bin is its value, and an empty bin borrows from the first filled bin of its own
   fixed random sequence (optimal densification).
2. Documents with equal sets form one class, of which one document goes on.
3. A bucket (documents with one band key) gives a star: every member is paired with the member that shares most
   buckets. Members of a large bucket need not be like its centre, so each is also paired with the next one in
   the order of the further bins, in which those that agree on most come to stand side by side. Both are as many
   pairs as members, however large the bucket, and buckets are cut by ranges, not held.
4. Pairs that agree on far too few bins are dropped (at the threshold so few are about five deviations off, if
   bins were independent), unless one of the sets is very small.
   The best pair of each document is confirmed on the full sets, made anew from the texts; then, of the other
   pairs, those whose documents are not yet connected. Linked documents form components.
5. Where members of a bucket still lie in several components, every pair of members in different components is
   compared by bins. Those alike form clusters, in which every pair in different components is judged on the full
   sets. Both run piece by piece inside tasks, which give out only as many links as there are members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import bitmap, storage
from logloom.llm import text as X
from logloom.llm.graph import components

SHINGLE = 5
PERCENT = 75

#: 42 bands of 3 bins: a pair at 0.75 misses all bands with a probability of about 1e-10.
BANDS, ROWS = 42, 3
BINS = BANDS * ROWS

#: Equal bins that a pair must have: of 126, a pair at 0.75 has 94.5 on average, with a deviation of 4.9.
#: Two shingles in one bin of a very small set shift many bins at once, so sets under FEW shingles need none.
LEAST_EQUAL, FEW = 70, 20

#: Where the orders of a bucket's members begin, in bins after the band.
ORDERS = (ROWS, 8 * ROWS)

#: Rows of a bucket and shingles of a cluster in one part; every two parts are compared in a task of their own.
PART_ROWS, PART_SHINGLES = 2048, 1 << 19

#: Bits a key of the bitmap before a join that decides over whole rows: a row that need not be joined is joined once in so many.
ROW_BITS = 64


def shingle_sets(block: X.Block, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a block; a shorter text is one shingle."""
    w = X.words(block, X.SOLID)
    runs = X.chains(w.hash, size)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= size:
            yield np.unique(runs[a:b - size + 1])
        elif b > a:
            yield X.chains(w.hash[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


@lru_cache(1)
def _donors() -> np.ndarray:
    """For each attempt and bin, the bin to borrow from."""
    n = 4096 * BINS
    return (X.seeds(n, 17) % np.uint64(BINS)).astype(np.int16).reshape(-1, BINS)


_EDGES = np.array([(k << 64) // BINS for k in range(BINS)], np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The densified bin values of a sorted, nonempty set."""
    at = np.append(np.searchsorted(shingles, _EDGES), len(shingles))
    filled = at[:-1] < at[1:]
    values = shingles[np.minimum(at[:-1], len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    for k in range(0, len(_donors()), 64):
        if not len(empty):
            break
        tries = _donors()[k:k + 64, empty]
        ok = filled[tries]
        first = ok.argmax(0)
        found = ok[first, np.arange(len(empty))]
        values[empty[found]] = values[tries[first, np.arange(len(empty))][found]]
        empty = empty[~found]
    values[empty] = shingles[0]  # after thousands of attempts: a bin of the least hash
    return values


def short_bins(values: np.ndarray) -> np.ndarray:
    """One byte of each bin value, by which bins are compared."""
    return (X.mix(values) >> np.uint64(56)).astype(np.uint8)


def places(bins: np.ndarray, band: np.ndarray, order: int) -> np.ndarray:
    """Where members of a bucket stand in an order: half bytes of the sixteen bins from ``order`` after their band on."""
    out = np.zeros(len(band), np.uint64)
    for k in range(16):
        at = (band * ROWS + order + k) % BINS
        out = (out << np.uint64(4)) | (bins[np.arange(len(band)), at] >> 4).astype(np.uint64)
    return out.view(np.int64)


def band_keys(values: np.ndarray) -> np.ndarray:
    out = X.seeds(BANDS, 23)
    for column in values.reshape(BANDS, ROWS).T:
        out = X.mix(out + column)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ``body`` (hash of the text), ``whole`` (hash of the set, null if empty), ``n`` (its size), ``keys``, ``bins``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, sizes, keys, bins = [], [], [], []
            for block in X.blocks(batch.column(2)):
                for s in shingle_sets(block):
                    sizes.append(len(s))
                    whole.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    values = sketch(s) if len(s) else None
                    keys.append(np.zeros(0, np.uint64) if values is None else band_keys(values))
                    bins.append(None if values is None else short_bins(values).tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int32)]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bins, pa.binary())],
                ["id", "body", "whole", "n", "keys", "bins"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, body bigint, whole binary, n bigint, keys array<bigint>, bins binary")


def texts_of(texts: DataFrame, wanted: DataFrame, most_bits: int = bitmap.MOST_BITS) -> DataFrame:
    """node, node_body, text of the rows of ``texts`` (id, body, text) that ``wanted`` (node, node_body) names.

    A broadcast bitmap first lets most other texts stay where they are, so that the join shuffles few texts that no one wants.
    """
    wanted = storage.table(wanted, "wanted")
    texts = bitmap.likely(texts, ["id", "body"], wanted.select("node", "node_body"), most_bits=most_bits)
    return (texts.join(wanted, (texts["id"] == wanted["node"]) & (texts["body"] == wanted["node_body"]))
            .select("node", "node_body", "text"))


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of node ids whose sets are similar enough, judged on the whole texts ``held`` of the nodes.

    Texts meet their pairs by two joins; a node with very many pairs is split by the adaptive skew join, and its pairs
    are read past its text, not held. Rows arrive sorted by ``a``, whose set is made once for all of its pairs in a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, centre = list(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())), batch.column(2)
            good = []
            others = (s for block in X.blocks(batch.column(3)) for s in shingle_sets(block))
            for k, other in enumerate(others):
                if a[k] != last:
                    last = a[k]
                    own = next(shingle_sets(next(X.blocks(centre.slice(k, 1)))))
                small, large = (own, other) if len(own) < len(other) else (other, own)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                good.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    second = pairs.join(held.withColumnRenamed("text", "text_b").drop("node_body"), F.col("b") == F.col("node")).drop("node")
    joined = second.join(held.withColumnRenamed("text", "text_a"), F.col("node") == F.col("a"))
    return joined.select("a", "b", "text_a", "text_b", "node_body").mapInArrow(run, f"a {kind}, b {kind}")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def _alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Equal bins of each pair, 1 at least; 0 where sizes or bins rule the similarity out."""
    equal = (a == b).sum(1)
    possible = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    enough = (equal >= LEAST_EQUAL * percent // PERCENT) | (np.minimum(n_a, n_b) < FEW)
    return np.where(possible & enough, np.maximum(equal, 1), 0)


def _starred(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, equal): each member of a bucket with its centre, the member with the largest weight."""
    kind = rows.schema["node"].dataType.simpleString()
    centre = rows.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "bins")).alias("c"))
    pairs = rows.join(centre, "key").filter("node != c.node").select(
        F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n").alias("n_a"), F.col("n").alias("n_b"),
        F.col("c.bins").alias("bins_a"), F.col("bins").alias("bins_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            equal = _alike(_matrix(x.column(4)), _matrix(x.column(5)), x.column(2).to_numpy(), x.column(3).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(equal, pa.int32())], ["a", "b", "equal"]).filter(pa.array(equal > 0))

    return pairs.mapInArrow(run, f"a {kind}, b {kind}, equal int")


def _neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, equal): each member of a bucket with the next one in every order. Ranges of the orders are tasks; only at
    their borders, which differ between orders, are neighbours not paired."""
    kind = rows.schema["node"].dataType.simpleString()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for x in batches:
            if last is not None:
                x = pa.Table.from_batches([last, x]).combine_chunks().to_batches()[0]
            last = x.slice(len(x) - 1)
            key, node, size, bins, order = x.column(0).to_numpy(), x.column(1), x.column(2).to_numpy(), _matrix(x.column(3)), x.column(4).to_numpy()
            together = (key[1:] == key[:-1]) & (order[1:] == order[:-1])
            equal = np.where(together, _alike(bins[1:], bins[:-1], size[1:], size[:-1], percent), 0)
            yield pa.RecordBatch.from_arrays([node.slice(0, len(x) - 1), node.slice(1), pa.array(equal, pa.int32())],
                                             ["a", "b", "equal"]).filter(pa.array(equal > 0))

    orders = F.posexplode(F.array(*[f"place{k}" for k in range(len(ORDERS))])).alias("order", "place")
    return (rows.select("key", "node", "n", "bins", orders).repartitionByRange(n, "order", "key", "place")
            .sortWithinPartitions("order", "key", "place", "node").mapInArrow(run, f"a {kind}, b {kind}, equal int"))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the place of each row of (node, n, key, band, weight, bins) in every order."""
    names = [f"place{k}" for k in range(len(ORDERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            bins, band = _matrix(x.column("bins")), x.column("band").to_numpy()
            yield pa.RecordBatch.from_arrays([*x.columns, *(pa.array(places(bins, band, o)) for o in ORDERS)], [*x.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields + "".join(f", {n} bigint" for n in names))


def _pieces(rows: DataFrame, group: str) -> DataFrame:
    """Each row of a group of ``parts`` parts once for every part that its own one meets; sorted by (group, i, j)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", "node_body"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")
    return rows.repartition(n, group, "i", "j").sortWithinPartitions(group, "i", "j", "part", "side")


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.RecordBatch]:
    """The rows of one group at a time: those, sorted, that agree in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        if not len(x):
            continue
        names = [x.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(x)]):
            if held and (a or any(held[-1].column(k)[0] != x.column(k)[0] for k in range(keys))):
                yield _one(held)
                held = []
            held.append(x.slice(a, b - a))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _equal(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Equal bins of each of some rows with each of others."""
    if len(one) * len(others) <= 4096:
        return (one[:, None] == others[None]).sum(2)
    out = np.zeros((len(one), len(others)), np.uint8)
    for a, b in zip(np.ascontiguousarray(one.T), np.ascontiguousarray(others.T)):
        out += a[:, None] == b
    return out


def _join(label: np.ndarray, row: int, hits: np.ndarray) -> np.ndarray:
    """Gives the labels of ``hits`` the label of ``row``; one hit of each other label."""
    others, at = np.unique(label[hits], return_index=True)
    at = hits[at[others != label[row]]]
    for old in label[at]:
        label[label == old] = label[row]
    return at


def _spans(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each row that is compared, itself and where those begin that it meets: the rows after it, or the other part."""
    first = int(np.searchsorted(part, part[0], "right"))
    if first < len(part):
        yield from ((k, first) for k in range(first))
    else:
        yield from ((k, k + 1) for k in range(len(part) - 1))


def _clustered(rows: DataFrame, percent: int) -> DataFrame:
    """(node, a, b): the members of buckets that may be like one of another component, with their own component twice;
    and, without a node, components that have such members, as many as connect them."""
    kind = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches):
            if x.column(1)[0] != x.column(2)[0] and x.column(3)[0] == x.column(3)[len(x) - 1]:
                continue  # two parts, of which one is empty
            side = np.unique(x.column(5).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            if not side.any():
                continue
            n, bins, label, alike = x.column(6).to_numpy(), _matrix(x.column(7)), side.copy(), np.zeros(len(x), bool)
            spans, left, right = list(_spans(x.column(3).to_numpy())), [], []
            for k in range(0, len(spans), 256):
                lo = spans[k][1]
                equal = _equal(bins[spans[k][0]:spans[min(k + 256, len(spans)) - 1][0] + 1], bins[lo:])
                for (row, begin), e in zip(spans[k:k + 256], equal):
                    mine, e = n[row], e[begin - lo:]
                    other = n[begin:]
                    hits = np.flatnonzero(((e >= LEAST_EQUAL * percent // PERCENT) | (np.minimum(mine, other) < FEW)) & (side[begin:] != side[row])
                                          & (100 * np.minimum(mine, other) >= percent * np.maximum(mine, other)))
                    if len(hits):
                        alike[row] = alike[hits + begin] = True
                        at = _join(label, row, hits + begin)
                        left += [row] * len(at)
                        right += at.tolist()
            found = np.flatnonzero(alike)
            node = x.column(4).take(pa.array([*found, *[None] * len(left)], pa.int64()))
            yield pa.RecordBatch.from_arrays([node, *(x.column(5).take(pa.array([*found, *k], pa.int64())) for k in (left, right))],
                                             ["node", "a", "b"])

    names = ["key", "i", "j", "part", "node", "side", "n", "bins"]
    return _pieces(rows, "key").select(*names).mapInArrow(run, f"node {kind}, a {kind}, b {kind}")


def _bridges(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that have a pair of members of one cluster similar enough, as many as connect them."""
    kind = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches):
            side = x.column(4)
            label = np.unique(side.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            part = x.column(3).to_numpy()
            if not label.any() or x.column(1)[0] != x.column(2)[0] and part[0] == part[-1]:
                continue
            sets = [s for block in X.blocks(x.column(5)) for s in shingle_sets(block)]
            sizes = np.array([len(s) for s in sets])
            doc = np.repeat(np.arange(len(sets)), sizes)
            _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            common = times[code] > 1
            doc, code = doc[common], code[common]
            first = np.searchsorted(doc, np.arange(len(sets) + 1))
            held, left, right = np.zeros(len(times), bool), [], []
            for row, begin in _spans(part):
                if (label[begin:] == label[row]).all():
                    continue
                own = code[first[row]:first[row + 1]]
                held[own] = True
                both = np.bincount(doc[first[begin]:][held[code[first[begin]:]]] - begin, minlength=len(sets) - begin)
                held[own] = False
                hits = np.flatnonzero(100 * both >= percent * (sizes[row] + sizes[begin:] - both))
                if len(hits):
                    at = _join(label, row, hits + begin)
                    left += [row] * len(at)
                    right += at.tolist()
            yield pa.RecordBatch.from_arrays([side.take(pa.array(left, pa.int64())), side.take(pa.array(right, pa.int64()))], ["a", "b"])

    return _pieces(rows, "cluster").select("cluster", "i", "j", "part", "side", "text").mapInArrow(run, f"a {kind}, b {kind}")


def _remaining(ranked: DataFrame, sides: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of components (``sides`` of the nodes) between members of a bucket, judged pair by pair."""
    # both members of a bucket of two have met
    rows = storage.table(ranked.filter("members > 2").select("key", "node", "node_body", "n", "bins").join(sides, "node"), "rows")
    several = (rows.groupBy("key").agg(F.min("side").alias("least"), F.max("side").alias("most"), F.count("*").alias("rows"))
               .filter("least != most").select("key", F.ceil(F.col("rows") / PART_ROWS).alias("parts")))
    alike = storage.table(_clustered(rows.join(several, "key"), percent).distinct(), "links")
    clusters = components(alike.filter("node is null").select("a", "b")).select(F.col("node").alias("side"), F.col("label").alias("cluster"))
    clusters = alike.filter("node is not null").select("node", F.col("a").alias("side")).join(clusters, "side")
    own = rows.select("node", "node_body", "n").distinct().join(clusters, "node")
    own = storage.table(own, "clusters")
    parts = own.groupBy("cluster").agg(F.ceil(F.sum("n") / PART_SHINGLES).alias("parts"))
    whole = texts_of(texts, own.select("node", "node_body")).groupBy("node", "node_body").agg(F.first("text").alias("text"))
    return _bridges(own.join(parts, "cluster").join(storage.table(whole, "texts"), ["node", "node_body"]), percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if their sets of 5-word shingles overlap to ``percent`` or more of their union; the
    component is the smallest id reachable. A text without words, or null, has no shingles and no links.
    Rows that repeat an id are one document: what any of them is linked with, all are. A row with a null id
    takes no part, has a null component and stays. Other columns are not read.
    """
    sigs = storage.table(signatures(docs, id_col, text_col), "signatures")
    sets = sigs.filter("whole is not null and id is not null")
    classes = storage.table(sets.groupBy("whole").agg(F.min(F.struct("id", "body")).alias("first"), F.count("*").alias("rows")),
                            "classes").select("whole", F.col("first.id").alias("node"), F.col("first.body").alias("node_body"), "rows")
    # one document of each class goes on, most are a class of their own; an id may stand for several of its own texts
    single, rest = bitmap.split(sets, ["whole"], classes.filter("rows > 1").select("whole"))
    named = ["id as node", "body as node_body", "n", "keys", "bins"]
    rest = rest.join(classes.select("whole", "node", "node_body"), "whole").filter("id = node and body = node_body")
    chosen = single.selectExpr(*named).union(storage.table(rest.selectExpr(*named), "firsts"))
    nodes = classes.select("node", "node_body")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))

    entries = chosen.select("node", "node_body", "n", F.posexplode("keys").alias("band", "key"))
    counts = storage.table(entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "counts")
    shared = storage.table(bitmap.likely(entries, ["key"], counts.select("key")).join(counts, "key"), "buckets")
    hubs = storage.table(shared.groupBy("node").agg(F.sum(F.log2("members")).alias("weight")), "hubs")
    bins = bitmap.likely(chosen, ["node"], hubs.select("node")).groupBy("node", "node_body").agg(F.first("bins").alias("bins"))
    hubs = hubs.join(bins, "node")
    ranked = storage.table(_placed(shared.select("node", "node_body", "n", "key", "band", "members").join(hubs, ["node", "node_body"])), "ranked")

    found = _starred(ranked, percent).union(_neighbours(ranked, percent))
    pairs = storage.table(found.filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                          .agg(F.max("equal").alias("equal")), "pairs")

    # texts of one id that differ belong together by definition
    placed = sets.join(classes.select("whole", "node"), "whole").select("id", "node")
    several = placed.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least != most")
    own = placed.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()
    best = F.max(F.struct("equal", "a", "b")).alias("best")
    first = (pairs.select("equal", "a", "b", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(best)
             .select("best.a", "best.b").distinct())
    # every node of a pair has a best pair, so these texts serve both the best pairs and the others
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = storage.table(texts_of(texts, nodes.join(ends, "node", "left_semi")), "texts")
    links = storage.table(confirmed(first, held, percent).union(own), "links")
    labels = components(links)

    def sided(pairs: DataFrame) -> DataFrame:
        """The components of both ends; a document without links is its own."""
        a = labels.withColumnsRenamed({"node": "at_a", "label": "side_a"})
        b = labels.withColumnsRenamed({"node": "at_b", "label": "side_b"})
        return (pairs.join(a, F.col("a") == F.col("at_a"), "left").join(b, F.col("b") == F.col("at_b"), "left")
                .select("a", "b", F.coalesce("side_a", "a").alias("side_a"), F.coalesce("side_b", "b").alias("side_b")))

    apart = sided(pairs).filter("side_a != side_b").select("a", "b")
    rest = storage.table(apart.join(first, ["a", "b"], "left_anti"), "pairs")
    bridges = sided(storage.table(confirmed(rest, held, percent), "links"))
    joined = components(storage.table(bridges.select(F.col("side_a").alias("a"), F.col("side_b").alias("b")), "links"))
    joined = joined.withColumnsRenamed({"node": "side", "label": "whole_side"})
    sides = nodes.select("node").distinct().join(labels, "node", "left").withColumn("side", F.coalesce("label", "node"))
    sides = storage.table(sides.join(joined, "side", "left").select("node", F.coalesce("whole_side", "side").alias("side")), "sides")
    last = components(storage.table(_remaining(ranked, sides, texts, percent).distinct(), "links"))
    last = last.withColumnsRenamed({"node": "at", "label": "whole_side"})
    low = classes.join(sides, "node").join(last, F.col("side") == F.col("at"), "left")
    low = storage.table(low.select("whole", F.coalesce("whole_side", "side").alias("component")), "components")
    return (sigs.join(low, "whole", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, of one document of each component. Of rows that repeat an id one stays,
    by its text; rows with a null id all stay."""
    ids = (near_duplicates(docs, id_col, text_col, percent).select(F.col(id_col).alias("at"), "kept").filter("at is not null")
           .groupBy("at").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")))
    ids = storage.table(ids, "ids")
    # rows travel as one column, so that none of theirs meets another of its name
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # most rows stay unjoined; of the others, those that may stay are looked up
    others, one = ids.filter("rows > 1 or not kept").select("at"), ids.filter("rows = 1 and kept").select("at")
    stay, doubtful = bitmap.split(whole.filter("id is not null"), ["id"], others, ROW_BITS)
    held = storage.table(bitmap.likely(one, ["at"], others, ROW_BITS), "held")
    doubtful = bitmap.likely(doubtful, ["id"], held, ROW_BITS)
    out = stay.union(doubtful.join(held, F.col("id") == F.col("at"), "left_semi")).union(whole.filter("id is null"))
    again = ids.filter("rows > 1 and kept").select("at")
    if not again.isEmpty():
        first = Window.partitionBy("id").orderBy(F.col("text").asc_nulls_last(), F.monotonically_increasing_id())
        several = bitmap.likely(whole.filter("id is not null"), ["id"], again, ROW_BITS).join(again, F.col("id") == F.col("at"), "left_semi")
        out = out.union(several.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place"))
    return out.select("row.*")

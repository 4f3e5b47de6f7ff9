"""A hidden Markov language model, trained by Baum-Welch over all partitions and scored by the forward recursion.

A text is its words and one end token. Latent states emit word classes: the most frequent words are classes of
their own, every other word belongs to one of a fixed number of hashed classes, and the end token is a class. Within
its class a word has its smoothed share, which no state changes, so the model is a distribution over all texts:

    P(text) = P(classes of its tokens) * product over its tokens of P(word | class)

States, transitions and classes have a bounded size and are broadcast. The counts of words have not: they stay a
table, which the words of a text meet by a join. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import storage
from logloom.llm import text as X


@dataclass(frozen=True)
class Settings:
    """The ``heads`` most frequent words have a class each, the others one of ``hashed``. Words that make up at least
    one ``near``-th of all tokens, so that there are at most ``near``, have their counts at hand. Neither bounds the vocabulary."""

    states: int = 6
    heads: int = 4096
    hashed: int = 1024
    near: int = 1 << 20
    #: rounds of the first pass, each on one more slice of the training texts, and Baum-Welch rounds on all of them after it
    first_rounds: int = 8
    rounds: int = 2
    #: pseudo-counts: a transition's, and of all classes together in a state, shared as the classes are frequent
    transition: float = 1.0
    emission: float = 50.0
    seed: int = 5


#: Tokens that are trained on at a time, and of a text in one go when training: its start state is then no longer the text's.
BLOCK_TOKENS, PIECE = 1 << 17, 1 << 11

#: Tokens that are scored at a time. Scoring holds less of each, and a block takes as many steps as its longest text has tokens.
SCORE_TOKENS = 1 << 20

#: Expected counts are summed as whole numbers of this fraction, so that sums do not depend on their order.
_UNIT = 1 << 16

NONE = np.zeros(0, np.int64)


# --- words -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Vocabulary:
    """What is broadcast of the words: the most frequent ones with their counts, and every class with its size."""

    settings: Settings
    near: np.ndarray
    near_counts: np.ndarray
    heads: np.ndarray
    tokens: int
    words: int
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.class_tokens)

    def class_of(self, hashes: np.ndarray) -> np.ndarray:
        """The class of every word: its own, or a hashed one."""
        out = len(self.heads) + hashes.view(np.int64) % self.settings.hashed
        at = np.minimum(np.searchsorted(self.heads, hashes), max(len(self.heads) - 1, 0))
        own = self.heads[at] == hashes if len(self.heads) else np.zeros(len(hashes), bool)
        return np.where(own, at, out)

    def within(self) -> np.ndarray:
        """What a word's log10(count + 1) is lessened by in each class: 0 in all for words with a class of their own."""
        return np.log10(self.class_tokens + self.class_words + 1.0)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The counts of words that are at hand, -1 of others."""
        if not len(self.near):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.near, hashes), len(self.near) - 1)
        return np.where(self.near[at] == hashes, self.near_counts[at], -1)


def _counted(texts: DataFrame) -> DataFrame:
    """(word, n) of a task's words; the sums of all tasks are the caller's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for block in X.blocks(batch.column(0)):
                held.append(X.words(block, X.SOLID).hash)
            words, n = np.unique(np.concatenate(held), return_counts=True) if held else (NONE.astype(np.uint64), NONE)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return texts.mapInArrow(run, "word long, n long")


def vocabulary(training: DataFrame, text_col: str, settings: Settings) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of all training texts, and the table of its words (word, n). The driver gets ``near`` words and the classes."""
    texts = training.select(F.col(text_col).cast("string").alias("text"))
    counts = storage.table(_counted(texts).groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = training.count()
    total = counts.agg(F.sum("n"), F.count("*")).first()
    found = counts.filter(F.col("n") * settings.near >= (total[0] or 0)).toArrow()
    near, n = (found.column(k).to_numpy() for k in ("word", "n"))
    order = np.lexsort((near, -n))
    near, n = near[order], n[order]
    first, rest = near[:settings.heads], counts
    if len(first):
        least, word = int(n[:settings.heads][-1]), int(first[-1])
        rest = counts.filter((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > word)))
    by_hash = np.argsort(near.view(np.uint64))
    heads = np.sort(first.view(np.uint64))
    tokens, words = (np.zeros(len(heads) + settings.hashed + 1, np.int64) for _ in range(2))
    for r in rest.groupBy(F.pmod("word", F.lit(settings.hashed)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        tokens[len(heads) + r.k], words[len(heads) + r.k] = r.n, r.words
    tokens[:len(heads)], tokens[-1] = n[:len(heads)][np.argsort(first.view(np.uint64))], ends
    v = Vocabulary(settings, near[by_hash].view(np.uint64), n[by_hash], heads, (total[0] or 0) + ends, total[1] + (ends > 0), ends, tokens, words)
    if v.classes > 1 << 16:
        raise ValueError("classes are 16-bit numbers")
    return v, counts


def _encoded(docs: DataFrame, vocabulary) -> DataFrame:
    """The texts as classes: row, id, train, ``classes`` (16-bit numbers), what is known at hand, and the words that are not.

    ``n_near`` and ``log_near`` count known tokens and sum log10(count + 1) over words at hand; ``far`` lists the other
    words, each as often as it stands there. ``within`` sums log10 P(word | class) without the log10(count + 1) of ``far``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        less, first_hashed = v.within(), len(v.heads)
        for batch in batches:
            for block in X.blocks(batch.column(3)):
                w = X.words(block, X.SOLID)
                words, place = np.unique(w.hash, return_inverse=True)
                class_, count = v.class_of(words)[place], v.counts(words)[place]
                hashed, at_hand = class_ >= first_hashed, count >= 0
                log = np.where(at_hand, np.log10(np.maximum(count, 0) + 1.0), 0.0)

                def by_document(x: np.ndarray, first=w.first) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(x)])[first])

                bounds = w.first + np.arange(len(w.first))
                classes = np.full(bounds[-1], v.classes - 1, np.uint16)
                ends = np.zeros(bounds[-1], bool)
                ends[bounds[1:] - 1] = True
                classes[~ends] = class_
                far = w.hash[~at_hand].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(block.lo, block.hi - block.lo) for k in range(3)], X.binary_rows(classes, bounds),
                     pa.array(by_document((count > 0).astype(np.int64))), pa.array(by_document(log)),
                     pa.array(by_document(np.where(hashed, log - less[class_], 0.0))),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(np.flatnonzero(~at_hand), w.first).astype(np.int32)), pa.array(far))],
                    ["row", "id", "train", "classes", "n_near", "log_near", "within", "far"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, id {kind}, train boolean, classes binary, n_near long, log_near double, within double,"
                                " far array<long>")


# --- the chain -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Chain:
    """``start`` and ``move`` are probabilities of states, ``emit[c, s]`` of class c in state s."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def stationary(self) -> np.ndarray:
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(64):
            p = p @ self.move
        return p / p.sum()


def first_chain(v: Vocabulary) -> Chain:
    """Sticky states that emit as classes are frequent, each with its own seeded deviations."""
    s = v.settings
    rng = np.random.default_rng(s.seed)
    move = np.full((s.states, s.states), 0.1 / max(s.states - 1, 1))
    np.fill_diagonal(move, 0.9)
    base = (v.class_tokens + 1.0) / (v.class_tokens + 1.0).sum()
    emit = base[:, None] * rng.uniform(0.5, 1.5, (v.classes, s.states))
    return Chain(np.full(s.states, 1 / s.states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from the longest on, where the tokens of every step begin once laid out step by step, and their places before.

    All t-th tokens stand together, in the order of the sequences, so that a step works on slices.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    base = np.concatenate([[0], np.cumsum(live)])
    step = np.repeat(np.arange(len(live)), live)
    return order, base, bounds[:-1][order][np.arange(base[-1]) - base[step]] + step


def forward(classes: np.ndarray, bounds: np.ndarray, chain: Chain) -> np.ndarray:
    """log10 P of every sequence of classes: each step's states are scaled to sum to 1, and the logs of the scales add up."""
    order, base, place = _steps(bounds)
    total, laid, ones = np.zeros(len(order)), classes[place], np.ones(len(chain.start))
    state = np.broadcast_to(chain.start, (len(order), len(ones)))
    for t, (lo, hi) in enumerate(zip(base[:-1].tolist(), base[1:].tolist())):
        state = state[:hi - lo] @ chain.move if t else state[:hi - lo]
        state = state * chain.emit.take(laid[lo:hi], 0)
        scale = state @ ones
        state /= scale[:, None]
        total[:hi - lo] += np.log10(scale)
    out = np.zeros_like(total)
    out[order] = total
    return out


def expected(classes: np.ndarray, bounds: np.ndarray, starts: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected (starts, moves, emissions) of sequences; ``starts`` says which begin with the chain's start, not in its course."""
    states = len(chain.start)
    order, base, place = _steps(bounds)
    laid, steps, ones = classes[place], base.tolist(), np.ones(states)
    emit = chain.emit[laid]
    alpha, scale = np.zeros_like(emit), np.ones(len(laid))
    for t, (lo, hi) in enumerate(zip(steps[:-1], steps[1:])):
        state = alpha[lo:hi]
        if t:
            np.matmul(alpha[steps[t - 1]:steps[t - 1] + hi - lo], chain.move, out=state)
        else:
            state[:] = np.where(starts[order[:hi], None], chain.start, chain.stationary())
        state *= emit[lo:hi]
        np.matmul(state, ones, out=scale[lo:hi])
        state /= scale[lo:hi, None]
    # from here on: what the states emit after a token, scaled alike
    emit /= scale[:, None]
    beta, back = np.ones_like(emit), np.ascontiguousarray(chain.move.T)
    for t in range(len(steps) - 2, 0, -1):
        lo, hi = steps[t], steps[t + 1]
        ahead = emit[lo:hi]
        ahead *= beta[lo:hi]
        np.matmul(ahead, back, out=beta[steps[t - 1]:steps[t - 1] + hi - lo])
    first = steps[1] if len(steps) > 1 else 0
    size = np.diff(base)
    before = np.arange(first, len(laid)) - np.repeat(size[:-1], size[1:])
    moves = alpha[before].T @ emit[first:]
    alpha *= beta
    emitted = np.zeros((len(chain.emit), states))
    for s in range(states):
        emitted[:, s] = np.bincount(laid, alpha[:, s], len(chain.emit))
    return alpha[:first][starts[order[:first]]].sum(0), moves * chain.move, emitted


def _pieces(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of pieces of at most ``PIECE`` tokens, and which of them begin a text."""
    cuts = [np.arange(a, b, PIECE) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    begins = np.concatenate([np.arange(len(c)) == 0 for c in cuts]) if cuts else np.zeros(0, bool)
    return np.concatenate([*cuts, bounds[-1:]]), begins


def _class_blocks(column: pa.Array, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for block in X.blocks(column, 2 * tokens):
        yield block.data.view(np.uint16).astype(np.int64), block.offsets // 2


def _expected(encoded: DataFrame, chain: Chain, v: Vocabulary) -> np.ndarray:
    """The expected counts of all given texts: every partition adds those of its texts, Spark adds the partitions."""
    shared = encoded.sparkSession.sparkContext.broadcast(chain)
    states, classes = len(chain.start), v.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + states + classes, states))
        for batch in batches:
            for sequence, bounds in _class_blocks(batch.column(0), BLOCK_TOKENS):
                cut, begins = _pieces(sequence, bounds)
                start, move, emit = expected(sequence, cut, begins, shared.value)
                total += np.concatenate([start[None], move, emit])
        whole = np.rint(total * _UNIT).astype(np.int64)
        used = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(whole[used, s]) for s in range(states)]],
                                         ["k", *[f"s{s}" for s in range(states)]])

    parts = encoded.select("classes").mapInArrow(run, "k int, " + ", ".join(f"s{s} long" for s in range(states)))
    sums = parts.groupBy("k").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toArrow()
    total = np.zeros((1 + states + classes, states))
    total[sums.column("k").to_numpy()] = np.stack([sums.column(f"s{s}").to_numpy() for s in range(states)], 1) / _UNIT
    return total


def _chain_of(total: np.ndarray, v: Vocabulary) -> Chain:
    states = v.settings.states
    start, move, emit = total[0] + 1, total[1:1 + states] + v.settings.transition, total[1 + states:]
    base = (v.class_tokens + 1.0) / (v.class_tokens + 1.0).sum()
    emit = emit + v.settings.emission * base[:, None]
    return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, v: Vocabulary) -> Chain:
    """Baum-Welch over all training texts.

    The first pass takes them in ``first_rounds`` equal slices and adds each slice's expected counts to those before it,
    so that the states differ sooner; every text is counted once. Each of the ``rounds`` after it counts all texts anew.
    """
    s, chain = v.settings, first_chain(v)
    known = encoded.filter("train")
    if not v.ends:
        return chain
    total = 0
    for k in range(s.first_rounds):
        part = known.filter(F.pmod(F.xxhash64("row", F.lit(s.seed)), F.lit(s.first_rounds)) == k)
        total = total + _expected(part, chain, v)
        chain = _chain_of(total, v)
    for _ in range(s.rounds):
        chain = _chain_of(_expected(known, chain, v), v)
    return chain


# --- scores --------------------------------------------------------------------------------

def score(docs: DataFrame, train_if: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``.

    Learns from the rows where ``train_if`` holds. Tokens are runs of anything but ASCII white space, A-Z lower-cased,
    and one end. ``base_score`` is the log10 probability under single-token counts with one added to each,
    ``score`` that under the hidden Markov model, exact over the whole text. A null text counts as empty: it is one
    end token. Rows are judged one by one, whatever their id (null and repeated ids too). Without any training row
    the base score is 0 and the model is the one it starts from; an empty table has no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(train_if, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    v, counts = vocabulary(rows.filter("train"), "text", settings)
    sc = docs.sparkSession.sparkContext
    encoded = storage.table(_encoded(rows, sc.broadcast(v)), "classes")
    chain = sc.broadcast(train(encoded, v))
    ends = np.log10(v.ends + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, size = [np.zeros(0)], [np.zeros(0, np.int64)]
            for sequence, bounds in _class_blocks(batch.column(2), SCORE_TOKENS):
                total.append(forward(sequence, bounds, chain.value))
                size.append(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (0, 1, 3, 4, 5)], pa.array(np.concatenate(size)),
                                              pa.array(np.concatenate(total))],
                                             ["row", "id", "n_near", "log_near", "within", "n_tokens", "chain"])

    kind = rows.schema["id"].dataType.simpleString()
    chained = encoded.select("row", "id", "classes", "n_near", "log_near", "within").mapInArrow(
        run, f"row long, id {kind}, n_near long, log_near double, within double, n_tokens long, chain double")
    # words that are not at hand: none of them is frequent, so no key is hot
    far = (encoded.select("row", F.explode("far").alias("word")).join(counts, "word").groupBy("row")
           .agg(F.count("*").alias("n_far"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_far")))
    known = F.col("n_near") + F.coalesce("n_far", F.lit(0)) + int(v.ends > 0)
    log_far = F.coalesce("log_far", F.lit(0.0))
    base = F.col("log_near") + log_far + F.lit(float(ends)) - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.words + 1.0)))
    if not v.ends:
        base = F.lit(0.0)
    total = F.col("chain") + F.col("within") + log_far
    return (chained.join(far, "row", "left")
            .select(F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
                    base.alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity")))

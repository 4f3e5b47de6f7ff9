"""The language model, the token alignment and the hard negatives against plain versions, and the odd inputs they must take."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import brute
from llm.test_operators import ODD, prose, table
from logloom.llm import alignment, hard_negatives, hidden_markov, language, perfect_hash
from logloom.llm import text as X

FEW = hidden_markov.Settings(states=3, heads=4, hashed=8, near=32, first_rounds=2, rounds=1)


# language model

def chain(rng, states, classes):
    return hidden_markov.Chain(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states).T)


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 5, n) for n in (1, 6, 3, 1, 7)]
    return lists, np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def test_forward_is_the_sum_over_paths(sequences):
    lists, flat, bounds = sequences
    c = chain(np.random.default_rng(1), 3, 5)
    for got, one in zip(hidden_markov.forward(flat, bounds, c), lists):
        assert 10 ** got == pytest.approx(brute.path_probability(one, c.start, c.move, c.emit), rel=1e-12)


def test_expected_counts_are_those_of_all_paths(sequences):
    lists, flat, bounds = sequences
    c = chain(np.random.default_rng(2), 3, 5)
    got = hidden_markov.expected(flat, bounds, np.ones(len(lists), bool), c)
    each = [brute.path_counts(one, c.start, c.move, c.emit) for one in lists]
    for k in range(3):
        assert np.allclose(got[k], sum(np.array(e[k]) for e in each), rtol=1e-10)


def test_steps_stand_together(sequences):
    lists, flat, bounds = sequences
    order, base, place = hidden_markov._steps(bounds)
    assert sorted(place.tolist()) == list(range(len(flat)))
    for t, (lo, hi) in enumerate(zip(base[:-1], base[1:])):
        assert flat[place[lo:hi]].tolist() == [lists[k][t] for k in order if len(lists[k]) > t]


def test_texts_are_scored_in_few_blocks():
    """A block takes as many steps as its longest text has tokens, so that small blocks repeat them."""
    rng = np.random.default_rng(6)
    c, size = chain(rng, 4, 6), [20_000, *[500] * 900, 0, 20_000]
    bounds = np.concatenate([[0], np.cumsum(size)])
    column = X.binary_rows(rng.integers(0, 6, bounds[-1]).astype(np.uint16), bounds)
    blocks = list(hidden_markov._class_blocks(column, hidden_markov.SCORE_TOKENS))
    assert len(blocks) == 1
    parts = [hidden_markov.forward(*b, c) for b in hidden_markov._class_blocks(column, hidden_markov.BLOCK_TOKENS)]
    assert len(parts) > 3 and np.allclose(hidden_markov.forward(*blocks[0], c), np.concatenate(parts), rtol=1e-12)


def test_long_texts_never_run_out_of_scale():
    c = chain(np.random.default_rng(3), 4, 6)
    n = 30_000
    assert -3 * n < hidden_markov.forward(np.random.default_rng(5).integers(0, 6, n), np.array([0, n]), c)[0] < 0
    cut, begins = hidden_markov._pieces(np.zeros(n, np.int64), np.array([0, n]))
    assert begins.sum() == 1 and np.diff(cut).max() == hidden_markov.PIECE and cut[-1] == n


def base_rows(spark, rows, settings, clash=True):
    out = hidden_markov.score(table(spark, rows, clash), language.remainder(F.col("doc_id"), 7) != 2, settings=settings)
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect()), key=repr), out


@pytest.mark.parametrize("settings", [FEW, hidden_markov.Settings(first_rounds=1, rounds=1)])
def test_base_scores(spark, settings):
    """Odd rows, and words at hand and far away."""
    rng = random.Random(3)
    rows = [*ODD, *[(100 + k, prose(rng, 40, 60)) for k in range(40)]]
    got, out = base_rows(spark, rows, settings)
    assert got == sorted(((i, n, k, total, round(s, 6)) for i, _, n, k, total, s in brute.single_tokens(rows)), key=repr)
    assert all(r.score < 0 for r in out.collect())


def test_model_sums_to_one(spark):
    """All texts of up to one word, and what unseen words and longer texts get, make up a whole."""
    rows = [(k, "a b" if k % 2 else "b c c") for k in range(60)]
    train = table(spark, rows)
    v, _ = hidden_markov.vocabulary(train, "text", FEW)
    assert v.words == 4 and v.tokens == 30 * 2 + 30 * 3 + 60
    c = hidden_markov.first_chain(v)
    assert np.allclose(c.emit.sum(0), 1) and np.allclose(c.move.sum(1), 1)
    # within a hashed class: its words, and one place for words never seen
    assert np.allclose((v.class_tokens + v.class_words) / 10 ** v.within() + 1 / 10 ** v.within(), 1)


def test_states_tell_languages_apart(spark):
    """Texts of one kind of words each: states beat single tokens on held-out texts, one state does not."""
    rng = random.Random(6)
    rows = [(k, " ".join(f"{'xy'[k % 2]}{rng.randrange(40)}" for _ in range(60))) for k in range(400)]
    gain = {}
    for states in (1, 2):
        s = hidden_markov.Settings(states=states, heads=80, hashed=4)
        held = hidden_markov.score(table(spark, rows), F.col("doc_id") % 5 != 0, settings=s).filter("doc_id % 5 = 0").collect()
        gain[states] = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain[2] > 0.2 and abs(gain[1]) < 0.05


def test_model_odd(spark):
    assert hidden_markov.score(table(spark, []), F.lit(True)).count() == 0
    untrained = hidden_markov.score(table(spark, ODD), F.lit(False)).collect()
    assert len(untrained) == len(ODD) and {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}


# token alignment

def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 40, 5000, replace=False)
    h = perfect_hash.build(keys)
    assert sorted(h.places(keys).tolist()) == list(range(5000))
    assert (h.keys[h.places(keys)] == keys).all() and (h.places(np.array([-5, 1 << 41])) == -1).all()
    assert (perfect_hash.build(keys[::-1]).keys == h.keys).all() and len(perfect_hash.build(keys[:0]).keys) == 0


TEXTS = ["  a", "a  b c ", "x\u2581y", "a\n b  \n c", "<|endoftext|> x", "<s> y </s>", "\u00e9\u6f22\u5b57 \u00bd\u2460\ufb01", "a\x00b\x1c c",
         "it's  don't 'll x'", "tab\t t\t\tx", "z" * 3000, "word " * 500, "a\u3000 b\u00a0 c\u2009 d", "\x85 x \x1f y",
         "\U0001F642 \U0001F469\u200d\U0001F469 x", "1234 56,78 9.0", "a\nb\n\nc", "\n"]


def test_alignment(spark):
    rng = random.Random(8)
    rows = [*ODD, *enumerate(TEXTS, 50), *[(200 + k, prose(rng, 30)) for k in range(30)]]
    docs = table(spark, rows, clash=True)
    learned = alignment.learn(docs)
    got = [tuple(r) for r in alignment.align(docs, learned).collect()]
    assert sorted(got, key=repr) == sorted(brute.alignment(rows, alignment.FOLDER), key=repr)
    first, second, links = learned.pairs()
    assert links.sum() == sum(r[4] for r in got) and len(set(zip(first, second))) == len(links)
    assert len(links) <= alignment.most_pairs(alignment.tokenizers(alignment.FOLDER))


def test_alignment_empty(spark):
    none = table(spark, [])
    assert alignment.align(none, alignment.learn(none)).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"the word{k} of\nLine{k % 3} end" for k in range(20)]
    t = alignment.Tokenizers(alignment.FOLDER)
    kept = [t.encode(x) for x in texts]
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    for a, b in zip(kept, [t.encode(x) for x in texts]):
        assert all((x == y).all() for x, y in zip(a, b))


# hard negatives

def mined(spark, rows, every, clash=False, **how):
    schema = "vec_id long, embedding array<double>, label int" + (", id string, a string, v string, c0 string" if clash else "")
    df = spark.createDataFrame([(*r, *["x"] * 4) if clash else r for r in rows], schema)
    return sorted(map(tuple, hard_negatives.mine(df, anchor=F.col("id") % every == 0, **how).collect()))


@pytest.mark.parametrize("first", [50, 8192])
def test_hard_negatives(spark, first):
    """A hot group of equal vectors, a common direction, ties, all in several waves or in one."""
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(k, list(base) if k % 3 == 0 else [b + rng.gauss(0, 1) for b in base] if k % 3 == 1 else [rng.gauss(0, 1) for _ in base],
             rng.randrange(3)) for k in range(900)]
    expected = brute.negatives(rows, 30)
    assert len(expected) > 300 and mined(spark, rows, 30, clash=True, block=64, first=first) == expected


def test_hard_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (1, [1.0, 2.0], 2), (2, [1.0, nan], 1), (3, None, 1), (None, [1.0, 1.0], 1), (4, [0.5], None),
            (5, [], 1), (6, [1.0, None], 1), (100, [-1.0, 0.0], 1), (100, [-1.0, 0.0], 1), (8, [0.9, 2.0], 1), (9, [0.9, 2.0], 3),
            (10, [0.95, 2.0], 3), (11, [3.0, 2.0, 1.0], 2), (200, [0.0, 0.0], 2), (7, [inf, 1.0], 2)]
    assert mined(spark, rows, 100) == brute.negatives(rows, 100)
    assert mined(spark, [], 100) == [] and mined(spark, [(0, [1.0], 1)], 1) == []
    assert mined(spark, [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [9e29, 0.0], 2)], 2)


def test_cells_come_by_falling_bound_that_holds():
    rng = np.random.default_rng(9)
    x = rng.integers(-300, 300, (500, 8))
    halves = hard_negatives._halves(x.astype(float))
    centres = tuple(hard_negatives.codebook(h, 6) for h in halves)
    codes = [hard_negatives._nearest(h, c) for h, c in zip(halves, centres)]
    radii = tuple(np.array([np.sqrt(((h[k == j] - c[j]) ** 2).sum(1)).max(initial=0) for j in range(len(c))])
                  for h, c, k in zip(halves, centres, codes))
    cells = {}
    for cell in zip(*(k.tolist() for k in codes)):
        cells[cell] = cells.get(cell, 0) + 1
    q = rng.integers(-300, 300, 8)
    walk = list(hard_negatives.visit(q, hard_negatives.Index(centres, radii, cells, 8)))
    assert {c for _, _, c in walk} == set(cells) and len(walk) == len(cells)
    assert all(a[0] >= b[0] for a, b in zip(walk, walk[1:]))
    for most, least, cell in walk:
        own = (codes[0] == cell[0]) & (codes[1] == cell[1])
        assert least <= (x[own] @ q).min() and (x[own] @ q).max() <= most


def test_first_pass_counts_every_text_once(spark, monkeypatch):
    """The rounds that tell the states apart take all training texts, also beyond a thousand, and then all again."""
    seen, expected = [], hidden_markov._expected

    def noted(encoded, chain, v):
        seen.append(encoded.count())
        return expected(encoded, chain, v)

    monkeypatch.setattr(hidden_markov, "_expected", noted)
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('a', id % 7, ' b') as text")
    settings = hidden_markov.Settings(states=2, heads=4, hashed=8, near=32, first_rounds=3, rounds=1)
    assert hidden_markov.score(docs, F.col("doc_id") % 3 != 0, settings=settings).count() == 3000
    assert sum(seen[:3]) == 2000 and min(seen[:3]) > 500 and seen[3:] == [2000]

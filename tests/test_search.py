"""Search against SQLite's own full-text index, which the reference semantics come from."""

import random
import sqlite3
import time

import duckdb
import pytest
import regex

from logloom.functions import words as W
from logloom.operators import excerpts, index_segments, search_text
from logloom.operators import search as S
from logloom.sources import testdata as td
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def fts(corpus):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(raw, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, raw) VALUES (?, ?)", corpus)
    return con


@pytest.fixture(scope="module")
def index(spark):
    return S.build_index(td.search_corpus(spark, SF)).cache()


def test_stems_match_sqlite(fts):
    suffixes = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "ational", "tional", "enci", "anci", "izer", "bli",
                "abli", "alli", "entli", "eli", "ousli", "ization", "ation", "ator", "alism", "iveness", "fulness",
                "ousness", "aliti", "iviti", "biliti", "logi", "icate", "ative", "alize", "iciti", "ical", "ful",
                "ness", "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
                "ism", "ate", "iti", "ous", "ive", "ize", "y", "ly", "e", "ll", "yy", "sion", "tion"]
    stems = ["", "a", "or", "order", "hop", "fil", "tann", "by", "yes", "syz", "tr", "controll", "conflat", "troubl",
             "siz", "fall", "hiss", "fizz", "relat", "vow", "box", "say", "toy", "naïv", "éa", "cœur", "ünï", "77", "x7"]
    listed = sorted({a + b for a in stems for b in suffixes if a + b})
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(raw, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, raw) VALUES (?, ?)", list(enumerate(listed)))
    want = {doc: term for term, doc, _, _ in con.execute("SELECT * FROM v")}
    wrong = [(w, want.get(i), W.term(w)) for i, w in enumerate(listed) if want.get(i) != W.term(w)]
    assert not wrong


def test_index_matches_sqlite(index, fts):
    want = {(t, d, o) for t, d, _, o in fts.execute("SELECT * FROM v")}
    got = {(r.term, r.id, p) for r in index.collect() for p in r.positions}
    assert got == want


def cases():
    p = S.phrase
    return [
        ("the", p("the")), ("reti*", p("reti", prefix=True)), ('"the"* "and"*', S.match_spec("the and")),
        ("THE AND reti*", S.all_of(p("THE"), p("reti", prefix=True))), ("the OR les", S.any_of(p("the"), p("les"))),
        ("the NOT with", S.Not(p("the"), p("with"))), ("(the OR les) NOT of", S.Not(S.any_of(p("the"), p("les")), p("of"))),
        ('"of the"', p("of the")), ('"of th" *', p("of th", prefix=True)), ("NEAR(the with)", S.near("the", "with")),
        ("NEAR(the with, 1)", S.near("the", "with", distance=1)), ("NEAR(\"of the\" with from, 3)", S.near("of the", "with", "from", distance=3)),
        ("^the", p("the", first=True)), ("^the*", p("the", prefix=True, first=True)), ('"éaux"*', p("éaux", prefix=True)),
        ("nothingatall", p("nothingatall")), ('"u_99"*', p("u_99", prefix=True)),
    ]


@pytest.mark.parametrize("match,spec", cases(), ids=[c[0] for c in cases()])
def test_matches(spark, index, fts, match, spec):
    want = {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (match,))}
    rows = [r.id for r in S.search(index, spec).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    scanned = S.scan(td.search_corpus(spark, SF), spec)
    assert {r.id for r in scanned.select("id").collect()} == want


def test_rank(spark, index, fts):
    want = dict(fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'the AND reti*'"))
    n, mean = S.corpus_size(td.search_corpus(spark, SF))
    got = {r.id: r.rank for r in S.bm25(index, [S.phrase("the"), S.phrase("reti", prefix=True)], n, mean).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_combine(spark, index, fts):
    """A search with a filter on the row, as SQLite's hits and the rows themselves give it."""
    docs = td.search_corpus(spark, SF)
    host = {r.id: r.host for r in docs.select("id", "host").collect()}
    hits = {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH 'reti* NOT from'")}
    found = S.search(index, S.match_spec("reti* NOT from"))
    chosen = {i for i, h in host.items() if h == "de"}
    for ids, op, want in ((found, "and", hits & chosen), (found, "or", hits | chosen), (found.union(found), "or", hits | chosen)):
        got = [r.id for r in S.combine(docs, ids, F.col("host") == "de", op).select("id").collect()]
        assert sorted(got) == sorted(want)
    assert {r.id for r in S.combine(docs, found).collect()} == hits


TEXTS = ["of the", "the AND with", "the of NOT from", "the NOT from NOT with", "the OR les of", '"of the"', "of + the", '"of th"*', "err* the",
         "NEAR(the with)", 'NEAR("of the" with, 3)', "NEAR(the)", "NEAR the", "^the", "^ the *", "(the OR les) AND of", '"" the', 'the AND ""',
         'NEAR(the "" with)', '"say ""the""" OR of', "the OR of AND with", "reti* OR NEAR(of th* from, 4)", '"--" OR les', "(((the of)))", "THE and or"]
WRONG = ["the AND", "AND the", "(the", "the)", '"the', "the ** of", "NEAR(the, x)", "NEAR(the with", "the, of", "a-b AND c", "^", "()", "the NOT", "+ the", "((the) of)", "the (of)"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_with_operators(spark, index, fts, text):
    """Hits, marks and the same text in SQLite."""
    want = dict(fts.execute("SELECT rowid, highlight(t, 0, '[', ']') FROM t WHERE t MATCH ?", (text,)))
    spec = search_text.read(text)
    found = S.search(index, spec)
    assert {r.id for r in found.collect()} == want.keys()
    shown = excerpts.highlight(td.search_corpus(spark, SF).join(found, "id", "left_semi"), spec, "[", "]")
    assert {r.id: r.marked for r in shown.collect()} == want


@pytest.mark.parametrize("text", WRONG)
def test_texts_that_cannot_be_read(fts, text):
    with pytest.raises(ValueError):
        search_text.read(text)
    with pytest.raises(sqlite3.OperationalError):
        fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (text,)).fetchall()


@pytest.mark.parametrize("text,specs", [('"of the"', ["of the"]), ('"of the" AND from', ["of the", "from"]), ("the reti", ["the", "reti"])])
def test_rank_of_phrases(spark, index, fts, text, specs):
    want = dict(fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (text,)))
    n, mean = S.corpus_size(td.search_corpus(spark, SF))
    got = {r.id: r.rank for r in S.bm25(index, [S.phrase(x) for x in specs], n, mean).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_snippet(text, groups, size):
    """The run of words that shows most, by trying every run that begins with an occurrence."""
    spans = list(regex.finditer(W.WORD, text))
    hits = [[k for k, m in enumerate(spans) if W.term(m[0]) in g] for g in groups]
    best = min(((-sum(any(s <= x < s + size for x in h) for h in hits),
                 max([s, *[min(x for x in h if s <= x < s + size) for h in hits if any(s <= x < s + size for x in h)]]) - s + 1, s)
                for h in hits for s in h), default=(0, 0, 0))
    first = max(0, min(best[2] - (size - best[1]) // 2 if best[1] else 0, len(spans) - size))
    last = min(first + size, len(spans)) - 1
    out, at = ("…" if first else text[:spans[0].start()] if spans else text), None
    for k in range(first, last + 1):
        word = spans[k][0]
        out += (text[at:spans[k].start()] if at is not None else "") + (f"[{word}]" if any(k in h for h in hits) else word)
        at = spans[k].end()
    return out + ("…" if last < len(spans) - 1 else text[at:] if spans else "")


def test_snippets(spark, corpus):
    rows = [*corpus[:60], (900, ""), (901, "!!"), (902, "the"), (903, "  of, the - end. ")]
    lines = spark.createDataFrame(rows, "id long, raw string")
    spec = S.any_of(S.phrase("the"), S.phrase("with"), S.phrase("from"))
    got = {r.id: r.snippet for r in excerpts.snippet(lines, spec, "[", "]", 6).collect()}
    assert got == {i: plain_snippet(t, [{"the"}, {"with"}, {"from"}], 6) for i, t in rows}
    none = excerpts.snippet(spark.createDataFrame([(1, None)], "id long, raw string"), spec, "[", "]").collect()
    assert none[0].snippet is None


def plain_phrase_snippet(words, phrases, size):
    """The same for (words, whether the last is a beginning) over single-spaced words."""
    spans = [[(i, i + len(p) - 1) for i in range(len(words) - len(p) + 1) if words[i:i + len(p) - 1] == p[:-1]
              and (words[i + len(p) - 1].startswith(p[-1]) if prefix else words[i + len(p) - 1] == p[-1])] for p, prefix in phrases]
    best = min(((-sum(any(a <= x and y < a + size for x, y in h) for h in spans),
                 max([b, *[min(y for x, y in h if a <= x and y < a + size) for h in spans if any(a <= x and y < a + size for x, y in h)]]) - a + 1, a)
                for h in spans for a, b in h if b - a < size), default=None)
    first = max(0, min(best[2] - (size - best[1]) // 2 if best else 0, len(words) - size))
    last = min(first + size, len(words)) - 1
    runs = []
    for a, b in sorted(x for h in spans for x in h):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    shown = " ".join("[" * any(a == k for a, _ in runs) + words[k] + "]" * any(b == k for _, b in runs) for k in range(first, last + 1))
    return "…" * (first > 0) + shown + "…" * (last < len(words) - 1)


def test_snippets_of_phrases(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", "ax", "q", "r"], k=rng.randrange(1, 40)))) for k in range(150)]
    spec = S.any_of(S.phrase("a b"), S.phrase("b c a"), S.phrase("b a", prefix=True), S.phrase("r"))
    lines = spark.createDataFrame(rows, "id long, raw string")
    for size in (2, 5):
        got = {r.id: r.snippet for r in excerpts.snippet(lines, spec, "[", "]", size).collect()}
        phrases = [(["a", "b"], False), (["b", "c", "a"], False), (["b", "a"], True), (["r"], False)]
        assert got == {i: plain_phrase_snippet(t.split(), phrases, size) for i, t in rows}


def test_snippet_of_very_many_occurrences(spark):
    n = 12_000
    text = "from x y z u v w t s " * n + "from there"
    lines = spark.createDataFrame([(1, text)], "id long, raw string")
    began = time.monotonic()
    got = excerpts.snippet(lines, S.all_of(S.phrase("from"), S.phrase("ther", prefix=True)), "[", "]", 4).collect()
    assert got[0].snippet == "…t s [from] [there]"
    assert time.monotonic() - began < 30


def test_index_follows_its_lines(spark, tmp_path):
    """Many small batches, removals in between, a line that comes back: always the hits of a full build, from few segments."""
    rng, path, held = random.Random(9), str(tmp_path / "index"), {}
    spec = S.all_of(S.phrase("alpha"), S.phrase("bet", prefix=True))
    for batch in range(18):
        new = {batch * 10 + k: " ".join(rng.choice(["alpha", "beta", "betting", "gamma"]) for _ in range(3)) for k in range(10)}
        if batch == 11:
            new[5] = "alpha beta again"
        index_segments.add(spark.createDataFrame(list(new.items()), "id long, raw string"), path, "run", batch)
        held |= new
        if batch in (3, 10, 12):
            gone = rng.sample(sorted(held), 12) + ([5] if batch == 10 else [])
            index_segments.remove(spark.createDataFrame([(i,) for i in gone], "id long"), path)
            held = {i: t for i, t in held.items() if i not in gone}
        if batch in (2, 12, 17):
            index_segments.add(spark.createDataFrame([(7777, "alpha beta")], "id long, raw string"), path, "run", batch)  # comes again
            got = [r.id for r in S.search(index_segments.opened(spark, path), spec).collect()]
            assert sorted(got) == sorted(i for i, t in held.items() if "alpha" in t and "bet" in t)
    assert index_segments.segments(spark, path) < index_segments.FAN
    assert S.search(index_segments.opened(spark, str(tmp_path / "none")), spec).count() == 0


def test_empty_and_null_lines(spark):
    logs = spark.createDataFrame([(1, None), (2, ""), (3, "--"), (4, "a b a")], "id long, raw string")
    got = [(r.term, r.id, r.positions, r.words) for r in S.build_index(logs).orderBy("id", "term").collect()]
    assert got == [("a", 4, [0, 2], 3), ("b", 4, [1], 3)]


def test_word_pattern():
    assert regex.findall(W.WORD, "a-b_c é́x 12.5") == ["a", "b", "c", "é́x", "12", "5"]


def test_index_for_one_search(spark, index):
    """An index made for a search has the whole index's entries of its words, whatever their case, marks and endings."""
    odd = [(900, "OF The Kelvins, kelvin; Öfing öf ofed"), (901, None), (902, ""), (903, "x")]
    lines = td.search_corpus(spark, SF).select("id", "raw").union(spark.createDataFrame(odd, "id long, raw string"))
    whole = {(r.term, r.id, tuple(r.positions), r.words) for r in S.build_index(lines).collect()}
    for spec in [S.phrase("of the"), S.match_spec("ther* NOT (from OR reti*)"), S.near("kelvins", "of"), S.phrase("kel", prefix=True), S.Phrase(())]:
        atoms = S._atoms(spec)
        got = [(r.term, r.id, tuple(r.positions), r.words) for r in S.build_index(lines, asked=spec).collect()]
        want = {e for e in whole if any(e[0].startswith(t) if prefix else e[0] == t for t, prefix in atoms)}
        assert len(got) == len(want) and set(got) == want


def test_rank_reads_the_index_once(spark):
    """The weights need a first pass over the entries; the ranks come from its result."""
    read = spark.sparkContext.accumulator(0)
    lines = spark.createDataFrame([(i, "of the" + " end" * i) for i in range(9)], "id long, raw string").coalesce(1)
    entries = S.build_index(lines)
    counted = entries.rdd.map(lambda r: read.add(1) or r).toDF(entries.schema)
    assert S.bm25(counted, [S.phrase("of the")], 9, 4.0).count() == 9
    assert read.value == entries.count()


def test_segments_are_joined_without_a_copy_aside(spark, tmp_path, monkeypatch):
    """A batch in one partition is dealt out and written aside once; joining stored segments writes nothing aside."""
    staged, aside = S.staged, []

    def noted(df, name):
        aside.append(df.rdd.getNumPartitions())
        return staged(df, name)

    monkeypatch.setattr(S, "staged", noted)
    path = str(tmp_path / "index")
    for batch in range(index_segments.FAN):
        lines = spark.createDataFrame([(batch * 40 + k, f"alpha w{k}") for k in range(40)], "id long, raw string").coalesce(1)
        index_segments.add(lines, path, "run", batch)
    assert index_segments.segments(spark, path) == 1 and len(aside) == index_segments.FAN and min(aside) > 1
    assert S.search(index_segments.opened(spark, path), S.phrase("alpha")).count() == 40 * index_segments.FAN

"""Queries that SQL cannot express, and the pipeline, against plain versions on the smallest tables."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from llm import brute
from logloom.llm import language, mixing, packing, queries

SF = "/root/testdata/sf0.001"


def rows_of(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return rows_of("documents", "doc_id, text")


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(k) for k in range(1, 14)}
    assert queries.ORACLE.keys() <= queries.QUERIES.keys()


def test_suffix_query(spark, docs):
    got = queries.QUERIES["op3_suffix_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute.repeats(docs, 400))


def test_near_query(spark, docs):
    got = queries.QUERIES["op10_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.near(docs))


def test_secrets_query(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op7_secrets"](spark, SF).collect()}
    for i, t in docs:
        base = brute.base_secrets(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert set(listed.split(",")) - {""} <= set(got[i].spans.split(","))


def test_packing_query(spark, docs):
    out = queries.QUERIES["op6_packing"](spark, SF)
    t = packing.tokenizer(packing.VOCABULARY)
    parts = {}
    for s in packing.segments(out).collect():
        parts.setdefault(s.doc, []).append((s.part, s.tokens))
    for i, text in docs:
        assert t.coder.decode([x for _, p in sorted(parts[i]) for x in p][:-1]) == text


def test_learned_queries(spark, docs):
    lang = dict(rows_of("documents", "doc_id, lang"))
    got = queries.QUERIES["op2_language"](spark, SF).collect()
    held = [lang[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert len(got) == len(docs) and sum(held) > 0.95 * len(held)
    scores = queries.QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(scores) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)


def test_scoring_query(spark, docs):
    """Base scores and counts against plain ones; the model gives held-out texts more than single tokens do."""
    got = queries.QUERIES["op11_lm_scoring"](spark, SF).collect()
    base = {b[0]: b[1:] for b in brute.single_tokens(docs)}
    for r in got:
        held, n, known, total, score = base[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    assert len(got) == len(docs) and sum(r.score - r.base_score for r in got if r.held_out) > 0


def test_alignment_query(spark, docs):
    got = queries.QUERIES["op12_token_alignment"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.alignment(docs, "/opt/tokenizers"))


def test_hard_negatives_query(spark):
    got = queries.QUERIES["op13_hard_negatives"](spark, SF).collect()
    rows = [(i, v, None if l is None else (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows_of("embeddings", "vec_id, embedding, label")]
    expected = brute.negatives(rows, 100)
    assert sorted(map(tuple, got)) == expected and expected


def test_pipeline(spark, docs):
    """Every stage against a plain version over what the stage before it kept."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = table.columns, dict(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "packing"]

    def stage(k, frame):
        out = corpus_pipeline.STAGES[k][1](spark, frame, SF)
        return spark.createDataFrame(out.toArrow())

    table = stage(0, table)
    kept = {r.doc_id: r.text for r in table.collect()}
    assert table.columns == columns and kept.items() <= before.items()
    assert {i for i in before if i not in kept} == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}

    near = brute.near(list(kept.items()))
    table = stage(1, table)
    kept = {r.doc_id: r.text for r in table.collect()}
    assert table.columns == columns and set(kept) == {c for _, _, c in near}

    found = brute.contamination(list(kept.items()), rows_of("benchmark", "item_id, text"))
    table = stage(2, table)
    kept = {r.doc_id: r.text for r in table.collect()}
    assert table.columns == columns and set(kept) == {f[0] for f in found if not f[5]}

    expected = {r.doc_id: r.taken // r.size for r in mixing.mix(table).collect() if r.size}
    table = stage(3, table)
    times = {}
    for r in table.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert table.columns == columns and times == {i: n for i, n in expected.items() if n}

    t = packing.tokenizer(packing.VOCABULARY)
    tokens = {}
    for s in packing.segments(stage(4, table)).collect():
        tokens.setdefault(s.doc, []).extend(s.tokens)
    for i, n in times.items():
        assert sorted(tokens[i]) == sorted([*t.coder.encode_ordinary(kept[i]), t.end] * n)
    assert set(tokens) == set(times)


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids" in out.columns


def test_stages_take_odd_rows(spark):
    """Null, empty and repeated rows, and columns with the names that stages use themselves, through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id long, row string, id string, bad long, at string, rows long"
    prose = " ".join(f"word{k}" for k in range(30))
    own = [(1, prose, "xx", "s"), (1, prose, "xx", "s"), (2, prose, None, None), (3, None, "xx", "s"), (4, "", "xx", "s"), (None, "zzz " + prose, "xx", "t"),
           (None, None, None, None), (5, "123 !", "xx", "s"), (6, "other words here " * 9, "xx", "t")]
    docs = spark.createDataFrame([(*r, 1, 2, "r", "i", 3, "a", 4) for r in own], schema)
    for rows in (docs, docs.limit(0)):
        table = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = spark.createDataFrame(stage(spark, table, SF).toArrow().to_pylist(), schema)
            assert table.columns == docs.columns
            kept = [(r.doc_id, r.text) for r in table.collect()]
            assert None not in {t for _, t in kept} and (not kept) == (rows is not docs)
            if name == "near_duplicates" and kept:
                assert sorted(kept, key=repr) == sorted([(1, prose), (6, "other words here " * 9), (None, "zzz " + prose)], key=repr)
        assert (corpus_pipeline.STAGES[-1][1](spark, table, SF).count() > 0) == (rows is docs)


def test_profiles_do_not_use_other_columns(spark):
    one = spark.createDataFrame([(1, "abc def", "xx", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    assert language.fit(one).languages == ("xx",)

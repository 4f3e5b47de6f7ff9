"""Registered full-text queries over whole documents.

The SQL side has no stemmer, so its word classes are spelled out: a prefix that no stemming
step can reach into, or a stem with every form of it. Unit tests compare all of search with
SQLite's index.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import excerpts as X
from logloom.operators import search as S
from logloom.session import scratch_path
from logloom.sources import testdata as td
from logloom.sources.files import spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

WORDS = (f"WITH {td.SQL_CORPUS}, w AS (SELECT id, service, host, raw,"
         " regexp_extract_all(strip_accents(lower(raw)), '[\\p{L}\\p{N}]+') AS ws FROM corpus)")


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def _corpus(spark, sf_dir):
    return spread(td.search_corpus(spark, sf_dir))


def _search(spec):
    return lambda spark, sf_dir: S.search(S.build_index(_corpus(spark, sf_dir)), spec)


def _has(pattern: str) -> str:
    return f"len(list_filter(ws, lambda x: regexp_full_match(x, '{pattern}'))) > 0"


def _at(i: str, pattern: str) -> str:
    return f"regexp_full_match(ws[{i}], '{pattern}')"


# Word classes, as the stemmer groups them in the documents.
THE, OF, FROM, WITH_ = "thes?", "of", "from", "with"
REWH = "rewh(es|ed|ing)?"

_add("fts_term", _search(S.phrase("rewhing")), f"{WORDS} SELECT id FROM w WHERE {_has(REWH)}")
_add("fts_prefix", _search(S.match_spec("ther")), f"{WORDS} SELECT id FROM w WHERE {_has('ther.*')}")
_add("fts_bar", _search(S.match_spec("  Ther reti ")),
     f"{WORDS} SELECT id FROM w WHERE {_has('ther.*')} AND {_has('reti.*')}")
_add("fts_bool",
     _search(S.Not(S.any_of(S.all_of(S.phrase("of"), S.phrase("ther", prefix=True)), S.phrase("reti", prefix=True)),
                   S.phrase("from"))),
     f"{WORDS} SELECT id FROM w WHERE (({_has(OF)} AND {_has('ther.*')}) OR {_has('reti.*')}) AND NOT {_has(FROM)}")
_add("fts_phrase", _search(S.phrase("of the")),
     f"{WORDS} SELECT id FROM w WHERE list_contains(list_transform(range(1, len(ws)),"
     f" lambda i: {_at('i', OF)} AND {_at('i + 1', THE)}), true)")
_add("fts_phrase_prefix", _search(S.phrase("of th", prefix=True)),
     f"{WORDS} SELECT id FROM w WHERE list_contains(list_transform(range(1, len(ws)),"
     f" lambda i: {_at('i', OF)} AND {_at('i + 1', 'th.*')}), true)")
_add("fts_first", _search(S.phrase("the", first=True)), f"{WORDS} SELECT id FROM w WHERE {_at('1', THE)}")
_add("fts_near", _search(S.near("with", "from", distance=3)),
     f"{WORDS}, p AS (SELECT id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w)"
     " SELECT DISTINCT a.id FROM p a JOIN p b ON a.id = b.id AND abs(a.i - b.i) <= 4 WHERE a.x = 'with' AND b.x = 'from'")


def _with_filter(op):
    def run(spark, sf_dir):
        docs = _corpus(spark, sf_dir)
        hits = S.search(S.build_index(docs), S.match_spec("ther"))
        pred = (F.col("service") == "src3") if op == "or" else (F.col("host") == "en")
        return S.combine(docs, hits, pred, op).select("id", "service", "host", F.length("raw").cast("long").alias("chars"))
    return run


_add("fts_and_filter", _with_filter("and"),
     f"{WORDS} SELECT id, service, host, CAST(length(raw) AS BIGINT) AS chars FROM w WHERE {_has('ther.*')} AND host = 'en'")
_add("fts_or_filter", _with_filter("or"),
     f"{WORDS} SELECT id, service, host, CAST(length(raw) AS BIGINT) AS chars FROM w"
     f" WHERE {_has('ther.*')} OR service = 'src3'")


def _stored(spark, sf_dir):
    """The index as a table: the term predicate reaches the Parquet scan."""
    path = scratch_path(spark, "index")
    S.write_index(S.build_index(_corpus(spark, sf_dir)), path)
    return S.search(spark.read.parquet(path), S.all_of(S.phrase("of"), S.phrase("ther", prefix=True)))


_add("fts_stored_index", _stored, f"{WORDS} SELECT id FROM w WHERE {_has(OF)} AND {_has('ther.*')}")


def _ranked(spark, sf_dir):
    docs = _corpus(spark, sf_dir)
    n, mean = S.corpus_size(docs)
    asked = [S.phrase("from"), S.phrase("ther", prefix=True)]
    ranked = S.bm25(S.build_index(docs, asked=S.all_of(*asked)), asked, n, mean)
    return ranked.select("id", F.round("rank", 6).alias("rank"))


_F = "(f / (f + 1.2 * (0.25 + 0.75 * n / mean))) * 2.2"
_add("fts_rank", _ranked,
     f"{WORDS}, c AS (SELECT id, len(ws) AS n, CAST(len(list_filter(ws, lambda x: x = 'from')) AS DOUBLE) AS a,"
     " CAST(len(list_filter(ws, lambda x: x LIKE 'ther%')) AS DOUBLE) AS b FROM w),"
     " t AS (SELECT COUNT(*) AS docs, AVG(n) AS mean, COUNT(*) FILTER (WHERE a > 0) AS da,"
     " COUNT(*) FILTER (WHERE b > 0) AS db FROM c),"
     " s AS (SELECT mean, greatest(ln((docs - da + 0.5) / (da + 0.5)), 1e-6) AS ia,"
     " greatest(ln((docs - db + 0.5) / (db + 0.5)), 1e-6) AS ib FROM t)"
     " SELECT id, ROUND(-(ia * " + _F.replace("(f ", "(a ").replace("(f /", "(a /").replace("(f +", "(a +")
     + " + ib * " + _F.replace("(f ", "(b ").replace("(f /", "(b /").replace("(f +", "(b +")
     + "), 6) AS rank FROM c, s WHERE a > 0 AND b > 0")
_add("fts_scan",
     lambda s, d: S.scan(_corpus(s, d), S.all_of(S.phrase("of the"), S.match_spec("ther"))).select("id"),
     f"{WORDS} SELECT id FROM w WHERE {_has('ther.*')} AND list_contains(list_transform(range(1, len(ws)),"
     f" lambda i: {_at('i', OF)} AND {_at('i + 1', THE)}), true)")
_add("fts_highlight",
     lambda s, d: S.combine(_corpus(s, d), S.search(S.build_index(_corpus(s, d)), S.match_spec("inor")))
     .select("id", F.md5(S.highlight(F.col("raw"), "inor", "[", "]")).alias("marked")),
     f"{WORDS} SELECT id, md5(regexp_replace(raw, '(^|[^\\p{{L}}\\p{{N}}])(inor[\\p{{L}}\\p{{N}}]*)', '\\1[\\2]', 'gi'))"
     f" AS marked FROM w WHERE {_has('inor.*')}")
_add("fts_like_scan", lambda s, d: S.like_scan(td.search_corpus(s, d), "THERRE").select("id"),
     f"WITH {td.SQL_CORPUS} SELECT id FROM corpus WHERE raw ILIKE '%THERRE%'")


def _vocabulary(spark, sf_dir):
    """What the index holds of each line, whatever its terms stem to: occurrences, and the sum of their positions."""
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda n, p: n + p)
    return (S.build_index(_corpus(spark, sf_dir)).groupBy("id")
            .agg(F.sum(F.size("positions")).alias("hits"), F.sum(places).alias("places")))


_add("fts_vocabulary", _vocabulary,
     f"{WORDS} SELECT id, CAST(len(ws) AS BIGINT) AS hits, CAST(len(ws) * (len(ws) - 1) // 2 AS BIGINT) AS places FROM w WHERE len(ws) > 0")


# --- operators written as text, and what was found shown in the line ------------------------------

def _text(search: str):
    return lambda spark, sf_dir: S.search(S.build_index(_corpus(spark, sf_dir)), S.match_spec(search))


_OF_THE = f"list_contains(list_transform(range(1, len(ws)), lambda i: {_at('i', OF)} AND {_at('i + 1', THE)}), true)"
for _name, _search_text, _sql in [
        ("and", "of AND ther*", f"{_has(OF)} AND {_has('ther.*')}"),
        ("beside", "of ther* reti*", f"{_has(OF)} AND {_has('ther.*')} AND {_has('reti.*')}"),
        ("or", "rewhed OR reti *", f"{_has(REWH)} OR {_has('reti.*')}"),
        ("not", "of NOT from NOT with", f"{_has(OF)} AND NOT {_has(FROM)} AND NOT {_has(WITH_)}"),
        ("phrase", '"of the" OR "no such words"', _OF_THE),
        ("sum", "of + th *", f"list_contains(list_transform(range(1, len(ws)), lambda i: {_at('i', OF)} AND {_at('i + 1', 'th.*')}), true)"),
        ("first", "^the", _at("1", THE)),
        ("brackets", "(of OR from) AND (ther* OR reti*)", f"({_has(OF)} OR {_has(FROM)}) AND ({_has('ther.*')} OR {_has('reti.*')})"),
        ("order", "from OR of AND ther* NOT with", f"{_has(FROM)} OR ({_has(OF)} AND {_has('ther.*')} AND NOT {_has(WITH_)})")]:
    _add(f"fts_text_{_name}", _text(_search_text), f"{WORDS} SELECT id FROM w WHERE {_sql}")
_add("fts_text_near", _text("NEAR(with from, 3)"),
     f"{WORDS}, p AS (SELECT id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w)"
     " SELECT DISTINCT a.id FROM p a JOIN p b ON a.id = b.id AND abs(a.i - b.i) <= 4 WHERE a.x = 'with' AND b.x = 'from'")


def _ranked_phrase(spark, sf_dir):
    docs = _corpus(spark, sf_dir)
    n, mean = S.corpus_size(docs)
    asked = S.phrase("of the")
    return S.bm25(S.build_index(docs, asked=asked), [asked], n, mean).select("id", F.round("rank", 6).alias("rank"))


_add("fts_rank_phrase", _ranked_phrase,
     f"{WORDS}, c AS (SELECT id, len(ws) AS n, CAST(len(list_filter(range(1, len(ws)), lambda i: {_at('i', OF)} AND {_at('i + 1', THE)}))"
     " AS DOUBLE) AS f FROM w), t AS (SELECT COUNT(*) AS docs, AVG(n) AS mean, COUNT(*) FILTER (WHERE f > 0) AS held FROM c)"
     f" SELECT id, ROUND(-(greatest(ln((docs - held + 0.5) / (held + 0.5)), 1e-6) * {_F}), 6) AS rank FROM c, t WHERE f > 0")


def _shown(spec, how):
    def run(spark, sf_dir):
        docs = _corpus(spark, sf_dir)
        return how(S.combine(docs, S.search(S.build_index(docs, asked=spec), spec)), spec)
    return run


_PIECES = (f"{WORDS}, o AS (SELECT *, regexp_extract_all(raw, '[\\p{{L}}\\p{{N}}]+') AS rw,"
           " regexp_split_to_array(raw, '[\\p{L}\\p{N}]+') AS g FROM w)").replace("\\\\", "\\")


def _between(first: str, last: str, hit: str) -> str:
    return (f"list_aggregate(list_transform(range({first}, {last} + 1), lambda i: CASE WHEN i > {first} THEN g[i] ELSE '' END"
            f" || CASE WHEN {hit} THEN '[' || rw[i] || ']' ELSE rw[i] END), 'string_agg', '')")


_add("fts_highlight_stem",
     _shown(S.phrase("rewhing"), lambda df, spec: X.highlight(df, spec, "[", "]").select("id", F.md5("marked").alias("marked"))),
     f"{_PIECES} SELECT id, md5(g[1] || {_between('1', 'len(rw)', _at('i', REWH))} || g[len(rw) + 1]) AS marked FROM o WHERE {_has(REWH)}")
_PLACES = "list_filter(range(1, len(ws) + 1), lambda i: {})"
_add("fts_snippet",
     _shown(S.all_of(S.phrase("from"), S.phrase("ther", prefix=True)),
            lambda df, spec: X.snippet(df, spec, "[", "]", 8).select("id", "snippet")),
     f"{_PIECES}, h AS (SELECT *, {_PLACES.format(_at('i', FROM))} AS a, {_PLACES.format(_at('i', 'ther.*'))} AS b"
     f" FROM o WHERE {_has(FROM)} AND {_has('ther.*')}),"
     " c AS (SELECT *, unnest(list_concat(a, b)) AS s FROM h),"
     " k AS (SELECT *, list_filter(a, lambda x: x >= s AND x < s + 8) AS ia, list_filter(b, lambda x: x >= s AND x < s + 8) AS ib FROM c),"
     " v AS (SELECT *, greatest(s, coalesce(list_min(ia), 0), coalesce(list_min(ib), 0)) - s + 1 AS width,"
     " CASE WHEN len(ia) > 0 AND len(ib) > 0 THEN 0 ELSE 1 END AS lacks FROM k),"
     " f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lacks, width, s) AS place FROM v),"
     " p AS (SELECT *, greatest(1, least(s - (8 - width) // 2, len(ws) - 7)) AS lo FROM f WHERE place = 1),"
     " q AS (SELECT *, least(lo + 7, len(ws)) AS hi FROM p)"
     f" SELECT id, CASE WHEN lo > 1 THEN '…' ELSE g[1] END || {_between('lo', 'hi', _at('i', FROM) + ' OR ' + _at('i', 'ther.*'))}"
     " || CASE WHEN hi < len(ws) THEN '…' ELSE g[len(ws) + 1] END AS snippet FROM q")

HEADLINE = ["fts_prefix", "fts_phrase", "fts_or_filter", "fts_vocabulary"]

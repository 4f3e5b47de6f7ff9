"""The registered queries of this subpackage, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (alignment, exact_dedup, hard_negatives, hidden_markov, language, mixing, near_dedup, packing, phrase_index,
                         secrets, suffix_dedup, toxicity, warc)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_exact_dedup", """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)""")
def exact_duplicates(spark, sf_dir):
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


@query("op2_language")
def languages(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    rest = language.remainder(F.col("doc_id"), 3)
    profiles = language.fit(docs.filter(rest != 1))
    out = language.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op7_secrets")
def found_secrets(spark, sf_dir):
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents"))

    def of(kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(listed(of(secrets.KINDS[:3])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op8_toxicity")
def toxic(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    rest = language.remainder(F.col("doc_id"), 5)
    model = toxicity.fit(docs.select("doc_id", "text"), labels.filter(rest != 0))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_mixing", """
WITH d AS (SELECT doc_id, source,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
k AS (SELECT *, sum(source_size) OVER (ORDER BY source_size / weight, source ROWS UNBOUNDED PRECEDING) AS filled,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / weight, source ROWS UNBOUNDED PRECEDING) AS free,
             1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS goal FROM r),
levels AS (SELECT goal / sum(weight) OVER () AS level, -1.0 AS at_ratio FROM k
           UNION ALL SELECT (goal - 2::DOUBLE * CAST(filled AS DOUBLE)) / CAST(free AS DOUBLE), 2.0 * source_size / weight FROM k WHERE free > 0),
level AS (SELECT max(level) AS level FROM levels WHERE at_ratio <= level),
t AS (SELECT source, source_size, least(level * weight, 2::DOUBLE * source_size) AS target FROM r, level),
c AS (SELECT doc_id, size, source_size, target, target / nullif(source_size, 0) AS rate,
             CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(coalesce(rate, 0)) + CASE WHEN u < coalesce(rate, 0) - floor(coalesce(rate, 0)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""")
def mixed(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


@query("op10_near_dedup")
def near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


@query("op4_decontamination", """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark),
p AS (SELECT DISTINCT item, w[i:i + 9] AS phrase FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM p),
runs AS (SELECT r, n, i, w[i:i + n - 1] AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, item, i, n FROM runs JOIN p USING (phrase)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM m) WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""")
def contaminated(spark, sf_dir):
    found = phrase_index.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    hit = phrase_index.covered(F.col("runs"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query("op5_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h),
b AS (SELECT *, list_transform(range(1, 37, 5), lambda i: CAST('0x' || substr(hex, i, 5) AS INTEGER)) AS fives FROM g)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(flatten(list_transform(fives, lambda x: [x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31])),
         lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', d + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b""")
def archived(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    return warc.archive_index(pages).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.when(F.col("intact"), F.col("type")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"))


@query("op6_packing")
def packed(spark, sf_dir):
    return packing.packed(_read(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def without_repeats(spark, sf_dir):
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_lm_scoring")
def language_model(spark, sf_dir):
    rest = language.remainder(F.col("doc_id"), 7)
    out = hidden_markov.score(_read(spark, sf_dir, "documents"), rest != 2)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


@query("op12_token_alignment")
def token_alignment(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    out = alignment.align(docs, alignment.learn(docs))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.col("groups").alias("groups_sha256"))


@query("op13_hard_negatives", """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT DISTINCT a.id AS anchor_id, b.id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def mined_negatives(spark, sf_dir):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), anchor=F.col("id") % 100 == 0, label=noisy)

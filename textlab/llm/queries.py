"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        LLM_QUERIES[fn.__name__] = fn
        if sql is not None:
            LLM_ORACLE[fn.__name__] = sql
        return fn
    return add


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import balanced_shards
    return balanced_shards(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query()
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import MODEL, piece_ids
    return piece_ids(read_table(spark, sf_dir, "documents"), vocabulary(MODEL))


@query(r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups
    return exact_groups(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import TOKENIZER, packed_pieces
    return packed_pieces(read_table(spark, sf_dir, "documents"), vocabulary(TOKENIZER)).drop("loss_tokens")


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_report
    return line_report(read_table(spark, sf_dir, "documents"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf import learn_chain, quality_verdicts
    docs = read_table(spark, sf_dir, "documents")
    return quality_verdicts(docs, learn_chain(docs, read_table(spark, sf_dir, "labels")), "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_pages
    return extract_pages(read_table(spark, sf_dir, "pages"))


@query(r"""
WITH RECURSIVE
poly(byte, step, crc) AS (
  SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END
  FROM poly WHERE step < 8),
tab AS (SELECT list(crc ORDER BY byte) AS t FROM poly WHERE step = 8),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
dw AS (SELECT r, unnest(words) AS word FROM d),
vocab AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM b)),
hashed AS (
  SELECT word, xor(list_reduce(
    list_transform(range(0, length(hex(encode(word))) // 2),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::UBIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket
  FROM vocab, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gain AS (
  SELECT k AS bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (totals.s + 10000)
    / ((coalesce(s.n, 0)::DOUBLE + 1) * (totals.t + 10000))))::BIGINT AS gain
  FROM range(10000) g(k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k, totals),
w AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
noise AS (
  SELECT d.r, doc_id, coalesce(w.n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))
      ::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w ON d.r = w.r),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM noise WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= 10 * n // 100 THEN place END AS "rank"
FROM noise LEFT JOIN placed USING (r)
""")
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import importance_resample
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query(r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, 'spam|casino|viagra|pills|porn|warez|adserver') THEN 'block'
  WHEN starts_with(path, '/wp-admin/') OR contains(path, '/cgi-bin/') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
""")
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import url_verdicts
    return url_verdicts(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query(r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INT AS "rank",
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY "rank" <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives, relabelled, usable
    rows = usable(relabelled(read_table(spark, sf_dir, "embeddings")))
    return hard_negatives(rows, F.col("id") % 100 == 0)

"""Preparation queries: casts, null handling, joins of the official split,
stratified split, de-duplication, samples, leakage, class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS
from ..functions.labels import NUMBER_PATTERN, coerce_id, parse_multilabel, strict_cast
from ..functions.text import clean_text, text_hash
from ..operators import prep as PR
from ..sources import driver as D
from .registry import query
from .sqlparts import DEV, FILED, PARA, clean_of, lit, y_of

_URL_ID = r"/([^/?#]+)(?:[?#]|$)"


_RAW = f"trim(regexp_extract(url, '{_URL_ID}', 1))"


@query("coerce_ids", f"""
SELECT page_id, regexp_extract(url, '{_URL_ID}', 1) AS raw_id,
       coalesce(CASE WHEN regexp_matches({_RAW}, '^[+-]?[0-9]+$') THEN TRY_CAST({_RAW} AS BIGINT) END,
                CASE WHEN regexp_matches({_RAW}, {lit(NUMBER_PATTERN)})
                     THEN TRY_CAST(trunc(TRY_CAST({_RAW} AS DOUBLE)) AS BIGINT) END) AS id
FROM pages""")
def q_coerce_ids(spark, sf):
    raw = F.regexp_extract("url", _URL_ID, 1)
    return D.table(spark, sf, "pages").select("page_id", raw.alias("raw_id"), coerce_id(raw).alias("id"))


@query("strict_cast", f"""
WITH {DEV}
SELECT pos, CAST(CAST(par_id AS VARCHAR) AS BIGINT) AS par_id FROM dev""")
def q_strict_cast(spark, sf):
    dev = D.dev_labels(spark, sf)
    return dev.select("pos", strict_cast(F.col("par_id").cast("string"), "bigint").alias("par_id"))


@query("parse_multilabel", f"""
WITH {DEV}
SELECT par_id, label, CAST(coalesce(regexp_matches(label, '[1-9]'), false) AS INTEGER) AS binary_label FROM dev""")
def q_parse_multilabel(spark, sf):
    return D.dev_labels(spark, sf).select("par_id", "label", parse_multilabel("label").alias("binary_label"))


@query("drop_missing", f"""
WITH {PARA}
SELECT par_id, label FROM para WHERE text IS NOT NULL AND label IS NOT NULL""")
def q_drop_missing(spark, sf):
    return PR.drop_missing(D.paragraphs(spark, sf)).select("par_id", "label")


# of a repeated id the first of the file
_TEXTS = f"""tx AS (SELECT par_id, {clean_of("coalesce(arg_min(text, pos), '')")} AS text FROM filed GROUP BY par_id)"""


@query("official_train", f"""
WITH {PARA}, {DEV}
SELECT par_id, label FROM para WHERE par_id NOT IN (SELECT par_id FROM dev)""")
def q_official_train(spark, sf):
    return PR.official_train(D.paragraphs(spark, sf, with_text=False), D.dev_labels(spark, sf)) \
        .select("par_id", "label")


@query("official_dev", f"""
WITH {PARA}, {FILED}, {DEV}, {_TEXTS}
SELECT dev.pos, dev.par_id, coalesce(tx.text, '') AS text,
       CAST(coalesce(regexp_matches(dev.label, '[1-9]'), false) AS INTEGER) AS label
FROM dev LEFT JOIN tx ON dev.par_id = tx.par_id""")
def q_official_dev(spark, sf):
    return PR.official_dev(D.dev_labels(spark, sf), D.filed_paragraphs(spark, sf))


@query("fill_text", f"""
WITH {PARA}, {FILED}, {DEV}, {_TEXTS}
SELECT dev.pos, dev.par_id, coalesce(tx.text, '') AS text FROM dev LEFT JOIN tx ON dev.par_id = tx.par_id""")
def q_fill_text(spark, sf):
    dev = D.dev_labels(spark, sf)
    texts = PR.text_by_id(D.filed_paragraphs(spark, sf).join(dev.select("par_id"), "par_id", "left_semi"))
    return PR.fill_text(dev.join(texts, "par_id", "left").select("pos", "par_id", "text"))


@query("strict_lookup", f"""
WITH {PARA}, {FILED}, {DEV}
SELECT dev.pos, dev.par_id, {clean_of('p.text')} AS text
FROM dev JOIN (SELECT par_id, arg_max(text, pos) AS text FROM filed GROUP BY par_id) p ON dev.par_id = p.par_id""")
def q_strict_lookup(spark, sf):
    return PR.strict_lookup(D.dev_labels(spark, sf), D.filed_paragraphs(spark, sf))


@query("official_split", f"""
WITH {PARA}, {FILED}, {DEV}, {_TEXTS}
SELECT 'train' AS split, p.par_id, {clean_of('p.text')} AS text, {y_of('p.label')} AS label
FROM para p WHERE p.text IS NOT NULL AND p.label IS NOT NULL AND p.par_id NOT IN (SELECT par_id FROM dev)
UNION ALL
SELECT 'dev', dev.par_id, coalesce(tx.text, ''),
       CAST(coalesce(regexp_matches(dev.label, '[1-9]'), false) AS INTEGER)
FROM dev LEFT JOIN tx ON dev.par_id = tx.par_id""")
def q_official_split(spark, sf):
    return PR.official_split(D.paragraphs(spark, sf), D.dev_labels(spark, sf), filed=D.filed_paragraphs(spark, sf))


_STRAT = f"""st AS (
  SELECT par_id, binary_label,
         CASE WHEN rk <= floor(floor(n * 0.2 + 0.5) * 0.5) THEN 'val'
              WHEN rk <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT par_id, binary_label,
               row_number() OVER (PARTITION BY binary_label ORDER BY md5('42:' || CAST(par_id AS VARCHAR)), par_id) AS rk,
               CAST(count(*) OVER (PARTITION BY binary_label) AS DOUBLE) AS n
        FROM (SELECT par_id, {y_of()} AS binary_label FROM para)))"""


@query("stratified_split", f"WITH {PARA}, {_STRAT}\nSELECT par_id, binary_label, split FROM st")
def q_stratified_split(spark, sf):
    return PR.stratified_split(D.paragraphs(spark, sf, with_text=False))


@query("split_leakage", f"""
WITH {PARA}, {_STRAT}, h AS (SELECT st.*, sha256({clean_of('p.text')}) AS th FROM st JOIN para p USING (par_id))
SELECT par_id, binary_label FROM h
WHERE split = 'train' AND th IN (SELECT th FROM h WHERE split <> 'train')""")
def q_split_leakage(spark, sf):
    p = D.paragraphs(spark, sf, derive={"text_key": text_hash(clean_text("text"))}, with_text=False)
    return PR.split_leakage(PR.stratified_split(p, carry=("text_key",)))


@query("sample_docs", f"""
WITH {PARA}
SELECT par_id, keyword, text FROM para ORDER BY md5('42:' || CAST(par_id AS VARCHAR)), par_id LIMIT 100""")
def q_sample_docs(spark, sf):
    return PR.sample_docs(D.paragraphs(spark, sf), n=100).select("par_id", "keyword", "text")


@query("class_weights", f"""
WITH {PARA}
SELECT par_id, {y_of()} AS binary_label,
       CASE WHEN {y_of()} = 1 THEN {CLASS_WEIGHTS[1]} ELSE {CLASS_WEIGHTS[0]} END::DOUBLE AS weight FROM para""")
def q_class_weights(spark, sf):
    return PR.class_weights(D.paragraphs(spark, sf, with_text=False), weights=CLASS_WEIGHTS)


@query("dedup_ids", f"""
WITH {PARA}, {FILED}
SELECT par_id, arg_min(keyword, pos) AS keyword, arg_min(label, pos) AS label, md5(arg_min(text, pos)) AS first_text,
       md5(arg_max(text, pos)) AS last_text FROM filed GROUP BY par_id""")
def q_dedup_ids(spark, sf):
    p = D.filed_paragraphs(spark, sf).select("par_id", "keyword", "label", "pos", F.md5("text").alias("text_md5"))
    first = PR.dedup_by_key(p, "par_id", "pos", "first").withColumnRenamed("text_md5", "first_text")
    last = PR.dedup_by_key(p, "par_id", "pos", "last").select("par_id", F.col("text_md5").alias("last_text"))
    return first.join(last, "par_id").select("par_id", "keyword", "label", "first_text", "last_text")


@query("dedup_texts", """
SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents
WHERE text IS NOT NULL GROUP BY text""")
def q_dedup_texts(spark, sf):
    first = (D.texts(spark, sf, "documents").where(F.col("text").isNotNull())
             .groupBy(text_hash("text").alias("th")).agg(F.min("doc_id").alias("doc_id")))
    return first.select("doc_id").join(D.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")

"""Corpus-profile queries (class balance, shares, text and span statistics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sentences, text_hash, tokenize
from ..operators import profile as P
from ..sources import driver as D
from .registry import query
from .sqlparts import (ALPHA, PARA, SENT, STOP_IN, WORDCHAR, CATS, clean_of, lit, tokens_of,
                       y_of)

# ------------------------------------------------------------------ balance

@query("rate_by_keyword", f"""
WITH {PARA}
SELECT keyword, round(avg({y_of()}), 6) AS pcl_rate,
       CAST(sum({y_of()}) AS BIGINT) AS pcl_count, count(*) AS total
FROM para WHERE keyword IS NOT NULL GROUP BY keyword""")
def q_rate_by_keyword(spark, sf):
    return P.rate_by_keyword(D.paragraphs(spark, sf, with_text=False))


@query("counts_by_keyword", f"""
WITH {PARA}
SELECT keyword, count(*) AS total, CAST(sum({y_of()}) AS BIGINT) AS pcl_count,
       count(*) - CAST(sum({y_of()}) AS BIGINT) AS non_pcl_count
FROM para WHERE keyword IS NOT NULL GROUP BY keyword""")
def q_counts_by_keyword(spark, sf):
    return P.counts_by_keyword(D.paragraphs(spark, sf, with_text=False))


@query("label_distribution", f"""
WITH {PARA}, c AS (SELECT label, count(*) AS n FROM para GROUP BY label)
SELECT label, n, round(CAST(n AS DOUBLE) * 100.0 / (SELECT sum(n) FROM c), 6) AS pct
FROM c WHERE label IS NOT NULL""")
def q_label_distribution(spark, sf):
    return P.label_distribution(D.paragraphs(spark, sf, with_text=False))


@query("binarise_label", f"""
WITH {PARA}
SELECT par_id, label, {y_of()} AS binary_label FROM para""")
def q_binarise_label(spark, sf):
    return P.with_binary(D.paragraphs(spark, sf, with_text=False)).select("par_id", "label", "binary_label")


@query("class_imbalance", f"""
WITH {PARA}, a AS (SELECT count(*) AS n_total, CAST(sum(1 - {y_of()}) AS BIGINT) AS n_non_pcl,
                          CAST(sum({y_of()}) AS BIGINT) AS n_pcl FROM para)
SELECT n_total, n_non_pcl, n_pcl,
       round(n_non_pcl * 100.0 / n_total, 6)::DOUBLE AS pct_non_pcl,
       round(n_pcl * 100.0 / n_total, 6)::DOUBLE AS pct_pcl,
       CASE WHEN n_pcl = 0 THEN 'inf'::DOUBLE ELSE round(n_non_pcl::DOUBLE / n_pcl, 6) END AS imbalance_ratio
FROM a""")
def q_class_imbalance(spark, sf):
    return P.class_imbalance(D.paragraphs(spark, sf, with_text=False))


_DIST = """
WITH {cte}, c AS (SELECT {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {col})
SELECT {col}, n, round(CAST(n AS DOUBLE) * 100.0 / (SELECT sum(n) FROM c), 6) AS pct FROM c
{tail}"""


@query("keyword_distribution", _DIST.format(cte=PARA, col="keyword", src="para", tail=""))
def q_keyword_distribution(spark, sf):
    return P.keyword_distribution(D.paragraphs(spark, sf, with_text=False))


@query("country_distribution", _DIST.format(cte=PARA, col="country_code", src="para",
                                            tail="ORDER BY n DESC, country_code LIMIT 15"))
def q_country_distribution(spark, sf):
    return P.country_distribution(D.paragraphs(spark, sf, with_text=False))


@query("class_slice", f"""
WITH {PARA}
SELECT par_id, text FROM para WHERE {y_of()} = 1""")
def q_class_slice(spark, sf):
    return P.class_slice(D.paragraphs(spark, sf), 1)


# ------------------------------------------------------------- text stats

_NTOK = f"CAST(len({tokens_of()}) AS BIGINT)"


def _lengths(spark, sf):
    """(par_id, label, n_tokens) with tokens counted before the label join."""
    return D.paragraphs(spark, sf, derive={"n_tokens": F.size(tokenize("text")).cast("long")},
                        with_text=False)


@query("token_stats", f"""
WITH {PARA}, t AS (SELECT {_NTOK} AS n FROM para WHERE text IS NOT NULL)
SELECT count(*) AS n_docs, round(avg(n), 6) AS avg_tokens, min(n) AS min_tokens,
       max(n) AS max_tokens, round(quantile_cont(n, 0.5), 6) AS median_tokens,
       round(stddev_samp(n), 6) AS std_tokens FROM t""")
def q_token_stats(spark, sf):
    return P.token_stats(_lengths(spark, sf))


@query("char_stats", f"""
WITH {PARA}
SELECT round(avg(length(text)), 6) AS avg_chars, CAST(min(length(text)) AS BIGINT) AS min_chars,
       CAST(max(length(text)) AS BIGINT) AS max_chars FROM para WHERE text IS NOT NULL""")
def q_char_stats(spark, sf):
    return P.char_stats(D.paragraphs(spark, sf, derive={"n_chars": F.length("text")}, with_text=False))


@query("sentence_stats", f"""
WITH {PARA}, s AS (SELECT len(regexp_extract_all(text, {SENT})) AS n FROM para WHERE text IS NOT NULL)
SELECT round(avg(n), 6) AS avg_sentences, CAST(min(n) AS BIGINT) AS min_sentences,
       CAST(max(n) AS BIGINT) AS max_sentences FROM s""")
def q_sentence_stats(spark, sf):
    p = D.paragraphs(spark, sf, derive={"n_sent": F.size(sentences("text"))}, with_text=False)
    return p.agg(P.r6(F.avg("n_sent")).alias("avg_sentences"),
                 F.min("n_sent").cast("long").alias("min_sentences"),
                 F.max("n_sent").cast("long").alias("max_sentences"))


_WTOK = f"""wt AS (SELECT token FROM (SELECT unnest({tokens_of()}) AS token FROM para
                   WHERE text IS NOT NULL) WHERE regexp_matches(token, {WORDCHAR}))"""


def _word_tokens(spark, sf):
    return P.word_tokens(D.paragraphs(spark, sf))


@query("vocabulary_stats", f"""
WITH {PARA}, {_WTOK}, f AS (SELECT token, count(*) AS f FROM wt GROUP BY token)
SELECT CAST(sum(f) AS BIGINT) AS total_tokens, count(*) AS vocab_size,
       round(count(*) / sum(f), 6) AS ttr FROM f""")
def q_vocabulary_stats(spark, sf):
    return P.vocabulary_stats(_word_tokens(spark, sf))


@query("stopword_density", f"""
WITH {PARA}, {_WTOK}, a AS (SELECT count(*) AS total_tokens,
       CAST(sum(CASE WHEN token IN {STOP_IN} THEN 1 ELSE 0 END) AS BIGINT) AS stop_tokens FROM wt)
SELECT total_tokens, stop_tokens, round(stop_tokens * 100.0 / total_tokens, 6)::DOUBLE AS stop_pct,
       round(100.0 - stop_tokens * 100.0 / total_tokens, 6)::DOUBLE AS content_pct FROM a""")
def q_stopword_density(spark, sf):
    return P.stopword_density(_word_tokens(spark, sf))


@query("top_stopwords", f"""
WITH {PARA}, {_WTOK}
SELECT token, count(*) AS freq FROM wt WHERE token IN {STOP_IN}
GROUP BY token ORDER BY freq DESC, token LIMIT 15""")
def q_top_stopwords(spark, sf):
    return P.top_stopwords(_word_tokens(spark, sf))


@query("top_words", f"""
WITH {PARA}, {_WTOK}, c AS (SELECT token, count(*) AS freq FROM wt GROUP BY token)
(SELECT 'all' AS scope, token, freq FROM c ORDER BY freq DESC, token LIMIT 30)
UNION ALL
(SELECT 'content' AS scope, token, freq FROM c WHERE token NOT IN {STOP_IN}
 ORDER BY freq DESC, token LIMIT 30)""")
def q_top_words(spark, sf):
    return P.top_words(_word_tokens(spark, sf))


@query("word_length_distribution", f"""
WITH {PARA}, {_WTOK}
SELECT CAST(length(token) AS BIGINT) AS word_len, count(*) AS n_words FROM wt GROUP BY 1""")
def q_word_length_distribution(spark, sf):
    return P.word_length_distribution(_word_tokens(spark, sf))


@query("word_length_summary", f"""
WITH {PARA}, {_WTOK}
SELECT round(avg(length(token)), 6) AS avg_word_len,
       round(quantile_cont(length(token), 0.5), 6) AS median_word_len FROM wt""")
def q_word_length_summary(spark, sf):
    return P.word_length_summary(_word_tokens(spark, sf))


@query("short_texts", f"""
WITH {PARA}, t AS (SELECT {_NTOK} AS n FROM para WHERE text IS NOT NULL)
SELECT CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
       CAST(sum(CASE WHEN n <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_very_short FROM t""")
def q_short_texts(spark, sf):
    return P.short_texts(_lengths(spark, sf))


@query("duplicate_profile", f"""
WITH {PARA}
SELECT count(*) AS n_docs, count(text) - count(DISTINCT text) AS dup_texts,
       round((count(text) - count(DISTINCT text)) * 100.0 / count(*), 6)::DOUBLE AS dup_text_pct,
       count(par_id) - count(DISTINCT par_id) AS dup_ids FROM para""")
def q_duplicate_profile(spark, sf):
    rows = D.texts(spark, sf, "documents").select(F.col("doc_id").alias("par_id"), text_hash("text").alias("text_key"))
    labelled = D.table(spark, sf, "labels").select(F.col("doc_id").alias("par_id"))
    return P.duplicate_profile(rows.join(labelled, "par_id"))


def _flag_sql(patterns, src: str, key: str, text: str, example_len: int | None) -> str:
    rows = []
    for name, pat in patterns:
        hit = f"regexp_matches({text}, {lit(pat)})"
        ex = (f", arg_min(substring({text}, 1, {example_len}), CASE WHEN {hit} THEN {key} END) AS example"
              if example_len else "")
        rows.append(
            f"SELECT {lit(name)} AS pattern, CAST(coalesce(sum(CASE WHEN {hit} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_docs, "
            f"round(coalesce(sum(CASE WHEN {hit} THEN 1 ELSE 0 END), 0) * 100.0 / count(*), 6)::DOUBLE AS pct{ex} "
            f"FROM {src} WHERE {text} IS NOT NULL")
    return "\nUNION ALL ".join(rows)


@query("artifact_profile", f"WITH {PARA}\n" + _flag_sql(P.ARTIFACT_PATTERNS, "para", "par_id", "text", 150))
def q_artifact_profile(spark, sf):
    flags = D.paragraphs(spark, sf, derive=P.pattern_flags(P.ARTIFACT_PATTERNS), with_text=False)
    texts = D.table(spark, sf, "documents").select(F.col("doc_id").alias("par_id"), "text")
    return P.artifact_profile(flags, texts)


@query("artifact_profile_pages",
       "WITH pg AS (SELECT page_id, html FROM pages)\n" + _flag_sql(P.ARTIFACT_PATTERNS, "pg", "page_id", "html", 150))
def q_artifact_profile_pages(spark, sf):
    pages = D.pages_html(spark, sf).where(F.col("html").isNotNull())
    flags = pages.select("page_id", *[c.alias(n) for n, c in P.pattern_flags(P.ARTIFACT_PATTERNS, "html").items()])
    return P.artifact_profile(flags, D.table(spark, sf, "pages").select("page_id", "html"), "page_id", "html")


@query("pattern_profile", f"WITH {PARA}\n" + _flag_sql(P.PATTERN_CHECKS, "para", "par_id", "text", None))
def q_pattern_profile(spark, sf):
    return P.pattern_profile(D.paragraphs(spark, sf, derive=P.pattern_flags(P.PATTERN_CHECKS), with_text=False))


@query("extreme_lengths", f"""
WITH {PARA}, t AS (SELECT par_id, {_NTOK} AS n_tokens, substring(text, 1, 100) AS text_head
                   FROM para WHERE text IS NOT NULL)
(SELECT 'shortest' AS side, par_id, n_tokens, text_head FROM t ORDER BY n_tokens, par_id LIMIT 5)
UNION ALL
(SELECT 'longest' AS side, par_id, n_tokens, text_head FROM t ORDER BY n_tokens DESC, par_id LIMIT 5)""")
def q_extreme_lengths(spark, sf):
    p = D.paragraphs(spark, sf, derive={"n_tokens": F.size(tokenize("text")).cast("long")})
    return P.extreme_lengths(p.where(F.col("text").isNotNull()))


# ------------------------------------------------------------------ spans

_SPANS = f"""sp0 AS (
  SELECT par_id, art_id, text, keyword, country_code, s, pos,
         length(regexp_extract(text, '^[.!?]*')) AS lead
  FROM (SELECT *, unnest(regexp_extract_all(text, {SENT})) AS s,
               generate_subscripts(regexp_extract_all(text, {SENT}), 1) - 1 AS pos
        FROM para WHERE label >= 2)),
spans AS (
  SELECT par_id, art_id, text, keyword, country_code,
         CAST(lead + coalesce(sum(length(s)) OVER (PARTITION BY par_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS span_start,
         CAST(lead + sum(length(s)) OVER (PARTITION BY par_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS span_finish,
         s AS span_text,
         {CATS}[CAST((par_id + pos) % 7 + 1 AS INTEGER)] AS pcl_category,
         CAST(1 + pos % 2 AS INTEGER) AS num_annotators
  FROM sp0)"""


@query("scan_spans_view", f"""
WITH {PARA}, {_SPANS}
SELECT par_id, span_start, span_finish, span_text, pcl_category, num_annotators FROM spans""")
def q_spans_view(spark, sf):
    return D.spans(spark, sf).select("par_id", "span_start", "span_finish", "span_text",
                                     "pcl_category", "num_annotators")


@query("category_distribution", _DIST.format(cte=f"{PARA}, {_SPANS}", col="pcl_category",
                                             src="spans", tail=""))
def q_category_distribution(spark, sf):
    return P.category_distribution(D.span_marks(spark, sf))


@query("annotator_agreement", _DIST.format(cte=f"{PARA}, {_SPANS}", col="num_annotators",
                                           src="spans", tail=""))
def q_annotator_agreement(spark, sf):
    return P.annotator_agreement(D.span_marks(spark, sf))


@query("span_length_stats", f"""
WITH {PARA}, {_SPANS}
SELECT round(avg(length(span_text)), 6) AS avg_span_len,
       round(quantile_cont(length(span_text), 0.5), 6) AS median_span_len,
       CAST(min(length(span_text)) AS BIGINT) AS min_span_len,
       CAST(max(length(span_text)) AS BIGINT) AS max_span_len FROM spans WHERE span_text IS NOT NULL""")
def q_span_length_stats(spark, sf):
    return P.span_length_stats(D.span_marks(spark, sf))


@query("span_check", f"""
WITH {PARA}, {_SPANS}
SELECT par_id, span_start, span_finish,
       substring(text, span_start + 1, span_finish - span_start) AS extracted,
       substring(text, span_start + 1, span_finish - span_start) = span_text AS matches FROM spans""")
def q_span_check(spark, sf):
    return P.span_check(D.spans(spark, sf))


@query("table_shapes", f"""
WITH {PARA}, {_SPANS}
SELECT 'paragraphs' AS table_name, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM para
UNION ALL SELECT 'spans', count(*), CAST(10 AS BIGINT) FROM spans""")
def q_table_shapes(spark, sf):
    return P.table_shapes({"paragraphs": D.paragraphs(spark, sf), "spans": D.spans(spark, sf)})


@query("category_samples", f"""
WITH {PARA}, {_SPANS},
r AS (SELECT pcl_category, par_id, span_start, substring(span_text, 1, 80) AS span_head,
             row_number() OVER (PARTITION BY pcl_category ORDER BY md5(CAST(par_id AS VARCHAR) || ':' || CAST(span_start AS VARCHAR)), par_id, span_start) AS rank
      FROM spans)
SELECT pcl_category, rank, par_id, span_start, span_head FROM r WHERE rank <= 3""")
def q_category_samples(spark, sf):
    return P.category_samples(D.spans(spark, sf))

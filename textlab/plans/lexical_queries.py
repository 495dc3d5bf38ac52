"""Lexical-contrast queries: tokens, term tables, log-odds, n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, content_tokens, tokenize
from ..operators import lexical as L
from ..operators import profile as P
from ..sources import driver as D
from .registry import query
from .sqlparts import PARA, WORDCHAR, clean_of, content_of, ngrams_of, tokens_of, y_of

# content tokens per labelled document, then the class term table
_CT = f"""ctl AS (SELECT par_id, {y_of()} AS y, {content_of(tokens_of())} AS toks
               FROM para WHERE text IS NOT NULL),
ct AS (SELECT y, unnest(toks) AS term FROM ctl),
tf AS (SELECT term, CAST(sum(y) AS BIGINT) AS pcl_freq, CAST(sum(1 - y) AS BIGINT) AS non_pcl_freq
       FROM ct GROUP BY term)"""

_LO = f"""{_CT},
tot AS (SELECT sum(pcl_freq) AS n1, sum(non_pcl_freq) AS n0, count(*) AS v FROM tf),
lo AS (SELECT term, pcl_freq, non_pcl_freq,
              round(ln(((pcl_freq + 1)::DOUBLE / (n1 + v)) / ((non_pcl_freq + 1)::DOUBLE / (n0 + v))), 6) AS log_odds
       FROM tf, tot)"""


def _class_tokens(spark, sf):
    return L.class_tokens(D.paragraphs(spark, sf))


def _term_freq(spark, sf):
    return L.term_freq(_class_tokens(spark, sf))


@query("tokenize", f"""
WITH {PARA}
SELECT par_id, CAST(len({tokens_of()}) AS BIGINT) AS n_tokens,
       array_to_string({tokens_of()}, ' ') AS tokens FROM para WHERE text IS NOT NULL""")
def q_tokenize(spark, sf):
    # the array is projected once and read twice (size, join)
    t = D.paragraphs(spark, sf).where(F.col("text").isNotNull()).select("par_id", tokenize("text").alias("t"))
    return t.select("par_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("content_tokens", f"""
WITH {PARA}, {_CT}
SELECT par_id, CAST(len(toks) AS BIGINT) AS n_content, array_to_string(toks, ' ') AS tokens FROM ctl""")
def q_content_tokens(spark, sf):
    t = D.paragraphs(spark, sf).where(F.col("text").isNotNull()).select(
        "par_id", content_tokens(tokenize("text")).alias("t"))
    return t.select("par_id", F.size("t").cast("long").alias("n_content"), F.array_join("t", " ").alias("tokens"))


@query("clean_text", f"""
SELECT page_id, {clean_of('html')} AS clean FROM pages""")
def q_clean_text(spark, sf):
    return D.pages_html(spark, sf).select("page_id", clean_text("html").alias("clean"))


@query("term_freq", f"WITH {PARA}, {_CT}\nSELECT term, pcl_freq, non_pcl_freq FROM tf")
def q_term_freq(spark, sf):
    return _term_freq(spark, sf)


@query("vocab_contrast", f"WITH {PARA}, {_CT}\nSELECT term, pcl_freq, non_pcl_freq FROM tf")
def q_vocab_contrast(spark, sf):
    return L.vocab_contrast(_class_tokens(spark, sf))


@query("class_vocab_stats", f"""
WITH {PARA}, {_CT}
SELECT 1 AS binary_label, count(*) FILTER (WHERE pcl_freq > 0) AS vocab_size,
       CAST(sum(pcl_freq) AS BIGINT) AS n_tokens FROM tf
UNION ALL
SELECT 0, count(*) FILTER (WHERE non_pcl_freq > 0), CAST(sum(non_pcl_freq) AS BIGINT) FROM tf""")
def q_class_vocab_stats(spark, sf):
    return L.class_vocab_stats(_term_freq(spark, sf))


@query("log_odds", f"WITH {PARA}, {_LO}\nSELECT term, pcl_freq, non_pcl_freq, log_odds FROM lo")
def q_log_odds(spark, sf):
    return L.log_odds(_term_freq(spark, sf))


@query("distinctive_terms", f"""
WITH {PARA}, {_LO}
(SELECT 'pcl' AS side, term, log_odds, pcl_freq, non_pcl_freq FROM lo ORDER BY log_odds DESC, term LIMIT 20)
UNION ALL
(SELECT 'non_pcl' AS side, term, log_odds, pcl_freq, non_pcl_freq FROM lo ORDER BY log_odds, term LIMIT 20)""")
def q_distinctive_terms(spark, sf):
    return L.distinctive_terms(L.log_odds(_term_freq(spark, sf)))


@query("vocab_sets", f"""
WITH {PARA}, {_CT}
SELECT count(*) AS n_union,
       count(*) FILTER (WHERE pcl_freq > 0 AND non_pcl_freq > 0) AS n_both,
       count(*) FILTER (WHERE pcl_freq > 0 AND non_pcl_freq = 0) AS n_pcl_only,
       count(*) FILTER (WHERE pcl_freq = 0 AND non_pcl_freq > 0) AS n_non_pcl_only,
       round(count(*) FILTER (WHERE pcl_freq > 0 AND non_pcl_freq > 0) / count(*), 6) AS overlap_share
FROM tf""")
def q_vocab_sets(spark, sf):
    return L.vocab_sets(_term_freq(spark, sf))


@query("cloud_terms", f"""
WITH {PARA}, {_CT},
lg AS (SELECT term, 1 AS binary_label, pcl_freq AS freq FROM tf WHERE pcl_freq > 0
       UNION ALL SELECT term, 0, non_pcl_freq FROM tf WHERE non_pcl_freq > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY binary_label ORDER BY freq DESC, term) AS rank,
             max(freq) OVER (PARTITION BY binary_label) AS mx FROM lg)
SELECT binary_label, rank, term, freq, round(freq / mx, 6) AS weight FROM r WHERE rank <= 150""")
def q_cloud_terms(spark, sf):
    return L.cloud_terms(_term_freq(spark, sf))


_TOPBG = """,
c AS (SELECT binary_label, ngram, count(*) AS freq FROM bg GROUP BY binary_label, ngram),
r AS (SELECT *, row_number() OVER (PARTITION BY binary_label ORDER BY freq DESC, ngram) AS rank FROM c)
SELECT binary_label, rank, ngram, freq FROM r WHERE rank <= 15"""


@query("top_bigrams", f"""
WITH {PARA}, {_CT},
bg AS (SELECT y AS binary_label, unnest({ngrams_of('toks', 2)}) AS ngram FROM ctl){_TOPBG}""")
def q_top_bigrams(spark, sf):
    return L.top_bigrams(D.paragraphs(spark, sf))


# Parity mode: each class read as ONE token stream in id order, so bigrams
# cross document edges.
@query("top_bigrams_cross_doc", f"""
WITH {PARA}, {_CT},
seq AS (SELECT y, par_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM ctl),
nx AS (SELECT y AS binary_label,
              term || ' ' || lead(term) OVER (PARTITION BY y ORDER BY par_id, pos) AS ngram FROM seq),
bg AS (SELECT binary_label, ngram FROM nx WHERE ngram IS NOT NULL){_TOPBG}""")
def q_top_bigrams_cross_doc(spark, sf):
    return L.top_bigrams(D.paragraphs(spark, sf), cross_doc=True)


@query("top_ngrams", f"""
WITH {PARA},
wt AS (SELECT list_filter({tokens_of()}, lambda t: regexp_matches(t, {WORDCHAR})) AS toks
       FROM para WHERE text IS NOT NULL),
g2 AS (SELECT unnest({ngrams_of('toks', 2)}) AS ngram FROM wt),
g3 AS (SELECT unnest({ngrams_of('toks', 3)}) AS ngram FROM wt)
(SELECT CAST(2 AS BIGINT) AS n, ngram, count(*) AS freq FROM g2 GROUP BY ngram ORDER BY freq DESC, ngram LIMIT 25)
UNION ALL
(SELECT CAST(3 AS BIGINT) AS n, ngram, count(*) AS freq FROM g3 GROUP BY ngram ORDER BY freq DESC, ngram LIMIT 25)""")
def q_top_ngrams(spark, sf):
    return L.top_ngrams(D.paragraphs(spark, sf))

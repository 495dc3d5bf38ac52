"""Grouping sets, rollup, pivot, mergeable sketches, subword lengths and the open vote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ENSEMBLE_THRESHOLD, ENSEMBLE_WEIGHTS, MAX_LENGTH, PERCENTILES
from ..functions.subword import encoded_lengths, library_bytes, library_encoder
from ..functions.text import tokenize
from ..operators import lengths as LN
from ..operators import levels as LV
from ..operators import profile as P
from ..operators import scoring as S
from ..operators import sketches as SK
from ..session import scratch_path
from ..sources import driver as D
from .length_queries import _DL, _tr
from .profile_queries import _WTOK
from .registry import query
from .sqlparts import PARA, lit, member_logits_cte, tokens_of, y_of

# ------------------------------------------------------------------ levels

_NTOK = f"CAST(len({tokens_of()}) AS BIGINT)"


@query("length_levels", f"""
WITH {PARA}, d AS (SELECT keyword, {y_of()} AS binary_label, {_NTOK} AS n FROM para WHERE text IS NOT NULL)
SELECT CAST(GROUPING(keyword, binary_label) AS INTEGER) AS level, keyword, binary_label, count(*) AS n,
       {", ".join(f"{_tr(f'quantile_cont(n, {p / 100})')} AS p{p}" for p in PERCENTILES)}
FROM d GROUP BY GROUPING SETS ((), (binary_label), (keyword, binary_label))""")
def q_length_levels(spark, sf):
    """Counts and length percentiles in total, by class and by keyword and class, in one pass."""
    return LV.length_levels(D.paragraphs(spark, sf, derive={"n_tokens": F.size(tokenize("text")).cast("long")}, with_text=False))


@query("counts_rollup", f"""
WITH {PARA}
SELECT CAST(GROUPING(keyword, country_code) AS INTEGER) AS level, keyword, country_code, count(*) AS n,
       CAST(sum({y_of()}) AS BIGINT) AS n_pcl
FROM para GROUP BY ROLLUP (keyword, country_code)""")
def q_counts_rollup(spark, sf):
    return LV.counts_rollup(D.paragraphs(spark, sf, with_text=False))


@query("labels_by_keyword", f"""
WITH {PARA}
SELECT keyword, {", ".join(f"count(*) FILTER (WHERE label = {v}) AS label_{v}" for v in range(5))}
FROM para WHERE keyword IS NOT NULL GROUP BY keyword""")
def q_labels_by_keyword(spark, sf):
    return LV.labels_by_keyword(D.paragraphs(spark, sf, with_text=False))


# ------------------------------------------------------------------ sketches

@query("vocabulary_sketches", f"""
WITH {PARA}, wt AS (SELECT DISTINCT keyword, unnest({tokens_of()}) AS token FROM para WHERE text IS NOT NULL),
w AS (SELECT * FROM wt WHERE regexp_matches(token, '[\\p{{L}}\\p{{N}}]'))
SELECT keyword AS scope, count(DISTINCT token) AS n_exact, true AS within FROM w WHERE keyword IS NOT NULL GROUP BY keyword
UNION ALL SELECT 'all', count(DISTINCT token), true FROM w""")
def q_vocabulary_sketches(spark, sf):
    """Vocabulary by source and in total from stored, merged HLL sketches, next to the exact counts."""
    tokens = P.word_tokens(D.paragraphs(spark, sf), keep=("keyword",))
    path = scratch_path(spark, "vocabulary-sketches")
    SK.distinct_sketches(tokens, "keyword", "token").write.parquet(path)
    return SK.distinct_check(SK.distinct_estimates(spark.read.parquet(path), "keyword"),
                             SK.exact_distinct(tokens, "keyword", "token"))


_SCOPES = "SELECT keyword AS scope, v FROM s WHERE keyword IS NOT NULL UNION ALL SELECT 'all', v FROM s"


def _quantile_sql(values: str) -> str:
    return f"""
WITH {PARA}, s AS ({values}), e AS ({_SCOPES}), n AS (SELECT scope, count(*) AS n FROM e GROUP BY scope)
SELECT scope, p.percentile, n, true AS within FROM n, (VALUES {", ".join(f"({p})" for p in PERCENTILES)}) p(percentile)"""


def _quantiles(rows, name):
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    SK.quantile_sketches(rows, "keyword", "v").write.parquet(path)
    return SK.quantile_check(SK.quantile_estimates(spark.read.parquet(path), "keyword"), rows, "keyword", "v")


@query("char_quantile_sketches", _quantile_sql("SELECT keyword, length(text) AS v FROM para WHERE text IS NOT NULL"))
def q_char_quantile_sketches(spark, sf):
    """Percentiles of the texts' characters by source and in total from stored, merged KLL sketches."""
    return _quantiles(D.paragraphs(spark, sf, derive={"v": F.length("text").cast("long")}, with_text=False)
                      .select("keyword", "v"), "char-sketches")


# ------------------------------------------------------------------ the model's own tokens

SUBWORDS = "byte_bpe_50k.json"


def _subwords(spark, sf, kind=library_encoder):
    import public_tokenizers
    docs = D.texts(spark, sf, "documents").select("doc_id", "text")
    return encoded_lengths(docs, f"{kind.__name__}:{SUBWORDS}", kind(public_tokenizers.path(SUBWORDS)), MAX_LENGTH, "doc_id")


@query("subword_lengths")
def q_subword_lengths(spark, sf):
    """Tokens of every document in a public subword vocabulary, and what truncation leaves."""
    return _subwords(spark, sf)


@query("subword_bytes", f"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens, CAST(least(strlen(text), {MAX_LENGTH}) AS BIGINT) AS n_kept,
       strlen(text) > {MAX_LENGTH} AS truncated FROM documents""")
def q_subword_bytes(spark, sf):
    """The same hook with an encoder that counts the bytes of the tokens: they must be those of the text."""
    return _subwords(spark, sf, library_bytes)


@query("subword_percentiles")
def q_subword_percentiles(spark, sf):
    """Length percentiles of the labelled texts in subword units."""
    rows = _subwords(spark, sf).where(F.col("n_tokens").isNotNull()).select(F.col("doc_id").alias("par_id"), "n_tokens")
    labels = D.paragraphs(spark, sf, with_text=False).select("par_id", "label")
    return LN.length_percentiles(LN.length_table(rows.join(labels, "par_id")))


# ------------------------------------------------------------------ the vote of an open model list

#: Vote weights of seven members; the threshold is the catalogue's share of their sum.
OPEN_WEIGHTS = {f"member_{i}": w for i, w in enumerate((1.2, 0.9, 0.9, 0.7, 0.6, 0.4, 0.3), 1)}
OPEN_THRESHOLD = 2.3


def _open_sql(weights: dict, threshold: float, probs: str) -> str:
    values = ", ".join(f"({lit(m)}, {w}::DECIMAL(12,6))" for m, w in weights.items())
    return f""", probs AS ({probs}), weights(model, w) AS (VALUES {values}),
v AS (SELECT par_id, sum(w * CAST(round(p, 12) AS DECIMAL(14,12))) AS s FROM probs JOIN weights USING (model) GROUP BY par_id)
SELECT par_id, round(s::DOUBLE / {len(weights)}, 6) AS ensemble_score, CAST(s > {threshold}::DECIMAL(12,6) AS INTEGER) AS pred FROM v"""


def _open_vote(probs, weights, threshold):
    table = probs.sparkSession.createDataFrame(list(weights.items()), "model string, weight double")
    return S.soft_vote_open(probs, table, threshold)


_P = "1.0::DOUBLE / (1.0::DOUBLE + exp({z0} - {z1}))"


@query("soft_vote_open", f"WITH {PARA}, {member_logits_cte()}" + _open_sql(
    ENSEMBLE_WEIGHTS, ENSEMBLE_THRESHOLD, f"SELECT par_id, model, {_P.format(z0='z0', z1='z1')} AS p FROM logits"))
def q_soft_vote_open(spark, sf):
    """The catalogue's three members as an open list with a weight table."""
    return _open_vote(S.member_probs(D.member_logits(spark, sf)), ENSEMBLE_WEIGHTS, ENSEMBLE_THRESHOLD)


@query("soft_vote_seven", f"WITH {PARA}" + _open_sql(OPEN_WEIGHTS, OPEN_THRESHOLD, f"""
  SELECT par_id, 'member_' || i AS model, {_P.format(z0='0.0::DOUBLE', z1=
    "((CAST(label >= 2 AS INTEGER)::DOUBLE * 2.0 - 1.0) * i / 5.0 + CAST((par_id * (17 + 6 * i)) % 97 - 48 AS DOUBLE) / 24.0)")} AS p
  FROM para, range(1, 8) r(i)"""))
def q_soft_vote_seven(spark, sf):
    """A vote of seven members."""
    return _open_vote(S.member_probs(D.open_member_logits(spark, sf, len(OPEN_WEIGHTS))), OPEN_WEIGHTS, OPEN_THRESHOLD)

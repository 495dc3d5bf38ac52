"""Sequence-length queries, all derived from the small length table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MAX_LENGTH
from ..functions.text import tokenize, truncate_tokens
from ..operators import lengths as LN
from ..sources import driver as D
from .registry import query
from .sqlparts import PARA, lit, tokens_of, y_of
from ..functions.text import WHITESPACE_TOKEN

_DL = f"""dl AS (SELECT par_id, {y_of()} AS y, CAST(len({tokens_of()}) AS BIGINT) AS n
       FROM para WHERE text IS NOT NULL)"""


def _lt(spark, sf):
    p = D.paragraphs(spark, sf, derive={"n_tokens": F.size(tokenize("text")).cast("long")},
                     with_text=False)
    return LN.length_table(p)


def _tr(x: str) -> str:
    return f"CAST(floor(round({x}, 6)) AS BIGINT)"


def _pct_rows():
    rows = []
    for p in (50, 75, 90, 95, 99):
        q = p / 100
        rows.append(
            f"SELECT 'P{p}' AS percentile, {_tr(f'quantile_cont(n, {q})')} AS all_docs, "
            f"{_tr(f'quantile_cont(n, {q}) FILTER (WHERE y = 1)')} AS pcl, "
            f"{_tr(f'quantile_cont(n, {q}) FILTER (WHERE y = 0)')} AS non_pcl FROM dl")
    return "\nUNION ALL ".join(rows)


@query("length_percentiles", f"WITH {PARA}, {_DL}\n" + _pct_rows())
def q_length_percentiles(spark, sf):
    return LN.length_percentiles(_lt(spark, sf))


@query("length_summary", f"""
WITH {PARA}, {_DL}
SELECT {_tr('quantile_cont(n, 0.5)')} AS median_tokens, round(avg(n), 6) AS mean_tokens,
       {_tr('quantile_cont(n, 0.95)')} AS p95_all,
       {_tr('quantile_cont(n, 0.95) FILTER (WHERE y = 1)')} AS p95_pcl, max(n) AS max_tokens FROM dl""")
def q_length_summary(spark, sf):
    return LN.length_summary(_lt(spark, sf))


def _hist_sql(bins: int, where: str, density: bool, label_col: str | None) -> str:
    sel = f"{label_col} AS binary_label, " if label_col is not None else ""
    dens = ", round(coalesce(c.n, 0) / (r.cnt * ((r.hi - r.lo) / {b})), 6) AS density".format(b=bins) if density else ""
    return f"""SELECT * FROM (WITH src AS (SELECT n FROM dl WHERE {where}),
 r0 AS (SELECT min(n) AS mn, max(n) AS mx, count(*) AS cnt FROM src),
 r AS (SELECT CASE WHEN mx = mn THEN mn - 0.5 ELSE mn::DOUBLE END AS lo,
              CASE WHEN mx = mn THEN mx + 0.5 ELSE mx::DOUBLE END AS hi, cnt FROM r0),
 c AS (SELECT CAST(least(floor((n - r.lo) * {bins} / (r.hi - r.lo)), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
       FROM src, r GROUP BY 1)
 SELECT {sel}g.bin, round(r.lo + g.bin * ((r.hi - r.lo) / {bins}), 6) AS bin_lo,
        round(r.lo + (g.bin + 1) * ((r.hi - r.lo) / {bins}), 6) AS bin_hi,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n{dens}
 FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(0, {bins})) g CROSS JOIN r LEFT JOIN c ON c.bin = g.bin) AS h{bins}"""


@query("length_histogram", f"WITH {PARA}, {_DL}\n" + _hist_sql(80, "true", False, None))
def q_length_histogram(spark, sf):
    return LN.length_histogram(_lt(spark, sf))


@query("length_density", f"WITH {PARA}, {_DL}\n" + _hist_sql(80, "y = 0", True, "0")
       + "\nUNION ALL\n" + _hist_sql(40, "y = 1", True, "1"))
def q_length_density(spark, sf):
    return LN.length_density(_lt(spark, sf))


@query("length_boxplot", f"""
WITH {PARA}, {_DL},
q AS (SELECT y, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS med, quantile_cont(n, 0.75) AS q3
      FROM dl GROUP BY y),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lof, q3 + 1.5 * (q3 - q1) AS hif FROM q)
SELECT f.y AS binary_label, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
       round(any_value(q3), 6) AS q3,
       min(CASE WHEN n >= lof AND n <= hif THEN n END) AS whislo,
       max(CASE WHEN n >= lof AND n <= hif THEN n END) AS whishi,
       CAST(sum(CASE WHEN n < lof OR n > hif THEN 1 ELSE 0 END) AS BIGINT) AS n_fliers
FROM dl JOIN f ON dl.y = f.y GROUP BY f.y""")
def q_length_boxplot(spark, sf):
    return LN.length_boxplot(_lt(spark, sf))


@query("length_cdf", f"""
WITH {PARA}, {_DL}, c AS (SELECT n AS n_tokens, count(*) AS cnt FROM dl GROUP BY n)
SELECT n_tokens, cnt, round(sum(cnt) OVER (ORDER BY n_tokens) / (SELECT sum(cnt) FROM c), 6) AS cdf FROM c""")
def q_length_cdf(spark, sf):
    return LN.length_cdf(_lt(spark, sf))


@query("length_outliers", f"""
WITH {PARA}, {_DL},
q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, count(*) AS cnt FROM dl),
f AS (SELECT q1, q3, q3 - q1 AS iqr, greatest(q1 - 1.5 * (q3 - q1), 0.0) AS lo, q3 + 1.5 * (q3 - q1) AS hi, cnt FROM q),
a AS (SELECT f.*, CAST(sum(CASE WHEN n < lo THEN 1 ELSE 0 END) AS BIGINT) AS n_short,
             CAST(sum(CASE WHEN n > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_long
      FROM dl, f GROUP BY ALL)
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lower_fence,
       round(hi, 6) AS upper_fence, n_short, n_long, round(n_short * 100.0 / cnt, 6)::DOUBLE AS pct_short,
       round(n_long * 100.0 / cnt, 6)::DOUBLE AS pct_long FROM a""")
def q_length_outliers(spark, sf):
    return LN.length_outliers(_lt(spark, sf))


@query("truncate_tokens", f"""
WITH {PARA}, {_DL}
SELECT count(*) AS n_docs, CAST(sum(CASE WHEN n > {MAX_LENGTH} THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated,
       CAST(sum(greatest(n - {MAX_LENGTH}, 0)) AS BIGINT) AS tokens_dropped,
       round(sum(CASE WHEN n > {MAX_LENGTH} THEN 1 ELSE 0 END) * 100.0 / count(*), 6)::DOUBLE AS pct_truncated
FROM dl""")
def q_truncate_tokens(spark, sf):
    p = D.paragraphs(spark, sf, derive={"n_tokens": F.size(tokenize("text")).cast("long")},
                     with_text=False)
    return LN.truncation_profile(p, MAX_LENGTH)


@query("truncated_texts", f"""
WITH {PARA}, tk AS (SELECT par_id, {tokens_of()} AS t FROM para WHERE text IS NOT NULL)
SELECT par_id, CAST(least(len(t), {MAX_LENGTH}) AS BIGINT) AS n_kept,
       array_to_string(t[1:{MAX_LENGTH}], ' ') AS kept FROM tk""")
def q_truncated_texts(spark, sf):
    """The rows a model with a fixed input length sees: the first tokens of each text."""
    t = D.paragraphs(spark, sf, derive={"toks": truncate_tokens(tokenize("text"), MAX_LENGTH)}, with_text=False)
    return t.select("par_id", F.size("toks").cast("long").alias("n_kept"), F.array_join("toks", " ").alias("kept"))


# Whitespace tokens: the labelled corpus is already space-tokenised, so this
# mode counts lengths the way its own tokenizer sees them.
_DL_WS = f"""dl AS (SELECT par_id, {y_of()} AS y,
       CAST(len(regexp_extract_all(text, {lit(WHITESPACE_TOKEN)})) AS BIGINT) AS n
       FROM para WHERE text IS NOT NULL)"""


@query("length_percentiles_ws", f"WITH {PARA}, {_DL_WS}\n" + _pct_rows())
def q_length_percentiles_ws(spark, sf):
    p = D.paragraphs(spark, sf, derive={"n_tokens": F.size(tokenize("text", mode="whitespace")).cast("long")},
                     with_text=False)
    return LN.length_percentiles(LN.length_table(p))

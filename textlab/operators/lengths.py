"""Sequence-length statistics.

Everything here is computed from the *length table*
``(binary_label, n_tokens, cnt)`` — one row per distinct (class, length).
Its size is bounded by the number of distinct lengths, not by the number of
documents, so percentiles (``percentile`` with a frequency column, exact and
linearly interpolated like numpy), histograms, box plots, the CDF and the
outlier fences never need a sort or a window over the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PERCENTILES
from ..functions.labels import binarise
from .common import attach, r6, union_all


def length_table(df: DataFrame, n_tokens: str = "n_tokens", label: str = "label") -> DataFrame:
    """``(binary_label, n_tokens, cnt)`` via partial + final hash aggregation.
    Rows must carry a non-null ``n_tokens`` (drop null texts upstream with a
    cheap predicate rather than filtering the derived count)."""
    return (df.groupBy(binarise(label).alias("binary_label"), F.col(n_tokens).cast("long").alias("n_tokens"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def _pct(p: float, where: Column | None = None) -> Column:
    n = F.col("n_tokens") if where is None else F.when(where, F.col("n_tokens"))
    return F.percentile(n, F.lit(p), F.col("cnt"))


def _trunc(c: Column) -> Column:
    # int(np.percentile(...)): truncate, after rounding away float noise
    return F.floor(F.round(c, 6)).cast("long")


def length_percentiles(lt: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """P50..P99 for all documents, the positive and the negative class."""
    pos, neg = F.col("binary_label") == 1, F.col("binary_label") == 0
    aggs = []
    for p in percentiles:
        aggs += [_trunc(_pct(p / 100)).alias(f"a{p}"),
                 _trunc(_pct(p / 100, pos)).alias(f"p{p}"),
                 _trunc(_pct(p / 100, neg)).alias(f"n{p}")]
    one = lt.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f"P{p}").alias("percentile"), F.col(f"a{p}").alias("all_docs"),
                 F.col(f"p{p}").alias("pcl"), F.col(f"n{p}").alias("non_pcl"))
        for p in percentiles])))


def length_summary(lt: DataFrame) -> DataFrame:
    pos = F.col("binary_label") == 1
    return lt.agg(
        _trunc(_pct(0.5)).alias("median_tokens"),
        r6(F.sum(F.col("n_tokens") * F.col("cnt")) / F.sum("cnt")).alias("mean_tokens"),
        _trunc(_pct(0.95)).alias("p95_all"),
        _trunc(_pct(0.95, pos)).alias("p95_pcl"),
        F.max(F.when(F.col("cnt") > 0, F.col("n_tokens"))).alias("max_tokens"))


def _histogram(lt: DataFrame, bins: int, density: bool) -> DataFrame:
    """numpy-style equal-width histogram of one class's lengths: ``bins``
    bins over [min, max], last bin closed; all bins emitted, empty ones as 0."""
    # min/max reference ``cnt`` on purpose: a bare min/max over the grouped
    # table lets Catalyst drop the grouping (RemoveRedundantAggregates) and
    # re-read the raw rows in a second branch, re-running the tokenizer.
    present = F.col("cnt") > 0
    rng = lt.agg(F.min(F.when(present, F.col("n_tokens"))).alias("_mn"),
                 F.max(F.when(present, F.col("n_tokens"))).alias("_mx"),
                 F.sum("cnt").alias("_n"))
    lo = F.when(F.col("_mx") == F.col("_mn"), F.col("_mn") - 0.5).otherwise(F.col("_mn").cast("double"))
    hi = F.when(F.col("_mx") == F.col("_mn"), F.col("_mx") + 0.5).otherwise(F.col("_mx").cast("double"))
    rng = rng.select(lo.alias("_lo"), hi.alias("_hi"), "_n")
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.least(F.floor((F.col("n_tokens") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
                  F.lit(bins - 1)).cast("long")
    counts = attach(lt, rng).groupBy(idx.alias("bin")).agg(F.sum("cnt").alias("n"))
    grid = rng.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"),
                      "_lo", "_hi", "_n")
    out = grid.join(counts, "bin", "left").select(
        "bin",
        r6(F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        r6(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        width.alias("_w"), "_n")
    if density:
        out = out.withColumn("density", r6(F.col("n") / (F.col("_n") * F.col("_w"))))
    return out.drop("_w", "_n")


def length_histogram(lt: DataFrame, bins: int = 80) -> DataFrame:
    per_len = lt.groupBy("n_tokens").agg(F.sum("cnt").alias("cnt"))
    return _histogram(per_len, bins, density=False)


def length_density(lt: DataFrame, bins_neg: int = 80, bins_pos: int = 40) -> DataFrame:
    """Per-class density histograms (counts / (n * width)), 80 bins for the
    negative and 40 for the positive class.  Both classes come from one pass
    over the length table: per-class ranges (two rows, broadcast) and a
    per-class bin count column, no per-class filter that would split the plan."""
    nb = F.when(F.col("binary_label") == 1, F.lit(bins_pos)).otherwise(F.lit(bins_neg))
    present = F.col("cnt") > 0
    rng = lt.groupBy("binary_label").agg(F.min(F.when(present, F.col("n_tokens"))).alias("_mn"),
                                         F.max(F.when(present, F.col("n_tokens"))).alias("_mx"),
                                         F.sum("cnt").alias("_n"))
    same = F.col("_mx") == F.col("_mn")
    rng = rng.select("binary_label", "_n", nb.alias("_bins"),
                     F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn").cast("double")).alias("_lo"),
                     F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx").cast("double")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    idx = F.least(F.floor((F.col("n_tokens") - F.col("_lo")) * F.col("_bins") / (F.col("_hi") - F.col("_lo"))),
                  F.col("_bins") - 1).cast("long")
    counts = (lt.join(F.broadcast(rng), "binary_label")
              .groupBy("binary_label", idx.alias("bin")).agg(F.sum("cnt").alias("n")))
    grid = rng.select("binary_label", "_lo", "_hi", "_n", "_bins",
                      F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_bins") - 1).cast("long"))).alias("bin"))
    return grid.join(counts, ["binary_label", "bin"], "left").select(
        "binary_label", "bin",
        r6(F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        r6(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        r6(F.coalesce(F.col("n"), F.lit(0)) / (F.col("_n") * width)).alias("density"))


def length_boxplot(lt: DataFrame, whis: float = 1.5) -> DataFrame:
    """Per-class box statistics: quartiles, whiskers at the furthest length
    inside 1.5 IQR, and the number of fliers outside the whiskers."""
    q = lt.groupBy("binary_label").agg(
        F.percentile("n_tokens", F.lit(0.25), F.col("cnt")).alias("q1"),
        F.percentile("n_tokens", F.lit(0.5), F.col("cnt")).alias("med"),
        F.percentile("n_tokens", F.lit(0.75), F.col("cnt")).alias("q3"))
    q = q.withColumn("_lof", F.col("q1") - whis * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hif", F.col("q3") + whis * (F.col("q3") - F.col("q1")))
    n = F.col("n_tokens")
    inside = (n >= F.col("_lof")) & (n <= F.col("_hif"))
    j = lt.join(F.broadcast(q), "binary_label")  # q has one row per class
    return j.groupBy("binary_label").agg(
        r6(F.first("q1")).alias("q1"), r6(F.first("med")).alias("median"),
        r6(F.first("q3")).alias("q3"),
        F.min(F.when(inside, n)).alias("whislo"),
        F.max(F.when(inside, n)).alias("whishi"),
        F.sum(F.when(~inside, F.col("cnt")).otherwise(0)).cast("long").alias("n_fliers"))


def length_cdf(lt: DataFrame) -> DataFrame:
    """Empirical CDF at every distinct length: share of documents <= length.

    The running sum is taken over the distinct-length table, whose size is
    bounded by the longest document, never over the documents themselves.
    """
    from pyspark.sql import Window as W
    per_len = lt.groupBy("n_tokens").agg(F.sum("cnt").alias("cnt"))
    w = W.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = per_len.agg(F.sum("cnt").alias("_n"))
    run = per_len.withColumn("_cum", F.sum("cnt").over(w))
    return attach(run, total).select("n_tokens", "cnt", r6(F.col("_cum") / F.col("_n")).alias("cdf"))


def length_outliers(lt: DataFrame, whis: float = 1.5) -> DataFrame:
    """IQR fences (lower fence clamped at 0) and outlier counts and shares."""
    per_len = lt.groupBy("n_tokens").agg(F.sum("cnt").alias("cnt"))
    q = per_len.agg(F.percentile("n_tokens", F.lit(0.25), F.col("cnt")).alias("q1"),
                    F.percentile("n_tokens", F.lit(0.75), F.col("cnt")).alias("q3"),
                    F.sum("cnt").alias("_n"))
    q = q.select("q1", "q3", "_n", (F.col("q3") - F.col("q1")).alias("iqr")) \
         .withColumn("lower", F.greatest(F.col("q1") - whis * F.col("iqr"), F.lit(0.0))) \
         .withColumn("upper", F.col("q3") + whis * F.col("iqr"))
    j = attach(per_len, q)
    n = F.col("n_tokens")
    agg = j.groupBy("q1", "q3", "iqr", "lower", "upper", "_n").agg(
        F.sum(F.when(n < F.col("lower"), F.col("cnt")).otherwise(0)).cast("long").alias("n_short"),
        F.sum(F.when(n > F.col("upper"), F.col("cnt")).otherwise(0)).cast("long").alias("n_long"))
    return agg.select(
        r6(F.col("q1")).alias("q1"), r6(F.col("q3")).alias("q3"), r6(F.col("iqr")).alias("iqr"),
        r6(F.col("lower")).alias("lower_fence"), r6(F.col("upper")).alias("upper_fence"),
        "n_short", "n_long",
        r6(F.col("n_short") * 100.0 / F.col("_n")).alias("pct_short"),
        r6(F.col("n_long") * 100.0 / F.col("_n")).alias("pct_long"))


def truncation_profile(df: DataFrame, max_len: int, n_tokens: str = "n_tokens") -> DataFrame:
    """How many documents a ``max_len`` token cut would shorten."""
    n = F.col(n_tokens)
    return df.agg(F.count(F.lit(1)).alias("n_docs"),
                  F.sum((n > max_len).cast("long")).alias("n_truncated"),
                  F.sum(F.greatest(n - max_len, F.lit(0))).cast("long").alias("tokens_dropped")) \
        .withColumn("pct_truncated", r6(F.col("n_truncated") * 100.0 / F.col("n_docs")))

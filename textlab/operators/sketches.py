"""Mergeable sketches: distinct counts (HLL) and quantiles (KLL).

A sketch a group is written once and merged for any coarser group, so totals
over all groups or over new data never read the texts again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PERCENTILES

#: log2 of the HLL registers; the relative standard error is 1.04 / sqrt(2^LG_K).
LG_K = 12
#: Three standard errors.
DISTINCT_BOUND = 3 * 1.04 / 2 ** (LG_K / 2)
#: KLL size; 200 gives a rank error of 1.33 percent at 99 percent confidence.
KLL_K = 200
#: Rank error that is allowed for: three times that, as the sketch is randomised.
RANK_BOUND = 0.04


def distinct_sketches(rows: DataFrame, by: str, item: str, lg_k: int = LG_K) -> DataFrame:
    """``by, sketch``: an HLL sketch of the different ``item`` values of every group."""
    return rows.groupBy(by).agg(F.hll_sketch_agg(item, lg_k).alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: str, total: str = "all") -> DataFrame:
    """``scope, estimate`` for every group and for all of them together, from merged sketches."""
    each = sketches.select(F.col(by).cast("string").alias("scope"), F.hll_sketch_estimate("sketch").alias("estimate"))
    both = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return each.unionByName(both.where("estimate is not null").select(F.lit(total).alias("scope"), "estimate"))


def exact_distinct(rows: DataFrame, by: str, item: str, total: str = "all") -> DataFrame:
    """``scope, n_exact``: the same counts exactly, by two grouped passes."""
    pairs = rows.groupBy(by, item).agg(F.lit(1).alias("_one"))
    each = pairs.groupBy(F.col(by).cast("string").alias("scope")).agg(F.count(F.lit(1)).alias("n_exact"))
    both = pairs.groupBy(item).agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("n_exact"))
    return each.unionByName(both.where("n_exact > 0").select(F.lit(total).alias("scope"), "n_exact"))


def distinct_check(estimates: DataFrame, exact: DataFrame, bound: float = DISTINCT_BOUND) -> DataFrame:
    """``scope, n_exact, within``: whether the estimate is off by at most ``bound`` of the exact count."""
    off = F.abs(F.col("estimate") - F.col("n_exact")) <= F.lit(bound) * F.col("n_exact")
    return exact.join(estimates, "scope").select("scope", "n_exact", off.alias("within"))


def quantile_sketches(rows: DataFrame, by: str, value: str, k: int = KLL_K) -> DataFrame:
    """``by, sketch``: a KLL sketch of the long ``value`` of every group."""
    return rows.groupBy(by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), k).alias("sketch"))


def quantile_estimates(sketches: DataFrame, by: str, percentiles: Sequence[int] = PERCENTILES,
                       total: str = "all") -> DataFrame:
    """``scope, percentile, estimate`` for every group and for all of them merged."""
    both = sketches.agg(F.kll_merge_agg_bigint("sketch").alias("sketch")).select(F.lit(total).alias("scope"), "sketch")
    states = sketches.select(F.col(by).cast("string").alias("scope"), "sketch").unionByName(both)
    return states.select("scope", F.inline(F.array(*[F.struct(
        F.lit(p).alias("percentile"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias("estimate"))
        for p in percentiles])))


def quantile_check(estimates: DataFrame, rows: DataFrame, by: str, value: str, total: str = "all",
                   bound: float = RANK_BOUND) -> DataFrame:
    """``scope, percentile, n, within``: whether the exact rank of every estimate is near what was asked for.

    The ranks are counted on the table of (group, value) counts.
    """
    counts = rows.groupBy(F.col(by).cast("string").alias("scope"), F.col(value).cast("long").alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    both = counts.groupBy("v").agg(F.sum("c").alias("c")).select(F.lit(total).alias("scope"), "v", "c")
    every = counts.unionByName(both)
    share = F.col("percentile") / 100
    ranks = (estimates.join(every, "scope").groupBy("scope", "percentile").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("v") < F.col("estimate"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("estimate"), F.col("c")).otherwise(0)).alias("upto")))
    return ranks.select("scope", "percentile", "n", ((F.col("below") / F.col("n") - F.lit(bound) <= share)
                                                     & (share <= F.col("upto") / F.col("n") + F.lit(bound))).alias("within"))

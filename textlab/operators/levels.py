"""Several levels of a table in one pass: grouping sets, rollup and pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PERCENTILES
from ..functions.labels import binarise

#: Bits of ``grouping_id(keyword, binary_label)``: a set bit says that the column is rolled up.
TOTAL, BY_CLASS, BY_KEYWORD_CLASS = 3, 2, 0


def length_levels(df: DataFrame, key: str = "keyword", label: str = "label", n_tokens: str = "n_tokens",
                  percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """``level, keyword, binary_label, n, p50 ...``: documents and length percentiles in total, by class
    and by keyword and class.

    The levels are grouping sets over the counts by (keyword, class, length), so
    documents are counted once and only that table is expanded.  ``level`` is
    the grouping id, which tells a null keyword from a rolled-up one.
    """
    counts = (df.groupBy(F.col(key), binarise(label).alias("binary_label"), F.col(n_tokens).cast("long").alias("_n"))
              .agg(F.count(F.lit(1)).alias("_c")))
    k, y = F.col(key), F.col("binary_label")
    at = F.percentile("_n", F.array(*[F.lit(p / 100) for p in percentiles]), F.col("_c"))
    levels = counts.groupingSets([[], [y], [k, y]], k, y).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("_c").alias("n"), at.alias("_p"))
    return levels.select("level", key, "binary_label", "n", *[
        F.floor(F.round(F.col("_p")[i], 6)).cast("long").alias(f"p{p}") for i, p in enumerate(percentiles)])


def counts_rollup(df: DataFrame, keys: Sequence[str] = ("keyword", "country_code"), label: str = "label") -> DataFrame:
    """``level, <keys>, n, n_pcl`` with subtotals for every prefix of ``keys`` and the total."""
    narrow = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(binarise(label).cast("long")).alias("_p"))
    return narrow.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.sum("_n").alias("n"),
                                    F.sum("_p").alias("n_pcl")).select("level", *keys, "n", "n_pcl")


def labels_by_keyword(df: DataFrame, key: str = "keyword", label: str = "label",
                      values: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """One row a keyword (nulls skipped), one column ``label_<v>`` with the count of each stated label value."""
    wide = (df.where(F.col(key).isNotNull()).groupBy(key).pivot(label, list(values)).agg(F.count(F.lit(1))))
    return wide.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(f"label_{v}") for v in values])

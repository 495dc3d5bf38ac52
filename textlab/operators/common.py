"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Every floating output is rounded to this many decimals so two engines that
# add in a different order still produce the same value.
DECIMALS = 6


def r6(col: Column) -> Column:
    return F.round(col.cast("double"), DECIMALS)


def with_share(counts: DataFrame, count_col: str = "n", out: str = "pct") -> DataFrame:
    """Adds ``100 * n / sum(n)``.  The total is a one-row aggregate broadcast
    back, so no window collects the table into one task."""
    total = counts.agg(F.sum(count_col).alias("_total"))
    return (attach(counts, total)
            .withColumn(out, r6(F.col(count_col).cast("double") * 100.0 / F.col("_total")))
            .drop("_total"))


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                    k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group by one ranked window.

    Spark limits the groups before the shuffle (``WindowGroupLimit``): every
    task sends at most k rows a group, so a hot group costs k rows a task.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("long")))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row.

    The row travels as one struct-valued scalar subquery, so the aggregate is
    planned once with all of its columns: there is no join, and a table that
    feeds both sides is computed once."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_one")).scalar()
    return df.withColumn("_one", row).select(
        *df.columns, *[F.col(f"_one.{c}").alias(c) for c in one_row.columns])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: what is used more than once is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

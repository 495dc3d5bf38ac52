"""Helpers shared by the corpus operators: durable cuts, numbering, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.session import ensure_checkpoint_dir, scratch_path, ship_code


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there; its lineage ends there too."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str = "rank",
             buckets: int = 1024) -> DataFrame:
    """Gapless numbers from 0 inside each ``key``, without one task per key.

    Rows of a key are dealt into hash buckets of ``order`` (which must tell the
    rows apart); a window numbers each bucket, and the bucket sizes - at most
    ``buckets`` rows a key - give the offsets.  ``df`` is read twice, so it
    should be durable.
    """
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(key, "__b").orderBy(*order)
    return (dealt.withColumn("__r", F.row_number().over(inside) - 1)
            .join(offsets, [key, "__b"])
            .withColumn(name, (F.col("__o") + F.col("__r")).cast("long"))
            .drop("__b", "__r", "__o"))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Gapless numbers from 1 in the given order over the whole of ``df``.

    Rows are dealt out by ranges of the order and sorted there; a row's number is
    its place in its range plus the sizes of the ranges before, one number a
    partition.  No task gets more than a range.
    """
    spark = df.sparkSession
    ranges = durable(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("__part", F.spark_partition_id())
                     .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, offsets = 0, []
    for part, n in sorted(ranges.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    table = spark.createDataFrame(offsets, "__part int, __before long")
    return (ranges.join(F.broadcast(table), "__part")
            .withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: ``(node, root)`` for every node of ``edges``.

    Alternating large-star and small-star steps; every step is a grouped
    minimum (combined before the shuffle) and an equi-join, so a star centre
    with millions of leaves is never gathered.  ``root`` is the smallest node
    of the component.  Ends when a round leaves the edges as they were.
    """
    cur = durable(edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
                  .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = durable(small.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = cur.select(F.col("v").alias("node")).distinct()
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))


def small_batches(batches, rows: int = 256):
    """Arrow batches in slices, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


class Memo(dict):
    """``solve(key)`` by key; starts anew when it holds ``limit`` keys, so a worker's memory is bounded."""

    def __init__(self, solve, limit: int):
        super().__init__()
        self.solve, self.limit = solve, limit

    def __missing__(self, key):
        value = self.solve(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value

"""Storage layout for cluster scale: bucketed tables.

Joining documents to their labels otherwise shuffles the text whenever the
label table is too large to broadcast.  Writing both tables once, bucketed
and sorted by ``doc_id`` with the same bucket count, lets every later
``documents ⋈ labels`` run as a sort-merge join with no exchange on either
side.  A laid-out table remembers the folder it was made from, and is only read
for that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_PROPERTY = "textlab.source"
BUCKET_KEYS = {"documents": "doc_id", "labels": "doc_id", "pages": "page_id"}


def write_bucketed(df: DataFrame, database: str, name: str, buckets: int, path: str | None = None) -> None:
    """Save ``df`` as ``database.name`` bucketed and sorted by the table's key."""
    key = BUCKET_KEYS[name]
    w = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(f"{database}.{name}")


def lay_out(spark: SparkSession, sf_dir: str, database: str, buckets: int, base_path: str | None = None) -> None:
    """One-time re-layout of the driver tables that take part in key joins."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in BUCKET_KEYS:
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        write_bucketed(df, database, name, buckets, f"{base_path}/{name}" if base_path else None)
        spark.sql(f"ALTER TABLE {database}.{name} SET TBLPROPERTIES ('{SOURCE_PROPERTY}' = '{sf_dir.rstrip('/')}')")


def laid_out(spark: SparkSession, sf_dir: str, database: str, name: str) -> DataFrame:
    """``database.name``, refused when it was not laid out from ``sf_dir``."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {database}.{name}").collect()
    source = {r["key"]: r["value"] for r in rows}.get(SOURCE_PROPERTY)
    if source != sf_dir.rstrip("/"):
        raise ValueError(f"{database}.{name} was laid out from {source}, not from {sf_dir}")
    return spark.table(f"{database}.{name}")

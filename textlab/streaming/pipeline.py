"""Structured Streaming use of the stateless operators.

Cleaning, tokenising, binarising, label parsing and the wide-form soft vote
are per-row expressions, so the same functions run on ``readStream`` frames.
The sink is a parquet folder with its own checkpoint (exactly-once file
sink), never the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, tokenize
from ..operators.scoring import soft_vote

PAGES_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                             T.StructField("html", T.StringType())])


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType,
                      files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one driver table inside ``sf_dir``, one file or a folder
    of files; a backlog is read at once unless ``files_per_trigger`` asks for steps."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern (of this one name): a plain path would have to be a folder, as Spark takes it as base path
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def clean_pages(stream: DataFrame) -> DataFrame:
    """Stateless per-row cleaning of raw HTML into text plus its token count."""
    c = clean_text("html")
    return stream.select("page_id", c.alias("clean"),
                         F.size(tokenize(c)).cast("long").alias("n_tokens"))


def vote_stream(wide_probs: DataFrame, weights: dict | None = None) -> DataFrame:
    """Soft vote on a stream of already aligned member probabilities
    ``(par_id, p_<model>...)``; no state is kept."""
    return soft_vote(wide_probs, weights)


def run_to_parquet(df: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Drain everything available now into ``out_dir`` and stop."""
    q = (df.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()

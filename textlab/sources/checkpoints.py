"""Numbered model checkpoints in one folder per member.

``<folder>/checkpoint-<step>/<part>`` holds the tables of a step as Parquet and
``<folder>/checkpoint-<step>/commit`` its marker, a one-row table that is
written after everything else.  A step without a marker was not finished and
is never chosen.  Steps are compared as numbers, so 1000 comes after 900.

Folders are listed and read by Spark's own readers only, so any store that
Spark reaches will do.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = r"/checkpoint-([0-9]+)/"
_COMMITS = "step long, note string"


def _step_of(path: Column) -> Column:
    return F.regexp_extract(path, _STEP, 1).cast("long")


class CheckpointFolder:
    """The checkpoints of one member."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, step: int | str, part: str) -> str:
        return f"{self.folder}/checkpoint-{step}/{part}"

    def save(self, step: int, tables: dict[str, DataFrame], note: dict | None = None) -> None:
        """Write the tables of ``step``, then its marker with ``note``; a step left unfinished is overwritten."""
        self.write_tables(step, tables)
        self.spark.createDataFrame([(json.dumps(note or {}, sort_keys=True),)], "value string") \
            .coalesce(1).write.mode("overwrite").text(self._path(step, "commit"))

    def write_tables(self, step: int, tables: dict[str, DataFrame]) -> None:
        for part, df in tables.items():
            df.write.mode("overwrite").parquet(self._path(step, part))

    def _files(self, part: str, columns: list[Column]) -> DataFrame | None:
        try:
            return self.spark.read.text(self._path("*", part)).select(*columns)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def committed(self) -> DataFrame:
        """``step, note`` of every finished step."""
        found = self._files("commit", [_step_of(F.col("_metadata.file_path")).alias("step"), F.col("value").alias("note")])
        return self.spark.createDataFrame([], _COMMITS) if found is None else found

    def started(self, part: str) -> DataFrame:
        """``step`` of every step that has files of ``part``, finished or not."""
        try:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self._path("*", part))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], "step long")
            raise
        return files.select(_step_of(F.col("path")).alias("step")).distinct()

    def newest(self) -> int | None:
        """The highest finished step, as a number; None where nothing is finished."""
        return self.committed().agg(F.max("step")).first()[0]

    def best(self, measure: str) -> int | None:
        """The finished step with the highest ``measure`` in its note, the earliest of equal ones."""
        value = F.get_json_object("note", f"$.{measure}").cast("double")
        top = (self.committed().select("step", value.alias("v")).where(F.col("v").isNotNull())
               .orderBy(F.desc("v"), "step").limit(1).collect())
        return top[0]["step"] if top else None

    def load(self, step: int, part: str) -> DataFrame:
        return self.spark.read.parquet(self._path(step, part))

    def overview(self, part: str) -> DataFrame:
        """``step, committed, chosen`` of every step that was begun; ``chosen`` marks the one a reload takes."""
        done = self.committed().select("step", F.lit(True).alias("committed"))
        last = self.newest()
        return (self.started(part).join(done, "step", "full_outer")
                .select("step", F.coalesce("committed", F.lit(False)).alias("committed"),
                        F.coalesce(F.col("step") == F.lit(last).cast("long"), F.lit(False)).alias("chosen")))

"""Exact duplicates by a tree-merge of sorted digest runs.

Every scan partition becomes one run: its digests with their survivor and
count.  In round r the runs of ``fan`` neighbours meet: rows are exchanged on
(run group, digest), sorted, and merged, so a digest with millions of copies
reaches a merge as at most ``fan`` rows.  When one run is left the survivors
are sent back down the same tree, level by level, again at most ``fan`` rows a
key.  No key ever gathers its copies in one task, and no row of text moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

#: The characters that equality ignores: [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
FAN = 8
#: Digest, byte length and a second hash: equal keys are verified to agree in all three.
KEY = ("digest", "n_bytes", "second")


def squeezed(text: Column) -> Column:
    """``text`` without blanks."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, text)


def digest_rows(docs: DataFrame) -> DataFrame:
    """One narrow row per document: digest key, survivor order, run number."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("norm", squeezed(F.col("text")))
    return rows.select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("second"), F.char_length("text").cast("long").alias("chars"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))


def merge(runs: DataFrame) -> DataFrame:
    """One merge step: the best survivor and the total of every (run, digest)."""
    return runs.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Group of every row: ``doc_id, digest, keep_id, group_size, kept``.

    Of equal texts (blanks deleted) the row with the most code points in its
    original text stays, then the smallest doc_id (null ids last); of rows
    that repeat one doc_id the first stays.  Null texts count as empty; empty
    texts form one group; an empty table gives no rows.
    """
    rows = durable(digest_rows(docs))
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    levels = [durable(merge(rows.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))))]
    while n_runs > 1:
        n_runs = -(-n_runs // fan)
        above = F.floor(F.col("run") / fan).cast("int")
        levels.append(durable(merge(levels[-1].withColumn("run", above))))
    top = levels.pop()
    while levels:
        below = levels.pop().select("run", *KEY, F.floor(F.col("run") / fan).cast("int").alias("up"))
        top = below.join(top.withColumnRenamed("run", "up"), ["up", *KEY]).select("run", *KEY, "best", "n")
    return (rows.join(top, ["run", *KEY])
            .select("doc_id", "digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                    (F.col("best.row") == F.col("row")).alias("kept")))

"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. quality rules: documents that fail the base limits or the line labelling go.
3. line dedup: repeated lines go; a document of which nothing is left goes.
4. SimHash near-dedup: one document of each group stays.
5. packing: what is left, as pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.common import read_table
from textlab.llm.crf import learn_chain, quality_verdicts
from textlab.llm.lines import without_repeated_lines
from textlab.llm.packing import TOKENIZER, packed_pieces
from textlab.llm.pu import scored
from textlab.llm.queries import vocabulary
from textlab.llm.simhash import one_of_each
from textlab.llm.toxicity import THRESHOLD, MarkedWords, learn_toxicity
from textlab.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    model = learn_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return (scored(docs, model, MarkedWords(model.weights), *docs.columns, name="__score")
            .where(F.col("__score") < THRESHOLD).select(*docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and hold enough content lines."""
    chain = learn_chain(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_verdicts(docs, chain, *docs.columns, prefix="__").where("__kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has."""
    return without_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every near-duplicate group."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packed_pieces(docs, vocabulary(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("packing", packing),
]

#: Classifiers, line labels and fingerprint components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

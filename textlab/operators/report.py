"""Evaluation and EDA reports as long ``(section, item, value)`` tables built
by unioning small metric frames (every piece is one aggregate row or a
per-model / per-class table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS, ENSEMBLE_THRESHOLD, ENSEMBLE_WEIGHTS, MAX_LENGTH
from ..functions.labels import binarise
from ..functions.text import content_tokens, ngrams, tokenize
from ..session import scratch_path
from .common import top_k_per_group, union_all


def _melt(df: DataFrame, section: str | F.Column, item_cols, id_col: str | None = None) -> DataFrame:
    """Wide metric row(s) -> long rows; ``item`` is ``<id>:<metric>`` when an
    id column is given."""
    structs = []
    for c in item_cols:
        item = F.lit(c) if id_col is None else F.concat_ws(":", F.col(id_col).cast("string"), F.lit(c))
        structs.append(F.struct(item.alias("item"), F.col(c).cast("double").alias("value")))
    sec = F.lit(section) if isinstance(section, str) else section
    return df.select(sec.alias("section"), F.inline(F.array(*structs)))


def evaluation_report(metrics: DataFrame, n_eval: DataFrame, errors: DataFrame, reports: DataFrame) -> DataFrame:
    """Configuration, per-model and ensemble metrics and classification reports, summary and error rate.

    ``metrics``: output of ``binary_metrics`` by model; ``n_eval``: one row
    with ``n``; ``errors``: output of ``error_rate``; ``reports``: output of
    ``classification_report`` by model."""
    spark = metrics.sparkSession
    conf_rows = ([(f"weight:{m}", float(w)) for m, w in ENSEMBLE_WEIGHTS.items()]
                 + [("threshold", float(ENSEMBLE_THRESHOLD)), ("class_weight_pos", float(CLASS_WEIGHTS[1])),
                    ("max_length", float(MAX_LENGTH))])
    conf = spark.createDataFrame(conf_rows, "item string, value double") \
        .select(F.lit("configuration").alias("section"), "item", "value")
    samples = n_eval.select(F.lit("configuration").alias("section"), F.lit("eval_samples").alias("item"),
                            F.col("n").cast("double").alias("value"))
    per_model = _melt(metrics, F.when(F.col("model") == "Ensemble", "ensemble").otherwise("model"),
                      ["accuracy", "precision", "recall", "f1"], id_col="model")
    full = _melt(reports, F.concat(F.lit("report "), F.col("model")), ["precision", "recall", "f1", "support"], id_col="item")
    err = _melt(errors, "summary", ["n_errors", "error_pct"])
    return union_all([conf, samples, per_model, full, err])


def exploration_counts(paragraphs: DataFrame) -> DataFrame:
    """``kind, item, number, binary_label, n``: everything the report counts in the texts, in one pass.

    A text is tokenised once and yields its length (kind ``length``), its content
    terms (``term``) and their bigrams (``bigram``); all are counted by class in
    one aggregate, combined before the shuffle.  The result is written to the
    shared folder, so that the sections are cut from it and read no text.
    """
    t = paragraphs.where(F.col("text").isNotNull()).select(
        binarise("label").alias("binary_label"), tokenize("text").alias("_t"))
    t = t.select("binary_label", F.size("_t").cast("long").alias("_n"), content_tokens("_t").alias("_c"))
    row = lambda kind, item, number: F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"),
                                              number.cast("long").alias("number"))
    none = F.lit(None)
    rows = t.select("binary_label", F.inline(F.concat(
        F.array(row("length", none, F.col("_n"))), F.transform("_c", lambda x: row("term", x, none)),
        F.transform(ngrams(F.col("_c"), 2), lambda x: row("bigram", x, none)))))
    counts = rows.groupBy("kind", "item", "number", "binary_label").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(paragraphs.sparkSession, "exploration")
    counts.write.parquet(path)
    return paragraphs.sparkSession.read.parquet(path)


def length_part(counts: DataFrame) -> DataFrame:
    """The length table of :func:`exploration_counts`."""
    return counts.where("kind = 'length'").select("binary_label", F.col("number").alias("n_tokens"), F.col("n").alias("cnt"))


def term_part(counts: DataFrame) -> DataFrame:
    """The term frequencies of :func:`exploration_counts`."""
    n = lambda y: F.sum(F.when(F.col("binary_label") == y, F.col("n")).otherwise(0))
    return counts.where("kind = 'term'").groupBy(F.col("item").alias("term")).agg(
        n(1).alias("pcl_freq"), n(0).alias("non_pcl_freq"))


def bigram_part(counts: DataFrame, k: int = 15) -> DataFrame:
    """The most common bigrams by class of :func:`exploration_counts`."""
    rows = counts.where("kind = 'bigram'").select("binary_label", F.col("item").alias("ngram"), F.col("n").alias("freq"))
    return top_k_per_group(rows, ["binary_label"], [F.desc("freq"), F.asc("ngram")], k)


def eda_report(imbalance: DataFrame, lengths: DataFrame, vocab: DataFrame, percentiles: DataFrame,
               distinctive: DataFrame, bigrams: DataFrame, keywords: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every section of the exploration report, from the frames of its operators."""
    by = lambda *cols: F.concat_ws(":", *[F.col(c).cast("string") for c in cols])
    parts = [
        _melt(imbalance, "class_balance", ["n_total", "n_non_pcl", "n_pcl", "pct_non_pcl", "pct_pcl",
                                           "imbalance_ratio"]),
        _melt(lengths, "lengths", ["median_tokens", "mean_tokens", "p95_all", "p95_pcl", "max_tokens"]),
        _melt(vocab, "lexical", ["vocab_size", "n_tokens"], id_col="binary_label"),
        _melt(percentiles, "percentiles", ["all_docs", "pcl", "non_pcl"], id_col="percentile"),
        _melt(distinctive.withColumn("id", by("side", "term")), "distinctive",
              ["log_odds", "pcl_freq", "non_pcl_freq"], id_col="id"),
        _melt(bigrams.withColumn("id", by("binary_label", "ngram")), "bigrams", ["freq"], id_col="id"),
        _melt(keywords, "keywords", ["pcl_rate", "pcl_count", "total"], id_col="keyword"),
        _melt(shapes, "tables", ["n_rows", "n_cols"], id_col="table_name"),
    ]
    return union_all(parts)

"""Classification metrics over ``(y, pred)`` rows: counts, accuracy,
precision / recall / F1 with zero_division = 0, confusion matrices,
classification report, model comparison, error rate, score statistics.

All of them are one aggregate pass (the grid and per-class tables are
bounded by the number of classes), never a collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABEL_NAMES
from .common import attach, r6, union_all


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def binary_metrics(preds: DataFrame, by: str | None = "model") -> DataFrame:
    """tp/fp/fn/tn, accuracy, precision, recall, F1 (positive class 1)."""
    y, p = F.col("y"), F.col("pred")
    aggs = [F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
            F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
            F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
            F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn")]
    g = preds.groupBy(by).agg(*aggs) if by else preds.agg(*aggs)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    keep = [by] if by else []
    return g.select(*keep, "tp", "fp", "fn", "tn",
                    r6(_safe_div(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
                    r6(prec).alias("precision"), r6(rec).alias("recall"), r6(f1).alias("f1"))


def model_summary(preds: DataFrame) -> DataFrame:
    """One row per model with a flag on the best value of every metric
    (the window runs over the per-model table: one row per model)."""
    m = binary_metrics(preds, "model")
    w = Window.partitionBy()
    out = m
    for c in ("accuracy", "precision", "recall", "f1"):
        out = out.withColumn(f"best_{c}", F.col(c) == F.max(c).over(w))
    return out.select("model", "accuracy", "precision", "recall", "f1",
                      "best_accuracy", "best_precision", "best_recall", "best_f1")


def confusion_matrix(preds: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Dense confusion counts ``(y, pred, n)``, missing cells as 0.  The grid
    is 0..K-1 squared, K = n_classes or 1 + the largest label seen."""
    counts = preds.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    if n_classes is None:
        k = counts.agg(F.greatest(F.max("y"), F.max("pred")).alias("_k"))
        top = F.col("_k")
    else:
        k = counts.agg(F.lit(n_classes - 1).alias("_k"))
        top = F.col("_k")
    grid = (k.select(F.explode(F.sequence(F.lit(0), top.cast("int"))).alias("y"), top.alias("_k"))
            .select("y", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int"))).alias("pred")))
    return (grid.join(counts, ["y", "pred"], "left")
            .select(F.col("y").cast("int").alias("y"), F.col("pred").cast("int").alias("pred"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_matrix_norm(cm: DataFrame) -> DataFrame:
    """Row-normalised confusion matrix (``normalize='true'``), over the K x K grid."""
    w = Window.partitionBy("y")
    tot = F.sum("n").over(w)
    return cm.withColumn("rate", r6(F.when(tot == 0, F.lit(0.0)).otherwise(F.col("n") / tot)))


def classification_report(preds: DataFrame, names=LABEL_NAMES, by: str | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro and
    support-weighted averages (binary labels 0/1); one report for every value of ``by``.

    One aggregate pass gives six counts; every report cell is column
    arithmetic on that single row, emitted as five rows with ``inline``."""
    y, p = F.col("y"), F.col("pred")
    one = preds.groupBy(*([by] if by else [])).agg(*[F.sum(((y == c) & (p == c)).cast("long")).alias(f"tp{c}") for c in (0, 1)],
                    *[F.sum((p == c).cast("long")).alias(f"pp{c}") for c in (0, 1)],
                    *[F.sum((y == c).cast("long")).alias(f"s{c}") for c in (0, 1)])
    pr = {c: _safe_div(F.col(f"tp{c}"), F.col(f"pp{c}")) for c in (0, 1)}
    rc = {c: _safe_div(F.col(f"tp{c}"), F.col(f"s{c}")) for c in (0, 1)}
    f1 = {c: _safe_div(2 * F.col(f"tp{c}"), F.col(f"pp{c}") + F.col(f"s{c}")) for c in (0, 1)}
    n = F.col("s0") + F.col("s1")

    def wavg(m):
        return (m[0] * F.col("s0") + m[1] * F.col("s1")) / n

    def row(item, prec, rec, f, sup):
        return F.struct(F.lit(item).alias("item"), r6(prec).alias("precision"), r6(rec).alias("recall"),
                        r6(f).alias("f1"), sup.cast("long").alias("support"))

    none = F.lit(None).cast("double")
    rows = [row(names[c], pr[c], rc[c], f1[c], F.col(f"s{c}")) for c in (0, 1)]
    rows += [row("accuracy", none, none, _safe_div(F.col("tp0") + F.col("tp1"), n), n),
             row("macro avg", (pr[0] + pr[1]) / 2, (rc[0] + rc[1]) / 2, (f1[0] + f1[1]) / 2, n),
             row("weighted avg", wavg(pr), wavg(rc), wavg(f1), n)]
    return one.select(*([by] if by else []), F.inline(F.array(*rows)))


def error_rate(preds: DataFrame) -> DataFrame:
    wrong = (F.col("pred") != F.col("y")).cast("long")
    return preds.agg(F.sum(wrong).alias("n_errors"), F.count(F.lit(1)).alias("n")) \
        .withColumn("error_pct", r6(F.col("n_errors") * 100.0 / F.col("n")))


def score_stats(vote: DataFrame) -> DataFrame:
    s = F.col("ensemble_score")
    return vote.agg(r6(F.min(s)).alias("min_score"), r6(F.max(s)).alias("max_score"),
                    r6(F.avg(s)).alias("mean_score"), r6(F.percentile(s, 0.5)).alias("median_score"),
                    F.sum("pred").cast("long").alias("n_pos"), F.count(F.lit(1)).alias("n"))


def misclassified(vote: DataFrame, gold_text: DataFrame, key: str = "par_id") -> DataFrame:
    """Rows the ensemble got wrong, with text, truth, prediction and score."""
    j = vote.join(gold_text, key)
    return j.where(F.col("pred") != F.col("y")).select(
        key, "text", F.col("y").alias("true_label"), F.col("pred").alias("predicted_label"),
        "ensemble_score")


def prediction_counts(named: dict[str, DataFrame]) -> DataFrame:
    """Rows and positive predictions per prediction set."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n"), F.sum("pred").cast("long").alias("n_pos"))
                      .select(F.lit(name).alias("pred_set"), "n", "n_pos")
                      for name, df in named.items()])


__all__ = ["attach", "binary_metrics", "classification_report", "confusion_matrix",
           "confusion_matrix_norm", "error_rate", "misclassified", "model_summary",
           "prediction_counts", "score_stats"]

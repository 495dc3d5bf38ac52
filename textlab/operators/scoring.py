"""Scoring: member probabilities, alignment by key, weighted soft vote,
class-weighted log loss, K-class argmax / softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS, ENSEMBLE_THRESHOLD, ENSEMBLE_WEIGHTS
from ..functions.scores import argmax2, argmax_k, prob_class1, softmax_k
from .common import attach, r6


def member_probs(logits: DataFrame) -> DataFrame:
    """``(par_id, model, z0, z1)`` -> adds ``p`` = P(class 1) and ``pred``."""
    return logits.withColumn("p", prob_class1("z0", "z1")).withColumn("pred", argmax2("z0", "z1"))


def align_scores(probs: DataFrame, models=tuple(ENSEMBLE_WEIGHTS), key: str = "par_id") -> DataFrame:
    """Wide ``(key, p_<model>...)``: member outputs matched on the key (one
    shuffle by key; partial aggregation keeps one row per key and task)."""
    return probs.groupBy(key).agg(*[
        F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"p_{m}") for m in models])


def soft_vote(aligned: DataFrame, weights: dict | None = None,
              threshold: float = ENSEMBLE_THRESHOLD, key: str = "par_id") -> DataFrame:
    """Weighted soft vote: ``sum_m w_m p_m / k > threshold / k`` (strict).

    The sum is column arithmetic in catalogue order, so every engine adds in
    the same order and a score next to the threshold cannot flip.
    """
    weights = weights or ENSEMBLE_WEIGHTS
    k = len(weights)
    wsum = None
    for m, w in weights.items():
        term = F.lit(w) * F.col(f"p_{m}")
        wsum = term if wsum is None else wsum + term
    score = wsum / F.lit(float(k))
    return aligned.select(key, r6(score).alias("ensemble_score"),
                          (score > F.lit(threshold) / F.lit(float(k))).cast("int").alias("pred"))


def soft_vote_open(probs: DataFrame, weights: DataFrame, threshold: float = ENSEMBLE_THRESHOLD,
                   key: str = "par_id") -> DataFrame:
    """The weighted soft vote for an open list of models.

    ``probs``: ``key, model, p``; ``weights``: ``model, weight``, one row a model.
    The score is one grouped sum of decimals, which is exact, so neither the
    number of models nor the order of addition shows.  A key that has not
    exactly one score of every listed model has null score and prediction;
    scores of models that are not listed do not count.
    """
    k = weights.agg(F.count(F.lit(1)).alias("_k"))
    share = F.round("weight", 6).cast("decimal(12,6)") * F.round("p", 12).cast("decimal(14,12)")
    votes = (probs.select(key, "model", "p").join(weights, "model").groupBy(key)
             .agg(F.sum(share).alias("_s"), F.count(F.col("p")).alias("_n"), F.count_distinct("model").alias("_m")))
    whole = (F.col("_n") == F.col("_k")) & (F.col("_m") == F.col("_k"))
    limit = F.lit(threshold).cast("decimal(12,6)")
    return attach(votes, k).select(
        key, F.when(whole, r6(F.col("_s").cast("double") / F.col("_k"))).alias("ensemble_score"),
        F.when(whole, (F.col("_s") > limit).cast("int")).alias("pred"))


def predictions_long(probs: DataFrame, vote: DataFrame, gold: DataFrame,
                     key: str = "par_id", ensemble_name: str = "Ensemble") -> DataFrame:
    """``(key, model, y, pred, p)`` for every member plus the ensemble."""
    members = probs.select(key, "model", "pred", "p")
    ens = vote.select(key, F.lit(ensemble_name).alias("model"), "pred",
                      F.col("ensemble_score").alias("p"))
    return members.unionByName(ens).join(gold, key)


def weighted_log_loss(logits: DataFrame, gold: DataFrame, weights=CLASS_WEIGHTS,
                      key: str = "par_id") -> DataFrame:
    """Class-weighted cross-entropy per model: sum w_y * -ln p_y / sum w_y,
    with -ln p_y = ln(1 + exp(z_other - z_y)), written so that no margin overflows."""
    j = logits.join(gold, key)
    y = F.col("y")
    margin = F.when(y == 1, F.col("z0") - F.col("z1")).otherwise(F.col("z1") - F.col("z0"))
    nll = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    w = F.when(y == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    return j.groupBy("model").agg(r6(F.sum(w * nll) / F.sum(w)).alias("weighted_log_loss"),
                                  F.count(F.lit(1)).alias("n"))


def k_class_scores(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """``(key, z ARRAY, y)`` -> predicted class, its probability and the
    probability of the true class."""
    sm = softmax_k("z")
    return rows.select(key, "y", argmax_k("z").alias("pred"), sm.alias("_sm")).select(
        key, "y", "pred",
        r6(F.element_at("_sm", F.col("pred") + 1)).alias("p_pred"),
        r6(F.element_at("_sm", F.col("y") + 1)).alias("p_true"))

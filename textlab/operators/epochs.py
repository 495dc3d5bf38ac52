"""A class-weighted linear text model trained in epochs, best epoch kept.

Features are the distinct content terms of a text, hashed to ``BUCKETS``
buckets and scaled to unit length.  An epoch is one full-gradient step of the
class-weighted log loss: margins come from the weight vector, which has a fixed
size and is attached as one scalar value, and the gradient is one grouped sum
by bucket, combined before the shuffle.  Residuals and weights are decimals
with twelve places, so no order of addition shows.

After every epoch the weights are written as a numbered checkpoint whose marker
holds the F1 of the positive class on the validation rows.  Training goes on
from the newest finished checkpoint of its folder, ends after ``patience``
epochs without a gain, and the best checkpoint is the model.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS
from ..functions.text import content_tokens, tokenize
from ..session import scratch_path
from ..sources.checkpoints import CheckpointFolder
from .common import attach, r6
from .metrics import binary_metrics

#: Hash buckets: the first four hex digits of the term's MD5.
BUCKETS = 16 ** 4
#: Step sizes of the weights and of the bias, and epochs without a gain after which training ends.
RATE = 100.0
BIAS_RATE = 1.0
PATIENCE = 3
_PLACES = 12
_EXACT = f"decimal(24,{_PLACES})"
_WEIGHTS = f"bucket int, w {_EXACT}"
_BIAS = -1


def hashed_terms(text: Column | str) -> Column:
    """Sorted distinct bucket numbers of the content terms of a text."""
    terms = F.array_distinct(content_tokens(tokenize(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))))
    bucket = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))
    return F.array_sort(F.array_distinct(bucket))


def features(rows: DataFrame, key: str = "par_id", label: str = "label", text: str = "text") -> DataFrame:
    """``key, y, idx``."""
    return rows.select(key, F.col(label).cast("int").alias("y"), hashed_terms(text).alias("idx"))


def _scale() -> Column:
    return F.lit(1.0) / F.sqrt(F.greatest(F.size("idx"), F.lit(1)).cast("double"))


def with_margin(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with the ``margin`` of ``weights`` (``bucket, w``; the bias has bucket -1)."""
    spark = rows.sparkSession
    full = (spark.range(_BIAS, BUCKETS).select(F.col("id").cast("int").alias("bucket"))
            .join(F.broadcast(weights), "bucket", "left")
            .select("bucket", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")))
    # a vector of fixed size: one value for the whole query
    vector = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "w")))["w"].alias("_w"))
    total = F.aggregate("idx", F.lit(0.0), lambda acc, i: acc + F.element_at("_w", i + 2))
    return attach(rows, vector).withColumn("margin", total * _scale() + F.element_at("_w", 1)).drop("_w")


def next_weights(rows: DataFrame, weights: DataFrame, rate: float = RATE, class_weights=CLASS_WEIGHTS) -> DataFrame:
    """The weights after one more step over ``rows`` (``y, idx``)."""
    cw = F.when(F.col("y") == 1, F.lit(class_weights[1])).otherwise(F.lit(class_weights[0]))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    pull = cw * (F.col("y").cast("double") - p)
    part = with_margin(rows, weights).select(
        cw.alias("cw"), F.array_union(F.array(F.lit(_BIAS)), "idx").alias("idx"),
        F.round(pull, _PLACES).cast(_EXACT).alias("r0"), F.round(pull * _scale(), _PLACES).cast(_EXACT).alias("r"))
    mass = rows.select(cw.alias("cw")).agg(F.sum("cw").alias("mass"))
    step = (part.select(F.explode("idx").alias("bucket"), "r0", "r")
            .groupBy("bucket").agg(F.sum(F.when(F.col("bucket") == _BIAS, F.col("r0")).otherwise(F.col("r"))).alias("g")))
    size = F.when(F.col("bucket") == _BIAS, F.lit(BIAS_RATE)).otherwise(F.lit(rate))
    moved = attach(step, mass).select("bucket", (size * F.col("g").cast("double") / F.col("mass")).alias("d"))
    return (weights.join(moved, "bucket", "full_outer")
            .select("bucket", F.round(F.coalesce(F.col("w").cast("double"), F.lit(0.0))
                                      + F.coalesce("d", F.lit(0.0)), _PLACES).cast(_EXACT).alias("w")))


def predictions(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with ``margin`` and ``pred``."""
    return with_margin(rows, weights).withColumn("pred", (F.col("margin") > 0).cast("int"))


def _measures(rows: DataFrame, weights: DataFrame) -> dict:
    return {k: v if v is not None else 0 for k, v in binary_metrics(predictions(rows, weights), None)
            .select("tp", "fp", "fn", "tn", "f1").first().asDict().items()}


def train_epochs(train: DataFrame, valid: DataFrame, folder: str, epochs: int, rate: float = RATE,
                 patience: int = PATIENCE, class_weights=CLASS_WEIGHTS) -> CheckpointFolder:
    """Train up to ``epochs`` epochs in ``folder``, going on from what is finished there.

    ``train`` and ``valid``: ``par_id, text, label``.  Step 0 has no weights
    and is not kept.  Without training rows no step is written.
    """
    spark = train.sparkSession
    rows, held = (_stored(features(df), name) for df, name in ((train, "epoch-train"), (valid, "epoch-valid")))
    store = CheckpointFolder(spark, folder)
    if rows.isEmpty():
        return store
    done = store.newest() or 0
    weights = store.load(done, "weights") if done else spark.createDataFrame([], _WEIGHTS)
    for epoch in range(done + 1, epochs + 1):
        if _stale(store, patience):
            break
        store.write_tables(epoch, {"weights": next_weights(rows, weights, rate, class_weights)})
        weights = store.load(epoch, "weights")
        store.save(epoch, {}, _measures(held, weights))
    return store


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _stale(store: CheckpointFolder, patience: int) -> bool:
    """Whether the last ``patience`` finished epochs brought no F1 above the best before them."""
    f1 = [json.loads(r["note"])["f1"] for r in store.committed().orderBy("step").collect()]
    return len(f1) > patience and max(f1[-patience:]) <= max(f1[:-patience])


def history(store: CheckpointFolder) -> DataFrame:
    """``epoch, tp, fp, fn, tn, f1, is_best`` of the finished epochs."""
    best = store.best("f1")
    of = lambda name, kind: F.get_json_object("note", f"$.{name}").cast(kind).alias(name)
    return store.committed().select(
        F.col("step").cast("int").alias("epoch"), *[of(c, "long") for c in ("tp", "fp", "fn", "tn")], of("f1", "double"),
        F.coalesce(F.col("step") == F.lit(best).cast("long"), F.lit(False)).alias("is_best"))


def reload_best(store: CheckpointFolder, valid: DataFrame) -> DataFrame:
    """``epoch, f1, same`` of the best checkpoint, read again and measured anew on ``valid``."""
    best = store.best("f1")
    again = binary_metrics(predictions(features(valid), store.load(best, "weights")), None).select("f1")
    kept = history(store).where("is_best").select("epoch", F.col("f1").alias("kept"))
    return attach(again, kept).select("epoch", r6(F.col("f1")).alias("f1"), (F.col("f1") == F.col("kept")).alias("same"))

"""Parameter search by successive halving on growing hash samples.

Every member starts with a set of drawn settings (class weight among them) on a
small sample of the training rows.  After each rung only the best ``1 / eta``
of a member's settings go on, to a sample ``eta`` times as large; the last rung
sees all training rows.  Samples are nested and cut by a hash of the id, as are
the validation rows, so a rung's rows are the same in every run.

Texts are tokenised once, into a table in the shared folder that all rungs read.
A member is a function ``(train, valid, trials) -> {trial number: F1}`` over
rows ``par_id, label, tokens``.  The naive Bayes member scores all trials of a
rung in one pass; the logistic members share one feature table a rung and fit
their trials side by side.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS, SPLIT_SEED
from ..session import scratch_path
from .bayes import Setting, class_counts, margins, term_weights, terms_of, totals
from .common import r6, stored

#: Hash range of an id and the part of it that is training; the rest is for validation.
RANGE = 16 ** 4
TRAIN_UNTIL = 52_429
ETA = 3
RUNGS = 3
TRIALS = 6
#: Hash buckets of the term features; smaller than the members' own, as every rung fits many trials.
FEATURES = 1 << 16
PARAMS = ("class_weight", "alpha", "reg_param", "elastic_net", "epochs")


@dataclass(frozen=True)
class Trial:
    member: str
    number: int
    params: dict = field(hash=False)


def _uniform(*name) -> float:
    """A number in [0, 1) from the name; the same in every run."""
    return int(hashlib.md5(":".join(map(str, name)).encode()).hexdigest()[:13], 16) / 16 ** 13


def draw_trials(member: str, n: int = TRIALS, seed: int = SPLIT_SEED) -> list[Trial]:
    """``n`` settings of a member; the first is the default."""
    out = []
    for i in range(n):
        u = lambda name: _uniform(seed, member, i, name)
        params = {"class_weight": round(1 + 11 * u("class_weight"), 3) if i else CLASS_WEIGHTS[1]}
        if member == "exact_bayes":
            params["alpha"] = round(10 ** (-1.3 + 2 * u("alpha")), 4) if i else 1.0
        else:
            params |= ({"reg_param": round(10 ** (-4 + 3 * u("reg_param")), 6), "elastic_net": float(u("elastic_net") < 0.5) / 2,
                        "epochs": (5, 10, 15)[int(3 * u("epochs"))]} if i
                       else {"reg_param": 0.01, "elastic_net": 0.0, "epochs": 15})
        out.append(Trial(member, i, params))
    return out


def hash_place(key: Column | str, seed: int = SPLIT_SEED) -> Column:
    """Place of an id in ``0 .. RANGE - 1``."""
    name = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("int")


def rung_until(rung: int, rungs: int = RUNGS, eta: int = ETA) -> int:
    """Places below this one are the training rows of a rung (from 0)."""
    return TRAIN_UNTIL // eta ** (rungs - 1 - rung)


def survivors(n: int, eta: int = ETA) -> int:
    return -(-n // eta)


def survivors_of(rung: int, trials: int = TRIALS, eta: int = ETA) -> int:
    """How many trials of a member go on from a rung."""
    for _ in range(rung + 1):
        trials = survivors(trials, eta)
    return trials


def _f1(counts) -> float:
    tp, fp, fn = (x or 0 for x in counts)
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def bayes_member(train: DataFrame, valid: DataFrame, trials: Sequence[Trial]) -> dict[int, float]:
    """All trials weighed and scored in one pass over the terms of the validation rows."""
    settings = [Setting(CLASS_WEIGHTS[0], t.params["class_weight"], t.params["alpha"]) for t in trials]
    tokens = F.col("tokens")
    counts = stored(class_counts(train, tokens=tokens), "class-counts")
    total = stored(totals(counts, train), "class-totals")
    rows = margins(valid, term_weights(counts, total, settings), total, settings, ("par_id", "label"), tokens)
    y, z = F.col("label") == 1, F.col("margin")
    cells = [F.sum(c.cast("long")) for i in range(len(trials))
             for c in (y & (z[i] > 0), ~y & (z[i] > 0), y & ~(z[i] > 0))]
    found = rows.agg(*cells).first()
    return {t.number: _f1(found[3 * i:3 * i + 3]) for i, t in enumerate(trials)}


def logistic_member(ngram: int) -> Callable:
    """Hashed TF-IDF of n-grams and a logistic regression: one feature table a rung, trials side by side."""
    def member(train: DataFrame, valid: DataFrame, trials: Sequence[Trial]) -> dict[int, float]:
        low, high = train.agg(F.min("label"), F.max("label")).first()
        if low == high:
            return {t.number: 0.0 for t in trials}  # nothing to tell apart
        grams = [NGram(n=ngram, inputCol="tokens", outputCol="grams")] if ngram > 1 else []
        front = Pipeline(stages=[*grams, HashingTF(inputCol="grams" if grams else "tokens", outputCol="tf", numFeatures=FEATURES),
                                 IDF(inputCol="tf", outputCol="features")]).fit(train)
        cut = [front.transform(df).select("label", "features").persist() for df in (train, valid)]

        def run(trial: Trial) -> tuple[int, float]:
            p = trial.params
            weight = F.when(F.col("label") == 1, F.lit(p["class_weight"])).otherwise(F.lit(CLASS_WEIGHTS[0]))
            model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                       maxIter=p["epochs"], regParam=p["reg_param"], elasticNetParam=p["elastic_net"]
                                       ).fit(cut[0].withColumn("weight", weight))
            y, hit = F.col("label") == 1, F.col("prediction") == 1
            return trial.number, _f1(model.transform(cut[1]).agg(*[
                F.sum(c.cast("long")) for c in (y & hit, ~y & hit, y & ~hit)]).first())

        try:
            with ThreadPoolExecutor(4) as pool:
                return dict(pool.map(inheritable_thread_target(train.sparkSession)(run), trials))
        finally:
            for df in cut:
                df.unpersist()
    return member


MEMBERS: dict[str, Callable] = {
    "exact_bayes": bayes_member, "tfidf_logreg": logistic_member(1), "bigram_logreg": logistic_member(2)}

_TABLE = ("member string, rung int, trial int, class_weight double, alpha double, reg_param double, "
          "elastic_net double, epochs int, n_train long, n_valid long, f1 double, survived boolean")


def successive_halving(rows: DataFrame, members: dict[str, Callable] | None = None, trials: int = TRIALS,
                       rungs: int = RUNGS, eta: int = ETA, seed: int = SPLIT_SEED) -> DataFrame:
    """One row per member, rung and trial: its parameters, the rows it saw, its F1 and whether it went on.

    ``rows``: ``par_id, text, label`` (0 or 1).  A rung keeps the best
    ``ceil(n / eta)`` trials of a member, by F1 and then by trial number; the
    one that survives the last rung is the choice.  The driver holds the trial
    table only.  Without rows every F1 is 0.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "search-rows")
    rows.select("par_id", F.col("label").cast("double").alias("label"), terms_of().alias("tokens"),
                hash_place("par_id", seed).alias("_place")).write.parquet(path)
    placed = spark.read.parquet(path)
    valid = placed.where(F.col("_place") >= TRAIN_UNTIL).drop("_place")
    out = []
    alive = {m: draw_trials(m, trials, seed) for m in (MEMBERS if members is None else members)}
    sizes = placed.agg(*[F.sum((F.col("_place") < rung_until(r, rungs, eta)).cast("long")) for r in range(rungs)],
                       F.sum((F.col("_place") >= TRAIN_UNTIL).cast("long"))).first()
    for rung in range(rungs):
        train = placed.where(F.col("_place") < rung_until(rung, rungs, eta)).drop("_place")
        for member, settings in alive.items():
            f1 = (members or MEMBERS)[member](train, valid, settings)
            order = sorted(settings, key=lambda t: (-round(f1[t.number], 9), t.number))
            kept = order[:survivors(len(order), eta)]
            for t in settings:
                out.append((member, rung, t.number, *[t.params.get(p) for p in PARAMS],
                            sizes[rung] or 0, sizes[rungs] or 0, f1[t.number], t in kept))
            alive[member] = kept
    return spark.createDataFrame(out, _TABLE).withColumn("f1", r6(F.col("f1")))


def rung_summary(table: DataFrame) -> DataFrame:
    """Per member and rung: trials, survivors, rows, and whether the cut was right - no trial
    left behind beats one that went on, and every trial of a rung survived the rung before."""
    kept, left = F.when(F.col("survived"), F.col("f1")), F.when(~F.col("survived"), F.col("f1"))
    before = (table.where("survived").select("member", (F.col("rung") + 1).alias("rung"), "trial", F.lit(True).alias("_came")))
    return (table.join(before, ["member", "rung", "trial"], "left").groupBy("member", "rung").agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum(F.col("survived").cast("long")).alias("n_survivors"),
        F.max("n_train").alias("n_train"), F.max("n_valid").alias("n_valid"),
        (F.coalesce(F.min(kept) >= F.max(left), F.lit(True)) & F.min(F.col("f1").between(0, 1))
         & F.min((F.col("rung") == 0) | F.coalesce("_came", F.lit(False)))).alias("cut_right")))

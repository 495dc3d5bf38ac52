"""Spark ML queries.

Fitted models have no SQL twin, but what must hold of their results has: each
model query has a companion whose rows (supports, grids, ranges, agreement)
the oracle states.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ENSEMBLE_THRESHOLD
from ..operators import metrics as M
from ..operators import ml as ML
from ..operators import prep as PR
from ..operators import scoring as S
from ..operators.common import attach
from ..sources import delimited as IO
from ..sources import driver as D
from ..session import scratch_path
from .registry import query
from .sqlparts import DEV, PARA, UNLAB


def _official(spark, sf):
    split = PR.official_split(D.paragraphs(spark, sf), D.dev_labels(spark, sf), filed=D.filed_paragraphs(spark, sf))
    train = ML.training_frame(split.where(F.col("split") == "train"))
    dev = ML.training_frame(split.where(F.col("split") == "dev"))
    return train, dev


@query("train_members")
def q_train_members(spark, sf):
    """Fit the three class-weighted members on the official train part and
    report their dev metrics plus the soft-vote ensemble's."""
    train, dev = _official(spark, sf)
    models = ML.train_members(train)
    probs = ML.score_members(models, dev)
    vote = S.soft_vote(S.align_scores(probs, tuple(ML.MEMBER_WEIGHTS)), ML.MEMBER_WEIGHTS)
    gold = dev.select("par_id", F.col("label").cast("int").alias("y"))
    return M.binary_metrics(S.predictions_long(probs, vote, gold), "model")


@query("train_members_support", f"""
WITH {PARA}, {DEV}, d AS (SELECT CAST(regexp_matches(label, '[1-9]') AS INTEGER) AS y FROM dev),
n AS (SELECT count(*) AS n_rows, CAST(coalesce(sum(y), 0) AS BIGINT) AS n_pos FROM d)
SELECT m.model, n.n_rows, n.n_pos, true AS in_range
FROM n, (VALUES {", ".join(f"('{m}')" for m in (*ML.MEMBER_WEIGHTS, "Ensemble"))}) m(model)""")
def q_train_members_support(spark, sf):
    """Every member and the vote judge every dev row; metrics lie in 0..1."""
    m = q_train_members(spark, sf)
    ok = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1"):
        ok = ok & F.col(c).between(0, 1)
    return m.select("model", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_rows"),
                    (F.col("tp") + F.col("fn")).alias("n_pos"), ok.alias("in_range"))


@query("best_by_f1")
def q_best_by_f1(spark, sf):
    train, _ = _official(spark, sf)
    _, table = ML.best_by_f1(train)
    return table


_TRAIN_ROWS = f"""{PARA}, {DEV},
n AS (SELECT count(*) AS n_train FROM para WHERE text IS NOT NULL AND label IS NOT NULL AND par_id NOT IN (SELECT par_id FROM dev))"""


@query("best_by_f1_grid", f"""
WITH {_TRAIN_ROWS}
SELECT reg_param, n_train, true AS in_range FROM (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)) g(reg_param), n""")
def q_best_by_f1_grid(spark, sf):
    """The candidates, the rows that they were fitted and validated on, and the range of their F1."""
    train, _ = _official(spark, sf)
    n = train.agg(F.count(F.lit(1)).alias("n_train"))
    return attach(ML.best_by_f1(train)[1].select("reg_param", F.col("f1").between(0, 1).alias("in_range")), n)


@query("param_search")
def q_param_search(spark, sf):
    train, _ = _official(spark, sf)
    return ML.param_search(train)


@query("param_search_grid", f"""
WITH {_TRAIN_ROWS}
SELECT r.reg_param::DOUBLE AS reg_param, e.elastic_net::DOUBLE AS elastic_net, n_train, true AS in_range
FROM (VALUES (0.01), (0.1)) r(reg_param), (VALUES (0.0), (0.5)) e(elastic_net), n""")
def q_param_search_grid(spark, sf):
    """The grid, the rows that its folds were cut from, and the range of the objective."""
    train, _ = _official(spark, sf)
    n = train.agg(F.count(F.lit(1)).alias("n_train"))
    found = ML.param_search(train).select("reg_param", "elastic_net", F.col("objective").between(0, 1).alias("in_range"))
    return attach(found, n)


@query("model_roundtrip", f"WITH {DEV}\nSELECT count(*) AS n, count(*) AS n_equal FROM dev")
def q_model_roundtrip(spark, sf):
    train, dev = _official(spark, sf)
    model = ML.member_pipelines()["tfidf_logreg"].fit(train)
    return ML.roundtrip_check(spark, model, dev, scratch_path(spark, "model"))


@query("score_unlabelled")
def q_score_unlabelled(spark, sf):
    """Train on every labelled row, score the unlabelled documents, vote."""
    labelled = ML.training_frame(D.paragraphs(spark, sf).withColumn(
        "label", (F.col("label") >= 2).cast("int")))
    models = ML.train_members(labelled)
    unl = D.unlabelled(spark, sf).select(F.col("id").alias("par_id"), "text")
    probs = ML.score_members(models, unl)
    return S.soft_vote(S.align_scores(probs, tuple(ML.MEMBER_WEIGHTS)), ML.MEMBER_WEIGHTS)


@query("score_unlabelled_rows", f"WITH {UNLAB}\nSELECT id AS par_id, true AS in_range, true AS consistent FROM unlab")
def q_score_unlabelled_rows(spark, sf):
    """One vote an unlabelled row: a weighted sum within its range, cut at the threshold."""
    v = q_score_unlabelled(spark, sf)
    most = float(sum(ML.MEMBER_WEIGHTS.values()))
    return v.select("par_id", F.col("ensemble_score").between(0, most).alias("in_range"),
                    ((F.col("ensemble_score") > ENSEMBLE_THRESHOLD / len(ML.MEMBER_WEIGHTS)) == (F.col("pred") == 1)).alias("consistent"))


@query("submission_run", f"""
WITH {DEV}, {UNLAB}
SELECT 'dev' AS part, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS line_no, true AS valid FROM dev
UNION ALL
SELECT 'test', CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT), true FROM unlab""")
def q_submission_run(spark, sf):
    """The whole submission: train, save and reload every member, score dev and
    unlabelled rows in one pass over the texts, vote, write one ordered file of
    predictions for each part, and read both back."""
    train, dev = _official(spark, sf)
    models = {name: ML.save_and_reload(m, scratch_path(spark, f"member-{name}"))
              for name, m in ML.train_members(train).items()}
    wanted = D.dev_labels(spark, sf).select("par_id", "pos", F.lit("dev").alias("part"))
    rows = dev.select("par_id", "text").join(wanted, "par_id").unionByName(
        D.unlabelled(spark, sf).select(F.col("id").alias("par_id"), "text", "pos", F.lit("test").alias("part")))
    probs = ML.score_members(models, rows)
    vote = S.soft_vote(S.align_scores(probs, tuple(ML.MEMBER_WEIGHTS)), ML.MEMBER_WEIGHTS)
    voted = rows.drop("text").join(vote, "par_id").select("part", "pos", "pred").persist()
    parts = []
    try:
        for part in ("dev", "test"):
            path = scratch_path(spark, f"submission-{part}")
            IO.write_predictions(voted.where(F.col("part") == part), path)
            parts.append(IO.read_predictions(spark, path).select(
                F.lit(part).alias("part"), "line_no", F.col("pred").isin(0, 1).alias("valid")))
    finally:
        voted.unpersist()
    return parts[0].unionByName(parts[1])


@query("class_weighted_members")
def q_class_weighted_members(spark, sf):
    """Per-member weighted log loss on dev from the fitted models' logits."""
    train, dev = _official(spark, sf)
    scored = ML.score_wide(ML.train_members(train), dev)
    logits = scored.select("par_id", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"z_{name}")[0].alias("z0"), F.col(f"z_{name}")[1].alias("z1"))
        for name in ML.MEMBER_WEIGHTS])))
    gold = dev.select("par_id", F.col("label").cast("int").alias("y"))
    return S.weighted_log_loss(logits, gold)


@query("external_batch_scores")
def q_external_batch_scores(spark, sf):
    """K-class scoring through the external-model hook: a model fitted by
    Spark ML on the embeddings is exported as numpy weights and applied with
    ``predict_batch_udf``; its prediction is reported next to Spark's own.
    Without embeddings there is nothing to fit, and no row."""
    emb = D.table(spark, sf, "embeddings")
    if emb.isEmpty():
        return spark.createDataFrame([], "vec_id long, y int, pred_external int, pred_spark int")
    model = ML.fit_k_class(emb)
    dim = len(emb.select("embedding").first()[0])
    scorer = ML.external_scorer(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), dim)
    from pyspark.ml.functions import array_to_vector
    scored = emb.select("vec_id", F.col("label").alias("y"), "embedding",
                        scorer(F.col("embedding")).alias("probs"))
    ext = scored.select("vec_id", "y", "embedding",
                        (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("pred_external"))
    spark_pred = model.transform(ext.select(
        "vec_id", "y", "pred_external",
        array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features")))
    return spark_pred.select("vec_id", "y", "pred_external", F.col("prediction").cast("int").alias("pred_spark"))


@query("external_batch_agreement", "SELECT count(*) AS n, count(*) AS n_agree FROM embeddings")
def q_external_batch_agreement(spark, sf):
    """The external scorer and Spark's own model agree on every row."""
    return q_external_batch_scores(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("pred_external") == F.col("pred_spark")).cast("long")).alias("n_agree"))

"""Scoring and evaluation queries: probabilities, alignment, soft vote,
metrics, confusion matrices, reports, log loss, K-class scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS, ENSEMBLE_THRESHOLD, ENSEMBLE_WEIGHTS, LABEL_NAMES
from ..operators import metrics as M
from ..operators import prep as PR
from ..operators import scoring as S
from ..sources import driver as D
from .registry import query
from .sqlparts import DEV, PARA, lit, member_logits_cte

_K = len(ENSEMBLE_WEIGHTS)
_WSUM = " + ".join(f"{w}::DOUBLE * p_{m}" for m, w in ENSEMBLE_WEIGHTS.items())
_ALIGN = ", ".join(f"max(CASE WHEN model = {lit(m)} THEN p END) AS p_{m}" for m in ENSEMBLE_WEIGHTS)

_BASE = f"""{PARA}, {member_logits_cte()},
probs AS (SELECT par_id, model, z0, z1, 1.0::DOUBLE / (1.0::DOUBLE + exp(z0 - z1)) AS p,
                 CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS pred FROM logits),
al AS (SELECT par_id, {_ALIGN} FROM probs GROUP BY par_id),
vote AS (SELECT par_id, round(({_WSUM}) / {_K}.0::DOUBLE, 6) AS ensemble_score,
                CAST(({_WSUM}) / {_K}.0::DOUBLE > {ENSEMBLE_THRESHOLD}::DOUBLE / {_K}.0::DOUBLE AS INTEGER) AS pred
         FROM al),
gold AS (SELECT par_id, CAST(label >= 2 AS INTEGER) AS y FROM para),
pl AS (SELECT par_id, model, pred, p FROM probs
       UNION ALL SELECT par_id, 'Ensemble', pred, ensemble_score FROM vote),
pg AS (SELECT pl.*, gold.y FROM pl JOIN gold USING (par_id)),
ev AS (SELECT vote.*, gold.y FROM vote JOIN gold USING (par_id))"""


def _probs(spark, sf):
    return S.member_probs(D.member_logits(spark, sf))


def _vote(spark, sf, probs=None):
    return S.soft_vote(S.align_scores(probs if probs is not None else _probs(spark, sf)))


def _ens_preds(spark, sf):
    """Ensemble ``(par_id, y, pred, ensemble_score)`` on the labelled rows."""
    return _vote(spark, sf).join(D.gold_labels(spark, sf), "par_id")


def _all_preds(spark, sf):
    probs = _probs(spark, sf)
    return S.predictions_long(probs, _vote(spark, sf, probs), D.gold_labels(spark, sf))


@query("softmax_prob", f"WITH {_BASE}\nSELECT par_id, model, round(p, 6) AS p FROM probs")
def q_softmax_prob(spark, sf):
    from ..operators.common import r6
    return _probs(spark, sf).select("par_id", "model", r6(F.col("p")).alias("p"))


@query("argmax_class", f"WITH {_BASE}\nSELECT par_id, model, pred FROM probs")
def q_argmax_class(spark, sf):
    return _probs(spark, sf).select("par_id", "model", "pred")


_ROUND_ALIGN = ", ".join(f"round(p_{m}, 6) AS p_{m}" for m in ENSEMBLE_WEIGHTS)


@query("align_scores", f"WITH {_BASE}\nSELECT par_id, {_ROUND_ALIGN} FROM al")
def q_align_scores(spark, sf):
    from ..operators.common import r6
    a = S.align_scores(_probs(spark, sf))
    return a.select("par_id", *[r6(F.col(f"p_{m}")).alias(f"p_{m}") for m in ENSEMBLE_WEIGHTS])


@query("soft_vote", f"WITH {_BASE}\nSELECT par_id, ensemble_score, pred FROM vote")
def q_soft_vote(spark, sf):
    return _vote(spark, sf)


_METRICS = """SELECT {by}
  CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM {src} {group}"""

_DERIVED = """round(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn)::DOUBLE / (tp + fp + fn + tn) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1"""


@query("binary_metrics", f"""
WITH {_BASE}, c AS ({_METRICS.format(by='model,', src='pg', group='GROUP BY model')})
SELECT model, tp, fp, fn, tn, {_DERIVED} FROM c""")
def q_binary_metrics(spark, sf):
    return M.binary_metrics(_all_preds(spark, sf), "model")


@query("model_summary", f"""
WITH {_BASE}, c AS ({_METRICS.format(by='model,', src='pg', group='GROUP BY model')}),
m AS (SELECT model, {_DERIVED} FROM c)
SELECT model, accuracy, precision, recall, f1,
       accuracy = max(accuracy) OVER () AS best_accuracy, precision = max(precision) OVER () AS best_precision,
       recall = max(recall) OVER () AS best_recall, f1 = max(f1) OVER () AS best_f1 FROM m""")
def q_model_summary(spark, sf):
    return M.model_summary(_all_preds(spark, sf))


_CM = """cm AS (SELECT CAST(g1.v AS INTEGER) AS y, CAST(g2.v AS INTEGER) AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (SELECT range AS v FROM range(0, 2)) g1 CROSS JOIN (SELECT range AS v FROM range(0, 2)) g2
  LEFT JOIN (SELECT y, pred, count(*) AS n FROM ev GROUP BY y, pred) c ON c.y = g1.v AND c.pred = g2.v)"""


@query("confusion_matrix", f"WITH {_BASE}, {_CM}\nSELECT y, pred, n FROM cm")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_ens_preds(spark, sf), n_classes=2)


@query("confusion_matrix_norm", f"""
WITH {_BASE}, {_CM}
SELECT y, pred, n, round(CASE WHEN sum(n) OVER (PARTITION BY y) = 0 THEN 0.0
                        ELSE n / sum(n) OVER (PARTITION BY y) END, 6) AS rate FROM cm""")
def q_confusion_matrix_norm(spark, sf):
    return M.confusion_matrix_norm(M.confusion_matrix(_ens_preds(spark, sf), n_classes=2))


def _report_sql(src: str = "ev", by: str = "") -> str:
    """The report over ``src``, one for each value of the column ``by``."""
    col, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    rows = []
    for c in (0, 1):
        rows.append(f"""SELECT {col}{lit(LABEL_NAMES[c])} AS item,
  CASE WHEN pp{c} = 0 THEN 0.0 ELSE tp{c}::DOUBLE / pp{c} END AS precision,
  CASE WHEN s{c} = 0 THEN 0.0 ELSE tp{c}::DOUBLE / s{c} END AS recall,
  CASE WHEN pp{c} + s{c} = 0 THEN 0.0 ELSE (2 * tp{c})::DOUBLE / (pp{c} + s{c}) END AS f1, s{c} AS support FROM one""")
    one = ", ".join(
        [f"sum(CASE WHEN y = {c} AND pred = {c} THEN 1 ELSE 0 END) AS tp{c}" for c in (0, 1)]
        + [f"sum(CASE WHEN pred = {c} THEN 1 ELSE 0 END) AS pp{c}" for c in (0, 1)]
        + [f"sum(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS s{c}" for c in (0, 1)])
    return f"""WITH {_BASE}, one AS (SELECT {col}{one} FROM {src}{group}),
per AS ({' UNION ALL '.join(rows)}),
av AS (SELECT {col}avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
              sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
              sum(f1 * support) / sum(support) AS wf, sum(support) AS n FROM per{group}),
allr AS (SELECT * FROM per
  UNION ALL SELECT {col}'accuracy', NULL, NULL, CASE WHEN s0 + s1 = 0 THEN 0.0 ELSE (tp0 + tp1)::DOUBLE / (s0 + s1) END, s0 + s1 FROM one
  UNION ALL SELECT {col}'macro avg', mp, mr, mf, n FROM av
  UNION ALL SELECT {col}'weighted avg', wp, wr, wf, n FROM av)
SELECT {col}item, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allr"""


@query("classification_report", _report_sql())
def q_classification_report(spark, sf):
    return M.classification_report(_ens_preds(spark, sf))


@query("classification_reports", _report_sql("pg", "model"))
def q_classification_reports(spark, sf):
    """The report of every member and of the ensemble, from one aggregate."""
    return M.classification_report(_all_preds(spark, sf), by="model")


@query("score_stats", f"""
WITH {_BASE}
SELECT round(min(ensemble_score), 6) AS min_score, round(max(ensemble_score), 6) AS max_score,
       round(avg(ensemble_score), 6) AS mean_score, round(quantile_cont(ensemble_score, 0.5), 6) AS median_score,
       CAST(sum(pred) AS BIGINT) AS n_pos, count(*) AS n FROM vote""")
def q_score_stats(spark, sf):
    return M.score_stats(_vote(spark, sf))


@query("error_rate", f"""
WITH {_BASE}
SELECT CAST(sum(CASE WHEN pred <> y THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, count(*) AS n,
       round(sum(CASE WHEN pred <> y THEN 1 ELSE 0 END) * 100.0 / count(*), 6)::DOUBLE AS error_pct FROM ev""")
def q_error_rate(spark, sf):
    return M.error_rate(_ens_preds(spark, sf))


@query("misclassified", f"""
WITH {_BASE}
SELECT ev.par_id, p.text, ev.y AS true_label, ev.pred AS predicted_label, ev.ensemble_score
FROM ev JOIN para p USING (par_id) WHERE ev.pred <> ev.y""")
def q_misclassified(spark, sf):
    gold = D.paragraphs(spark, sf).select("par_id", "text", (F.col("label") >= 2).cast("int").alias("y"))
    return M.misclassified(_vote(spark, sf), gold)


_STRAT_TEST = """st AS (
  SELECT par_id FROM (SELECT par_id, binary_label,
         row_number() OVER (PARTITION BY binary_label ORDER BY md5('42:' || CAST(par_id AS VARCHAR)), par_id) AS rk,
         CAST(count(*) OVER (PARTITION BY binary_label) AS DOUBLE) AS n
         FROM (SELECT par_id, CAST(coalesce(label >= 2, false) AS INTEGER) AS binary_label FROM para))
  WHERE rk > floor(floor(n * 0.2 + 0.5) * 0.5) AND rk <= floor(n * 0.2 + 0.5))"""


@query("prediction_counts", f"""
WITH {_BASE}, {DEV}, {_STRAT_TEST}
SELECT 'dev' AS pred_set, count(*) AS n, CAST(sum(pred) AS BIGINT) AS n_pos FROM dev JOIN vote USING (par_id)
UNION ALL
SELECT 'test', count(*), CAST(sum(pred) AS BIGINT) FROM st JOIN vote USING (par_id)""")
def q_prediction_counts(spark, sf):
    vote = _vote(spark, sf)
    dev = D.dev_labels(spark, sf).select("par_id").join(vote, "par_id")
    parts = PR.stratified_split(D.paragraphs(spark, sf, with_text=False))
    test = parts.where(F.col("split") == "test").select("par_id").join(vote, "par_id")
    return M.prediction_counts({"dev": dev, "test": test})


@query("weighted_log_loss", f"""
WITH {_BASE}
SELECT model, round(sum(CASE WHEN y = 1 THEN {CLASS_WEIGHTS[1]} ELSE {CLASS_WEIGHTS[0]} END::DOUBLE
                     * ln(1.0 + exp(CASE WHEN y = 1 THEN z0 - z1 ELSE z1 - z0 END)))
                 / sum(CASE WHEN y = 1 THEN {CLASS_WEIGHTS[1]} ELSE {CLASS_WEIGHTS[0]} END::DOUBLE), 6) AS weighted_log_loss,
       count(*) AS n
FROM logits JOIN gold USING (par_id) GROUP BY model""")
def q_weighted_log_loss(spark, sf):
    return S.weighted_log_loss(D.member_logits(spark, sf), D.gold_labels(spark, sf))


_KC = """pd AS (SELECT label AS k, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
pm AS (SELECT k, dim, round(avg(v), 6) AS m FROM pd GROUP BY k, dim),
km AS (SELECT k, list(m ORDER BY dim) AS mean FROM pm GROUP BY k),
e AS (SELECT vec_id, any_value(label) AS y, list(round(list_sum(list_transform(list_zip(embedding, mean),
             lambda p: p[1]::DOUBLE * p[2])), 6) ORDER BY k) AS z FROM embeddings, km GROUP BY vec_id),
s AS (SELECT vec_id, y, z, list_max(z) AS m FROM e),
t AS (SELECT vec_id, y, CAST(list_position(z, m) - 1 AS INTEGER) AS pred,
             list_transform(z, lambda v: exp(v - m)) AS ex FROM s)"""


@query("k_class_scores", f"""
WITH {_KC}
SELECT vec_id, y, pred, round(ex[pred + 1] / list_sum(ex), 6) AS p_pred,
       round(ex[y + 1] / list_sum(ex), 6) AS p_true FROM t""")
def q_k_class_scores(spark, sf):
    return S.k_class_scores(D.embeddings_logits(spark, sf))


@query("confusion_matrix_k", f"""
WITH {_KC}, c AS (SELECT y, pred, count(*) AS n FROM t GROUP BY y, pred),
k AS (SELECT greatest(max(y), max(pred)) AS k FROM c)
SELECT CAST(g1.v AS INTEGER) AS y, CAST(g2.v AS INTEGER) AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM k, LATERAL (SELECT range AS v FROM range(0, k.k + 1)) g1, LATERAL (SELECT range AS v FROM range(0, k.k + 1)) g2
LEFT JOIN c ON c.y = g1.v AND c.pred = g2.v""")
def q_confusion_matrix_k(spark, sf):
    ks = S.k_class_scores(D.embeddings_logits(spark, sf))
    return M.confusion_matrix(ks.select("y", "pred"))

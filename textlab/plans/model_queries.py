"""Exact naive Bayes, epochs with the best kept, numbered checkpoints and
successive halving: model values that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS, SPLIT_SEED
from ..operators import bayes as NB
from ..operators import epochs as EP
from ..operators import metrics as M
from ..operators import search as SE
from ..session import scratch_path
from ..sources import driver as D
from ..sources.checkpoints import CheckpointFolder
from .ml_queries import _official
from .prep_queries import _TEXTS
from .registry import query
from .scoring_queries import _DERIVED, _METRICS
from .sqlparts import DEV, FILED, PARA, clean_of, content_of, lit, tokens_of, y_of

# The official split with binary labels, and the content tokens of a text.
_SPLIT = f"""{PARA}, {FILED}, {DEV}, {_TEXTS},
tr AS (SELECT p.par_id, {clean_of('p.text')} AS text, {y_of('p.label')} AS label
  FROM para p WHERE p.text IS NOT NULL AND p.label IS NOT NULL AND p.par_id NOT IN (SELECT par_id FROM dev)),
dv AS (SELECT dev.par_id, coalesce(tx.text, '') AS text, CAST(coalesce(regexp_matches(dev.label, '[1-9]'), false) AS INTEGER) AS label
  FROM dev LEFT JOIN tx ON dev.par_id = tx.par_id)"""

_CONTENT = content_of(tokens_of("coalesce(text, '')"))


def _dec(value: str) -> str:
    return f"CAST(round({value}, {NB.PLACES}) AS DECIMAL(12,{NB.PLACES}))"


def _bayes_sql(settings, name: str = "", train: str = "tr", docs: str = "dv") -> str:
    """CTEs ``w{name}`` (term weights) and ``m{name}`` (margins by setting number ``s``)."""
    values = ", ".join(f"({i}, {s.weight0}::DOUBLE, {s.weight1}::DOUBLE, {s.alpha}::DOUBLE)" for i, s in enumerate(settings))
    return f"""set{name}(s, w0, w1, a) AS (VALUES {values}),
c{name} AS MATERIALIZED (SELECT term, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::BIGINT AS f0, sum(label = 1)::BIGINT AS f1
  FROM (SELECT label, unnest({_CONTENT}) AS term FROM {train}) GROUP BY term),
t{name} AS MATERIALIZED (SELECT *, (SELECT coalesce(sum(label <> 1), 0) FROM {train})::DOUBLE AS n0, (SELECT coalesce(sum(label = 1), 0) FROM {train})::DOUBLE AS n1
  FROM (SELECT coalesce(sum(f0), 0)::DOUBLE AS t0, coalesce(sum(f1), 0)::DOUBLE AS t1, count(*)::DOUBLE AS v FROM c{name})),
w{name} AS MATERIALIZED (SELECT s, term, f0, f1, {_dec('ln((w1 * f1 + a) / (w1 * t1 + a * v)) - ln((w0 * f0 + a) / (w0 * t0 + a * v))')} AS llr
  FROM c{name}, t{name}, set{name}),
q{name} AS (SELECT s, {_dec('ln(w1 * n1 + a) - ln(w0 * n0 + a)')} AS prior FROM t{name}, set{name}),
f{name} AS MATERIALIZED (SELECT par_id, term, count(*) AS tf FROM (SELECT par_id, unnest({_CONTENT}) AS term FROM {docs}) GROUP BY par_id, term),
k{name} AS MATERIALIZED (SELECT s, par_id, sum(tf::DECIMAL(10,0) * llr) AS z FROM f{name} JOIN w{name} USING (term) GROUP BY s, par_id),
m{name} AS MATERIALIZED (SELECT q.s, d.par_id, d.label, (q.prior + coalesce(k.z, 0))::DOUBLE AS margin
  FROM {docs} d CROSS JOIN q{name} q LEFT JOIN k{name} k ON k.par_id = d.par_id AND k.s = q.s)"""


_DEFAULT = _bayes_sql([NB.Setting()])


@query("bayes_term_weights", f"WITH {_SPLIT},\n{_DEFAULT}\nSELECT term, f0, f1, llr::DOUBLE AS llr FROM w")
def q_bayes_term_weights(spark, sf):
    """The class-weighted naive Bayes model of the official train rows, term by term."""
    train, _ = _official(spark, sf)
    counts = NB.class_counts(train)
    return NB.term_weights(counts, NB.totals(counts, train)).select("term", "f0", "f1", F.col("llr")[0].cast("double").alias("llr"))


_SCORES = """SELECT par_id, label AS y, round(margin, 6) AS margin, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-margin)), 6) AS p,
       CAST(margin > 0 AS INTEGER) AS pred FROM m"""


@query("bayes_dev_scores", f"WITH {_SPLIT},\n{_DEFAULT}\n{_SCORES}")
def q_bayes_dev_scores(spark, sf):
    """Margin, probability and prediction of every dev row by the exact model."""
    train, dev = _official(spark, sf)
    rows = dev.select("par_id", "text", F.col("label").cast("int").alias("y"))
    return NB.bayes_scores(train, rows, keep=("par_id", "y"))


@query("bayes_dev_metrics", f"""
WITH {_SPLIT},
{_DEFAULT},
ev AS ({_SCORES}), cells AS ({_METRICS.format(by='', src='ev', group='')})
SELECT tp, fp, fn, tn, {_DERIVED} FROM cells""")
def q_bayes_dev_metrics(spark, sf):
    return M.binary_metrics(q_bayes_dev_scores(spark, sf), None)


# ------------------------------------------------------------------ epochs, checkpoints

EPOCHS = 8


def _epoch_sql() -> str:
    """The epochs written out one after the other: weights e, margins on dev, F1."""
    terms = f"list_distinct({_CONTENT})"
    idx = (f"list_sort(list_distinct(list_transform({terms}, lambda t: ('0x' || substr(md5(t), 1, 4))::INT)))")
    dec = lambda v: f"CAST(round({v}, 12) AS DECIMAL(24,12))"
    parts = [_SPLIT,
             f"xt AS MATERIALIZED (SELECT par_id, label AS y, {idx} AS idx FROM tr)",
             f"xd AS MATERIALIZED (SELECT par_id, label AS y, {idx} AS idx FROM dv)",
             f"mass AS (SELECT sum(CASE WHEN y = 1 THEN {CLASS_WEIGHTS[1]} ELSE {CLASS_WEIGHTS[0]} END::DOUBLE) AS mass FROM xt)",
             "e0 AS (SELECT 0 AS bucket, 0.0::DOUBLE AS w WHERE false)"]
    vector = "(SELECT list(coalesce(w, 0.0) ORDER BY b) FROM range(-1, 65536) r(b) LEFT JOIN {e} ON bucket = b)"
    margin = ("list_reduce(list_transform(idx, lambda i: v[i + 2]), lambda a, b: a + b, 0.0::DOUBLE)"
              " * (1.0::DOUBLE / sqrt(greatest(len(idx), 1)::DOUBLE)) + v[1]")
    rows = []
    for n in range(1, EPOCHS + 1):
        prev = f"e{n - 1}"
        parts += [
            f"v{n} AS MATERIALIZED (SELECT {vector.format(e=prev)} AS v)",
            f"""g{n} AS MATERIALIZED (SELECT y, idx, {margin} AS z, CASE WHEN y = 1 THEN {CLASS_WEIGHTS[1]} ELSE {CLASS_WEIGHTS[0]} END::DOUBLE AS cw FROM xt, v{n})""",
            f"""h{n} AS (SELECT bucket, sum(CASE WHEN bucket = -1 THEN r0 ELSE r END) AS g FROM (
  SELECT unnest(list_prepend(-1, idx)) AS bucket, {dec('cw * (y - 1.0::DOUBLE / (1.0::DOUBLE + exp(-z)))')} AS r0,
         {dec('cw * (y - 1.0::DOUBLE / (1.0::DOUBLE + exp(-z))) * (1.0::DOUBLE / sqrt(greatest(len(idx), 1)::DOUBLE))')} AS r
  FROM g{n}) GROUP BY bucket)""",
            f"""e{n} AS MATERIALIZED (SELECT coalesce(e.bucket, h.bucket) AS bucket,
  {dec(f'coalesce(e.w, 0.0)::DOUBLE + coalesce(CASE WHEN h.bucket = -1 THEN {EP.BIAS_RATE} ELSE {EP.RATE} END::DOUBLE * h.g::DOUBLE / (SELECT mass FROM mass), 0.0)')}::DOUBLE AS w
  FROM {prev} e FULL JOIN h{n} h USING (bucket))""",
            f"u{n} AS MATERIALIZED (SELECT {vector.format(e=f'e{n}')} AS v)",
            f"d{n} AS (SELECT y, CAST({margin} > 0 AS INTEGER) AS pred FROM xd, u{n})"]
        rows.append(f"SELECT {n} AS epoch, c.* FROM ({_METRICS.format(by='', src=f'd{n}', group='')}) c")
    parts.append("c AS MATERIALIZED (" + "\nUNION ALL ".join(rows) + ")")
    # best: the highest F1 of the epochs that ran, the earliest of equal ones; a stop after PATIENCE epochs without a gain
    parts.append(f"f AS MATERIALIZED (SELECT epoch, tp, fp, fn, tn, {_DERIVED} FROM c)")
    parts.append(f"""st AS (SELECT epoch, max(f1) OVER (ORDER BY epoch ROWS BETWEEN {EP.PATIENCE - 1} PRECEDING AND CURRENT ROW) AS late,
  max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND {EP.PATIENCE} PRECEDING) AS early FROM f)""")
    parts.append("""ran AS MATERIALIZED (SELECT f.* FROM f WHERE epoch <= coalesce((SELECT min(epoch) FROM st WHERE early IS NOT NULL AND late <= early), 1000))""")
    return "WITH " + ",\n".join(parts)


_EPOCHS_SQL = _epoch_sql()
_BEST = "(SELECT arg_min(epoch, (-f1, epoch)) FROM ran)"


def _trained(spark, sf):
    train, dev = _official(spark, sf)
    return EP.train_epochs(train, dev, scratch_path(spark, "member-epochs"), EPOCHS), dev


@query("epoch_history", f"{_EPOCHS_SQL}\nSELECT epoch, tp, fp, fn, tn, f1, epoch = {_BEST} AS is_best FROM ran")
def q_epoch_history(spark, sf):
    """F1 on dev after every epoch of the linear member; each epoch is a checkpoint."""
    return EP.history(_trained(spark, sf)[0])


@query("epoch_best_reload", f"{_EPOCHS_SQL}\nSELECT epoch, f1, true AS same FROM ran WHERE epoch = {_BEST}")
def q_epoch_best_reload(spark, sf):
    """The best checkpoint, read again from its folder, has the F1 that its marker states."""
    return EP.reload_best(*_trained(spark, sf))


_STEPS = {900: 2, 1000: 1, 1100: 0}


@query("checkpoint_choice", f"""
WITH {PARA},
p AS (SELECT text, label, ('0x' || substr(md5('{SPLIT_SEED}:' || CAST(par_id AS VARCHAR)), 1, 4))::INT AS place FROM para)
{" UNION ALL ".join(f'''
SELECT {step}::BIGINT AS step, {'false' if step == 1100 else 'true'} AS committed, {'true' if step == 1000 else 'false'} AS chosen,
       count(DISTINCT term) AS n_terms FROM (SELECT unnest({_CONTENT}) AS term FROM p WHERE place < {SE.RANGE} // {2 ** half})'''
                    for step, half in _STEPS.items())}""")
def q_checkpoint_choice(spark, sf):
    """Three checkpoints of a naive Bayes member, counted on growing samples, the last one without
    its marker: 1000 is chosen over 900 and over the unfinished 1100."""
    rows = D.paragraphs(spark, sf).select("par_id", "text", (F.col("label") >= 2).cast("int").alias("label"))
    store = CheckpointFolder(spark, scratch_path(spark, "member-steps"))
    for step, half in _STEPS.items():
        counts = {"counts": NB.class_counts(rows.where(SE.hash_place("par_id") < SE.RANGE // 2 ** half))}
        if step == 1100:
            store.write_tables(step, counts)
        else:
            store.save(step, counts)
    sizes = [store.load(step, "counts").agg(F.count(F.lit(1)).alias("n_terms"))
             .select(F.lit(step).cast("long").alias("step"), "n_terms") for step in _STEPS]
    return store.overview("counts").join(sizes[0].unionByName(sizes[1]).unionByName(sizes[2]), "step")


# ------------------------------------------------------------------ successive halving

def _labelled(spark, sf):
    return D.paragraphs(spark, sf).where(F.col("text").isNotNull()).select(
        "par_id", "text", (F.col("label") >= 2).cast("int").alias("label"))


_PLACED = f"""{PARA},
pl AS MATERIALIZED (SELECT par_id, text, {y_of()} AS label,
  ('0x' || substr(md5('{SPLIT_SEED}:' || CAST(par_id AS VARCHAR)), 1, 4))::INT AS place FROM para WHERE text IS NOT NULL),
va AS MATERIALIZED (SELECT par_id, text, label FROM pl WHERE place >= {SE.TRAIN_UNTIL})"""


def _halving_bayes_sql() -> str:
    trials = SE.draw_trials("exact_bayes")
    settings = [NB.Setting(CLASS_WEIGHTS[0], t.params["class_weight"], t.params["alpha"]) for t in trials]
    parts, out = [_PLACED], []
    for r in range(SE.RUNGS):
        alive = "" if r == 0 else f"WHERE s IN (SELECT s FROM z{r - 1} WHERE place <= {SE.survivors_of(r - 1)})"
        parts += [f"tr{r} AS MATERIALIZED (SELECT par_id, text, label FROM pl WHERE place < {SE.rung_until(r)})",
                  _bayes_sql(settings, f"_{r}", f"tr{r}", "va"),
                  f"""x{r} AS (SELECT s, sum(label = 1 AND margin > 0) AS tp, sum(label <> 1 AND margin > 0) AS fp,
  sum(label = 1 AND NOT margin > 0) AS fn FROM m_{r} {alive} GROUP BY s)""",
                  f"""z{r} AS MATERIALIZED (SELECT s, f1, row_number() OVER (ORDER BY round(f1, 9) DESC, s) AS place FROM (
  SELECT s, CASE WHEN tp > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM x{r}))"""]
        out.append(f"""SELECT {r} AS rung, z.s AS trial, q.w1 AS class_weight, q.a AS alpha, round(f1, 6) AS f1,
       place <= {SE.survivors_of(r)} AS survived, (SELECT count(*) FROM tr{r}) AS n_train, (SELECT count(*) FROM va) AS n_valid
  FROM z{r} z JOIN set_{r} q USING (s)""")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(out)


@query("halving_search_bayes", _halving_bayes_sql())
def q_halving_search_bayes(spark, sf):
    """Successive halving of the exact naive Bayes member: every objective is checked by SQL."""
    return SE.successive_halving(_labelled(spark, sf), {"exact_bayes": SE.bayes_member}).select(
        "rung", "trial", "class_weight", "alpha", "f1", "survived", "n_train", "n_valid")


@query("halving_search")
def q_halving_search(spark, sf):
    """The whole search over all three members: one row per member, rung and trial."""
    return SE.successive_halving(_labelled(spark, sf))


def _rungs_sql() -> str:
    rows, n = [], SE.TRIALS
    for r in range(SE.RUNGS):
        rows += [f"({lit(m)}, {r}, {n}, {SE.survivors(n)})" for m in SE.MEMBERS]
        n = SE.survivors(n)
    until = " ".join(f"WHEN {r} THEN {SE.rung_until(r)}" for r in range(SE.RUNGS))
    return f"""
WITH {_PLACED}, g(member, rung, n_trials, n_survivors) AS (VALUES {", ".join(rows)})
SELECT member, rung, n_trials::BIGINT AS n_trials, n_survivors::BIGINT AS n_survivors,
       (SELECT count(*) FROM pl WHERE place < CASE rung {until} END) AS n_train, (SELECT count(*) FROM va) AS n_valid,
       true AS cut_right FROM g"""


@query("halving_search_rungs", _rungs_sql())
def q_halving_search_rungs(spark, sf):
    """Trials, survivors and rows of every rung, and whether each cut kept the best."""
    return SE.rung_summary(q_halving_search(spark, sf))

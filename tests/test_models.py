"""Exact naive Bayes, epochs and checkpoints, successive halving, levels,
sketches, the subword hook and the open vote: brute force and edge rows."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textlab.functions.subword import encoded_lengths, encoder, library_bytes, library_encoder
from textlab.operators import bayes as NB
from textlab.operators import epochs as EP
from textlab.operators import levels as LV
from textlab.operators import lengths as LN
from textlab.operators import ml as ML
from textlab.operators import profile as P
from textlab.operators import scoring as S
from textlab.operators import search as SE
from textlab.operators import sketches as SK
from textlab.sources.checkpoints import CheckpointFolder

ROWS = "par_id long, text string, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def made(n, seed=1):
    """Rows whose positive texts lean to the first words."""
    rng, out = random.Random(seed), []
    for i in range(n):
        y = int(rng.random() < 0.3)
        words = WORDS[:5] if y else WORDS[3:]
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), y))
    return out


def brute_margin(train, text, s):
    f = [Counter(), Counter()]
    for _, t, y in train:
        f[y].update((t or "").split())
    n = [sum(y == c for _, _, y in train) for c in (0, 1)]
    total, v = [sum(c.values()) for c in f], len(set(f[0]) | set(f[1]))
    w = (s.weight0, s.weight1)
    z = math.log(w[1] * n[1] + s.alpha) - math.log(w[0] * n[0] + s.alpha)
    for t in (text or "").split():
        if t in f[0] or t in f[1]:
            p = [(w[c] * f[c][t] + s.alpha) / (w[c] * total[c] + s.alpha * v) for c in (0, 1)]
            z += math.log(p[1]) - math.log(p[0])
    return z


def test_bayes_matches_brute_force(spark):
    train = made(60)
    docs = [*made(25, seed=2), (900, None, 0), (901, "", 1), (902, "unknown words only", 0), (903, "alpha " * 5000, 1)]
    settings = (NB.Setting(), NB.Setting(1.0, 3.5, 0.2))
    tr, df = spark.createDataFrame(train, ROWS), spark.createDataFrame(docs, ROWS)
    counts = NB.class_counts(tr)
    total = NB.totals(counts, tr)
    got = {r.par_id: r.margin for r in NB.margins(df, NB.term_weights(counts, total, settings), total, settings).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        known = text.replace("unknown words only", "") if text else text
        for k, s in enumerate(settings):
            assert got[i][k] == pytest.approx(brute_margin(train, known, s), abs=1e-4 if i == 903 else 1e-6)


def test_bayes_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    some = spark.createDataFrame([(1, "alpha", 1)], ROWS)
    assert NB.bayes_scores(some, none).count() == 0
    assert NB.bayes_scores(none, some).collect()[0].margin == 0.0


def test_checkpoints_by_number_and_commit(spark, tmp_dir):
    store = CheckpointFolder(spark, tmp_dir + "/member")
    assert store.newest() is None and store.best("f1") is None and store.overview("w").count() == 0
    table = spark.range(3)
    for step, f1 in ((900, 0.5), (1000, 0.4), (20, 0.5)):
        store.save(step, {"w": table.withColumn("step", F.lit(step))}, {"f1": f1})
    store.write_tables(1100, {"w": table})
    assert store.newest() == 1000 and store.best("f1") == 20
    assert store.load(store.newest(), "w").first().step == 1000
    got = {(r.step, r.committed, r.chosen) for r in store.overview("w").collect()}
    assert got == {(20, True, False), (900, True, False), (1000, True, True), (1100, False, False)}
    store.save(1100, {"w": table})  # finished at the second attempt
    assert store.newest() == 1100


def gradient_step(rows, w, b):
    mass = sum(9.0 if y else 1.0 for _, _, y in rows)
    g, gb = Counter(), 0.0
    for _, t, y in rows:
        terms = set((t or "").split())
        x = 1 / math.sqrt(max(len(terms), 1))
        z = sum(w.get(a, 0.0) for a in terms) * x + b
        r = (9.0 if y else 1.0) * (y - 1 / (1 + math.exp(-z)))
        gb += r
        for a in terms:
            g[a] += r * x
    return ({a: w.get(a, 0.0) + EP.RATE * g[a] / mass for a in set(w) | set(g)}, b + EP.BIAS_RATE * gb / mass)


def test_epochs_follow_the_gradient_resume_and_keep_the_best(spark, tmp_dir):
    train, valid = made(80, 3), made(40, 4) + [(999, None, 1)]
    tr, va = spark.createDataFrame(train, ROWS), spark.createDataFrame(valid, ROWS)
    straight = EP.train_epochs(tr, va, tmp_dir + "/a", 3, patience=5)
    EP.train_epochs(tr, va, tmp_dir + "/b", 1, patience=5)
    CheckpointFolder(spark, tmp_dir + "/b").write_tables(2, {"weights": spark.range(1)})  # a run that was lost
    resumed = EP.train_epochs(tr, va, tmp_dir + "/b", 3, patience=5)
    weights = [{r.bucket: r.w for r in s.load(3, "weights").collect()} for s in (straight, resumed)]
    assert weights[0] == weights[1]
    w, b = {}, 0.0
    for _ in range(3):
        w, b = gradient_step(train, w, b)
    bucket = {r.t: r.b for r in spark.createDataFrame([(x,) for x in WORDS], "t string")
              .select("t", EP.hashed_terms("t")[0].alias("b")).collect()}
    assert float(weights[0][-1]) == pytest.approx(b, abs=1e-9)
    for t in w:
        assert float(weights[0][bucket[t]]) == pytest.approx(w[t], abs=1e-9)
    rows = EP.history(straight).collect()
    best = max(rows, key=lambda r: (r.f1, -r.epoch))
    assert [r.epoch for r in rows if r.is_best] == [best.epoch]
    again = EP.reload_best(straight, va).first()
    assert (again.epoch, again.f1, again.same) == (best.epoch, best.f1, True)


def test_epochs_stop_without_gain(spark, tmp_dir):
    same = [(i, "alpha beta", i % 2) for i in range(10)]
    df = spark.createDataFrame(same, ROWS)
    store = EP.train_epochs(df, df, tmp_dir + "/m", 9, patience=2)
    f1 = [json.loads(r.note)["f1"] for r in store.committed().orderBy("step").collect()]
    assert len(f1) < 9 and max(f1[-2:]) <= max(f1[:-2])
    assert EP.train_epochs(spark.createDataFrame([], ROWS), df, tmp_dir + "/n", 2).newest() is None


def test_halving_keeps_the_best_and_samples_grow(spark):
    rows = spark.createDataFrame(made(300, 5), ROWS)
    seen = []

    def member(train, valid, trials):
        seen.append(({r.par_id for r in train.select("par_id").collect()}, {r.par_id for r in valid.select("par_id").collect()}))
        return {t.number: (t.number * 7 % 5) / 10 for t in trials}

    table = SE.successive_halving(rows, {"made": member}, trials=7, rungs=3, eta=2)
    got = {r: sorted(x.trial for x in table.where(f"rung = {r} and survived").collect()) for r in range(3)}
    f1 = {n: (n * 7 % 5) / 10 for n in range(7)}
    alive = list(range(7))
    for r in range(3):
        alive = sorted(sorted(alive, key=lambda n: (-f1[n], n))[:-(-len(alive) // 2)])
        assert got[r] == alive
    assert seen[0][0] < seen[1][0] < seen[2][0]
    assert all(not (t & v) for t, v in seen) and seen[2][0] | seen[2][1] == set(range(300))
    assert all(r.cut_right for r in SE.rung_summary(table).collect())


def test_halving_members_learn(spark):
    rows = spark.createDataFrame(made(240, 6), ROWS)
    table = SE.successive_halving(rows, {m: SE.MEMBERS[m] for m in ("exact_bayes", "tfidf_logreg")}, trials=3, rungs=2, eta=3)
    last = {r.member: r for r in table.where("rung = 1 and survived").collect()}
    assert set(last) == {"exact_bayes", "tfidf_logreg"}
    assert all(r.f1 > 0.5 for r in last.values())
    assert {r.class_weight for r in table.collect()} > {9.0}


LEVEL_ROWS = [(k, y, n) for k in ("a", "b", None) for y in (0, 3, None) for n in (1, 2, 2, 9)]


def test_length_levels_tell_null_keys_from_totals(spark):
    df = spark.createDataFrame(LEVEL_ROWS, "keyword string, label int, n_tokens long")
    got = {(r.level, r.keyword, r.binary_label): (r.n, r.p50, r.p99) for r in LV.length_levels(df).collect()}
    assert got[LV.TOTAL, None, None] == (36, 2, 9)
    assert got[LV.BY_CLASS, None, 1] == (12, 2, 9) and got[LV.BY_CLASS, None, 0] == (24, 2, 9)
    assert got[LV.BY_KEYWORD_CLASS, None, 1][0] == 4 and got[LV.BY_KEYWORD_CLASS, "a", 0][0] == 8
    assert len(got) == 9


def test_rollup_and_pivot(spark):
    df = spark.createDataFrame([("a", "x", 0), ("a", "y", 4), (None, "x", 2), ("b", None, 7)],
                               "keyword string, country_code string, label int")
    got = {(r.level, r.keyword, r.country_code): (r.n, r.n_pcl) for r in LV.counts_rollup(df).collect()}
    assert got[3, None, None] == (4, 3) and got[1, "a", None] == (2, 1) and got[1, None, None] == (1, 1)
    assert got[0, "b", None] == (1, 1)
    wide = {r.keyword: tuple(r)[1:] for r in LV.labels_by_keyword(df).collect()}
    assert wide == {"a": (1, 0, 0, 0, 1), "b": (0, 0, 0, 0, 0)}  # 7 is no stated value


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 5).cast("string").alias("g"), (F.col("id") % 23_000).alias("v"))
    est = SK.distinct_estimates(SK.distinct_sketches(df, "g", "v"), "g")
    checked = SK.distinct_check(est, SK.exact_distinct(df, "g", "v")).collect()
    assert {r.scope for r in checked} == {"all", "0", "1", "2", "3", "4"} and all(r.within for r in checked)
    assert {r.n_exact for r in checked if r.scope == "all"} == {23_000}
    q = SK.quantile_estimates(SK.quantile_sketches(df, "g", "v"), "g")
    ranks = SK.quantile_check(q, df, "g", "v").collect()
    assert len(ranks) == 30 and all(r.within for r in ranks)
    off = q.withColumn("estimate", F.col("estimate") + 3000)
    assert not all(r.within for r in SK.quantile_check(off, df, "g", "v").collect())


SUBWORDS = "byte_bpe_50k.json"


def test_subword_lengths_equal_the_tokenizer(spark):
    P_ = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(P_.path(SUBWORDS))
    model.encode_special_tokens = True
    rows = [(1, "one text of some words"), (2, ""), (3, None), (4, "x " * 30_000), (5, "é中文\U0001f600 <|endoftext|>"), (5, "again")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(((r.id, r.n_tokens, r.n_kept, r.truncated) for r in
                  encoded_lengths(df, "test", library_encoder(P_.path(SUBWORDS)), 4, "id").collect()), key=str)
    want = []
    for i, t in rows:
        n = None if t is None else len(model.encode(t, add_special_tokens=False).ids)
        want.append((i, n, None if n is None else min(n, 4), None if n is None else n > 4))
    assert got == sorted(want, key=str)
    bytes_ = {r.id: r.n_tokens for r in encoded_lengths(df.where("id < 5"), "test-bytes", library_bytes(P_.path(SUBWORDS)), 4, "id").collect()}
    assert bytes_ == {i: None if t is None else len(t.encode()) for i, t in rows if i < 5}
    assert encoded_lengths(df.limit(0), "test", library_encoder(P_.path(SUBWORDS)), 4, "id").count() == 0
    lt = LN.length_table(df.sparkSession.createDataFrame([(1, n) for _, n, _, _ in want if n is not None], "label int, n_tokens long"))
    assert LN.length_percentiles(lt).count() == 5


def test_encoder_is_loaded_once():
    calls = []
    load = lambda: calls.append(1) or (lambda texts: [t.split() for t in texts])
    assert encoder("once", load) is encoder("once", load) and calls == [1]


def test_open_vote_needs_every_member_once(spark):
    weights = [("a", 1.2), ("b", 0.9), ("c", 0.9)]
    probs = [(1, m, 0.46) for m in "abc"] + [(2, "a", 0.9), (2, "b", 0.9)] + [(3, m, 0.47) for m in "abc"] + \
            [(4, "a", 0.9), (4, "a", 0.9), (4, "b", 0.1)] + [(5, m, 0.5) for m in "abcz"] + [(6, "a", None), (6, "b", 0.5), (6, "c", 0.5)]
    got = {r.par_id: (r.ensemble_score, r.pred) for r in S.soft_vote_open(
        spark.createDataFrame(probs, "par_id long, model string, p double"),
        spark.createDataFrame(weights, "model string, weight double")).collect()}
    assert got[1] == (0.46, 0)  # exactly the threshold is not above it
    assert got[3] == (0.47, 1) and got[5] == (0.5, 1)
    assert got[2] == got[4] == got[6] == (None, None)


def test_log_loss_of_large_margins(spark):
    logits = spark.createDataFrame([(1, "m", 900.0, 0.0), (2, "m", 0.0, -900.0), (3, "m", 1.0, 2.0)],
                                   "par_id long, model string, z0 double, z1 double")
    gold = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "par_id long, y int")
    got = S.weighted_log_loss(logits, gold).first()
    want = (9 * 900 + 0 + 9 * math.log1p(math.exp(-1))) / 19
    assert got.weighted_log_loss == pytest.approx(want, abs=1e-6)


def test_artifact_examples_of_repeated_ids(spark):
    texts = spark.createDataFrame([(1, "zz <b>x</b>"), (1, "aa <i>y</i>"), (1, "a plain copy"), (2, "plain")], "par_id long, text string")
    flags = texts.select("par_id", *[c.alias(n) for n, c in P.pattern_flags(P.ARTIFACT_PATTERNS).items()])
    rows = P.artifact_profile(flags, texts).collect()
    assert len(rows) == len(P.ARTIFACT_PATTERNS)
    assert {r.example for r in rows if r.example} == {"aa <i>y</i>"}


def test_country_limit_bites(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(20) for _ in range(i + 1)] + [(None,)], "country_code string")
    got = [r.country_code for r in P.country_distribution(df).collect()]
    assert got == [f"c{i:02d}" for i in range(19, 4, -1)]


def test_external_scores_of_an_empty_table(spark, tmp_dir):
    from textlab.plans import ml_queries as MQ
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(tmp_dir + "/embeddings.parquet")
    assert MQ.q_external_batch_scores(spark, tmp_dir).count() == 0
    assert MQ.q_external_batch_agreement(spark, tmp_dir).first().n == 0


def test_members_share_one_pass_over_the_texts_and_few_partitions(spark):
    rows = [(i, f"{'good nice day' if i % 3 else 'poor sad folk'} number {i}", float(i % 3 == 0), 1.0) for i in range(60)]
    train = spark.createDataFrame(rows, "par_id long, text string, label double, weight double").repartition(40)
    fronts, counts = ML.featurize(train, 1, 2)
    try:
        assert set(fronts) == {1, 2} and counts.columns == ["par_id", "label", "weight", "tf1", "tf2"]
        for stages, feats in fronts.values():
            assert feats.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and feats.count() == 60
    finally:
        counts.unpersist()
    models = ML.train_members(train)
    assert list(models) == list(ML.MEMBER_WEIGHTS)
    scored = ML.score_wide(models, train.select("par_id", "text")).collect()
    assert len(scored) == 60 and all(r[f"pred_{m}"] == int(r.par_id % 3 == 0) for r in scored for m in ("tfidf_logreg", "naive_bayes"))

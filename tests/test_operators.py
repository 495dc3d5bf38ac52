"""Operator-level checks: goldens from the published outputs, properties,
and brute-force comparisons for the scale-oriented rewrites."""

import math

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlab.constants import ENSEMBLE_THRESHOLD
from textlab.operators import lengths as LN
from textlab.operators import lexical as L
from textlab.operators import metrics as M
from textlab.operators import prep as PR
from textlab.operators import profile as P
from textlab.operators import scoring as S
from textlab.operators.common import top_k_per_group
from textlab.sources import driver as D

from conftest import SF001, SF01


def test_log_odds_goldens(spark):
    # published totals: N1 = 24,943, N0 = 221,138; V inside 28,341..28,358
    pairs = [(5, 0, 3.335), (4, 0, 3.153), (3, 0, 2.930), (0, 66, -2.661), (6, 445, -2.611),
             (3, 235, -2.534), (0, 53, -2.445), (1, 107, -2.445), (0, 52, -2.427), (0, 51, -2.408),
             (1, 101, -2.388), (1, 98, -2.358)]
    V = 28350
    rows = [(f"t{i}", f1, f0) for i, (f1, f0, _) in enumerate(pairs)]
    n1 = 24943 - sum(p[0] for p in pairs)
    n0 = 221138 - sum(p[1] for p in pairs)
    filler = V - len(pairs)
    # one term carries the remaining mass, the others are zero-sum padding
    rows.append(("rest_pos", n1, 0))
    rows.append(("rest_neg", 0, n0))
    rows += [(f"pad{i}", 0, 0) for i in range(filler - 2)]
    freq = spark.createDataFrame(rows, "term string, pcl_freq long, non_pcl_freq long")
    got = {r.term: r.log_odds for r in L.log_odds(freq).where(F.col("term").startswith("t")).collect()}
    for i, (_, _, want) in enumerate(pairs):
        assert round(got[f"t{i}"], 3) == want


def test_percentile_truncation(spark):
    vals = [1, 2, 2, 7, 9, 30, 31, 80]
    df = spark.createDataFrame([(1, v) for v in vals], "label int, n_tokens long")
    lt = LN.length_table(df.withColumn("label", F.lit(3)))
    got = {r.percentile: r.all_docs for r in LN.length_percentiles(lt, (50, 90, 95)).collect()}
    assert got == {"P50": 8, "P90": 45, "P95": 62}


def test_shares_sum_to_100(spark):
    p = D.paragraphs(spark, SF01, with_text=False)
    for df in (P.label_distribution(p), P.keyword_distribution(p), P.country_distribution(p)):
        assert abs(sum(r.pct for r in df.collect()) - 100.0) < 1e-3


def test_stratified_split_matches_row_number(spark):
    p = D.paragraphs(spark, SF01, with_text=False)
    # one hex digit -> 16 buckets, so most rows land in straddling buckets
    for digits in (1, 4):
        fast = {r.par_id: r.split for r in PR.stratified_split(p, hex_digits=digits).collect()}
        h = F.md5(F.concat(F.lit("42:"), F.col("par_id").cast("string")))
        w = Window.partitionBy("y").orderBy(h, "par_id")
        b = (p.select("par_id", (F.col("label") >= 2).cast("int").alias("y"))
             .withColumn("rk", F.row_number().over(w))
             .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("y"))))
        ref = {}
        for r in b.collect():
            hq = math.floor(r.n * 0.2 + 0.5)
            ref[r.par_id] = "val" if r.rk <= hq // 2 else ("test" if r.rk <= hq else "train")
        assert fast == ref
    # parts are disjoint and complete
    assert len(fast) == p.count()


def test_stream_bigrams_match_the_whole_stream(spark):
    p = D.paragraphs(spark, SF001).withColumn("par_id", F.col("par_id") * 1_000_003 + 10**15)  # sparse ids
    from textlab.functions.text import content_tokens, tokenize
    rows = (p.where(F.col("text").isNotNull())
            .select("par_id", (F.col("label") >= 2).cast("int").alias("y"),
                    content_tokens(tokenize("text")).alias("t")).collect())
    streams, brute = {}, {}
    for r in sorted(rows, key=lambda r: r.par_id):
        streams.setdefault(r.y, []).extend(r.t)
    for y, s in streams.items():
        for a, b in zip(s, s[1:]):
            brute[y, f"{a} {b}"] = brute.get((y, f"{a} {b}"), 0) + 1
    for blocks in (2, 64):
        got = {(r.binary_label, r.ngram): r.freq for r in L.stream_bigram_counts(p, blocks=blocks).collect()}
        assert got == brute


def test_top_k_per_group_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).alias("v"),
                                     F.col("id"))
    got = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5)
    w = Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))
    ref = df.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    assert sorted(map(tuple, got.select("g", "v", "id", "rank").collect())) == \
        sorted(map(tuple, ref.select("g", "v", "id", "rank").collect()))


def test_vote_strict_threshold(spark):
    # a weighted sum of exactly the threshold is not positive
    p = ENSEMBLE_THRESHOLD / 3.0
    df = spark.createDataFrame([(1, p, p, p)], "par_id long, p_RoBERTa double, p_ModernBERT double, p_MPNet double")
    w = {"RoBERTa": 1.0, "ModernBERT": 1.0, "MPNet": 1.0}
    exact = spark.createDataFrame([(1, 0.5, 0.5, 0.38)], "par_id long, p_RoBERTa double, p_ModernBERT double, p_MPNet double")
    assert S.soft_vote(exact, w).first().pred == 0
    assert S.soft_vote(df.withColumn("p_MPNet", F.lit(0.99)), w).first().pred == 1


def test_metrics_zero_division_and_confusion_sum(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, pred int")
    m = M.binary_metrics(df, None).first()
    assert m.precision == 0.0 and m.f1 == 0.0 and m.recall == 0.0
    cm = M.confusion_matrix(df, n_classes=2)
    assert sum(r.n for r in cm.collect()) == 3 and cm.count() == 4


def test_ngram_count_property(spark):
    p = D.paragraphs(spark, SF001)
    from textlab.functions.text import content_tokens, tokenize
    sizes = [r[0] for r in p.where(F.col("text").isNotNull())
             .select(F.size(content_tokens(tokenize("text")))).collect()]
    assert L.class_ngrams(p, 2).count() == sum(max(s - 1, 0) for s in sizes)


def test_cdf_ends_at_one(spark):
    lt = LN.length_table(D.paragraphs(spark, SF001, derive={"n_tokens": F.size(F.split("text", " "))},
                                      with_text=False))
    last = LN.length_cdf(lt).orderBy(F.desc("n_tokens")).first()
    assert last.cdf == 1.0


def test_dedup_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "k long, v string, pos long")
    first = {r.k: r.v for r in PR.dedup_by_key(df, "k", "pos", "first").collect()}
    last = {r.k: r.v for r in PR.dedup_by_key(df, "k", "pos", "last").collect()}
    assert first == {1: "a", 2: "c"} and last == {1: "b", 2: "c"}


def test_dedup_needs_a_position(spark):
    with pytest.raises(ValueError):
        PR.dedup_by_key(spark.range(3), "id", "id")


def test_repeated_id_gives_first_or_last_text(spark):
    rows = [(1, "B", 5), (1, "A", 2), (2, "C", 9)]
    p = spark.createDataFrame(rows, "par_id long, text string, pos long").repartition(3)
    assert {r.par_id: r.text for r in PR.text_by_id(p, keep="first").collect()} == {1: "A", 2: "C"}
    assert {r.par_id: r.text for r in PR.text_by_id(p, keep="last").collect()} == {1: "B", 2: "C"}


def test_unknown_id_raises_in_strict_lookup(spark):
    dev = spark.createDataFrame([(0, 7, "[1]")], "pos long, par_id long, label string")
    p = spark.createDataFrame([(1, "a", 0)], "par_id long, text string, pos long")
    with pytest.raises(Exception, match="unknown id"):
        PR.strict_lookup(dev, p).collect()


def test_strict_cast_raises_on_a_bad_value(spark):
    from textlab.functions.labels import strict_cast
    df = spark.createDataFrame([("12",), ("x",)], "v string")
    with pytest.raises(Exception, match="cannot cast value"):
        df.select(strict_cast("v", "bigint")).collect()


def test_ids_keep_their_digits(spark):
    from textlab.functions.labels import coerce_id
    values = ["9007199254740993", " 12 ", "12.0", "12d", "1e2", "x", "", None, "-3", "99999999999999999999"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(coerce_id("v")).collect()] == [9007199254740993, 12, 12, None, 100, None, None, None, -3, None]


def test_leakage_makes_no_pairs_of_a_repeated_id(spark):
    rows = [(7, 0, "same")] * 200 + [(i, 0, f"text {i}") for i in range(100, 300)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "par_id long, label int, text_key string, pos long")
    parts = PR.stratified_split(df, carry=("text_key",), copies="pos")
    train = parts.where(F.col("split") == "train").count()
    assert PR.split_leakage(parts).count() <= train and parts.count() == 400


def test_span_offsets_are_linear_in_sentences(spark):
    text = "One sentence. " * 20_000
    df = spark.createDataFrame([(1, text)], "par_id long, text string")
    rows = D.span_rows(df).collect()
    assert len(rows) == 20_001 or len(rows) == 20_000
    assert all(text[r.span_start:r.span_finish] == r.span_text for r in rows)


def test_log_odds_tokenises_once(spark):
    from textlab.plans import QUERIES, load_all
    load_all()
    df = QUERIES["log_odds"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the totals read the exchange that the term table wrote
    assert "ReusedExchange [term" in plan


def test_stratified_split_with_hot_duplicate_id(spark):
    # one id copied 3000 times next to 600 distinct ids: counts per part must
    # equal a plain row_number split, and copies are split by rank ranges
    rows = [(7, 3)] * 3000 + [(i, (i % 5)) for i in range(100, 700)]
    df = spark.createDataFrame(rows, "par_id long, label int")
    fast = PR.stratified_split(df, hex_digits=1)
    h = F.md5(F.concat(F.lit("42:"), F.col("par_id").cast("string")))
    w = Window.partitionBy("y").orderBy(h, "par_id")
    b = (df.select("par_id", (F.col("label") >= 2).cast("int").alias("y"))
         .withColumn("rk", F.row_number().over(w))
         .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("y"))))
    ref = {}
    for r in b.collect():
        hq = math.floor(r.n * 0.2 + 0.5)
        part = "val" if r.rk <= hq // 2 else ("test" if r.rk <= hq else "train")
        ref[(r.par_id, part)] = ref.get((r.par_id, part), 0) + 1
    got = {}
    for r in fast.collect():
        got[(r.par_id, r.split)] = got.get((r.par_id, r.split), 0) + 1
    assert got == ref


def test_external_batch_scorer_agrees_with_spark(spark):
    import __spark_entry__ as E
    rows = E.queries()["external_batch_scores"](spark, SF001).collect()
    assert len(rows) > 0
    agree = sum(r.pred_external == r.pred_spark for r in rows)
    assert agree == len(rows)


def _scans_of_text(df):
    """How often the plan tokenises."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_cross_document_bigrams_and_bayes_tokenise_once(spark):
    from textlab.operators import bayes as NB
    docs = spark.createDataFrame([(3, "red cat sat", 0), (1, "big dog", 0), (2, "dog red", 2), (4, "of", 0), (5, "cat", 0),
                                  (6, None, 0)], "par_id long, text string, label int")
    counts = L.stream_bigram_counts(docs)
    assert _scans_of_text(counts) == 0  # read from the stored counts
    assert {(r.binary_label, r.ngram): r.freq for r in counts.collect()} == {
        (0, "big dog"): 1, (0, "dog red"): 1, (0, "red cat"): 1, (0, "cat sat"): 1, (0, "sat cat"): 1, (1, "dog red"): 1}
    scores = NB.bayes_scores(docs.withColumn("label", (F.col("label") >= 2).cast("int")), docs)
    assert _scans_of_text(scores) == 1 and scores.count() == 6


def test_weights_of_a_large_vocabulary_are_not_broadcast(spark, monkeypatch):
    from textlab.operators import bayes as NB
    docs = spark.createDataFrame([(i, f"word{'abc'[i % 3]} other word", i % 2) for i in range(9)], "par_id long, text string, label int")
    want = sorted(map(tuple, NB.bayes_scores(docs, docs).collect()))
    monkeypatch.setattr(NB, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, NB.bayes_scores(docs, docs).collect())) == want


def test_span_files_stay_near_the_given_size(spark, tmp_path):
    from textlab.sources import driver as D
    text = "a sentence of a long text. " * 200
    spark.createDataFrame([(i, text, "en", "s") for i in range(64)], "doc_id long, text string, lang string, source string") \
        .coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 1) for i in range(64)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    one = 200 * len(text)
    parts = D.spans(spark, str(tmp_path), part_bytes=one).select("span_text", F.length("text").alias("n")) \
        .groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n"), F.count("n").alias("rows")).collect()
    assert sum(r["rows"] for r in parts) == 64 * D.spans(spark, str(tmp_path)).where("par_id = 1").count() >= 64 * 200
    assert max(r["n"] for r in parts) <= 8 * one

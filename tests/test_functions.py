"""Edge rows for the column expressions (invented inputs)."""

from pyspark.sql import functions as F

from textlab.functions import (argmax2, binarise, clean_text, coerce_id, is_alpha, ngrams,
                               parse_multilabel, tokenize)


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_clean_text_edges(spark):
    rows = ["a &amp; <h> c &#39; d", "&#x27;", "x y z\u001cw", "  lead  trail  ",
            "<b>bold</b>\n\ttext", "&frac12; kept?"]
    out = [r[0] for r in one_col(spark, rows).select(clean_text("v")).collect()]
    assert out[0] == "a c d"
    assert out[1] == "&#x27;"
    assert out[2] == "x y z w"
    assert out[3] == "lead trail"
    assert out[4] == "bold text"
    assert out[5] == "&frac12; kept?"


def test_clean_text_idempotent(spark):
    rows = ["a <p>b</p> &amp;&amp; c", "  x　 ", "&lt;p&gt;", "<<a>>", "plain"]
    df = one_col(spark, rows).select(clean_text("v").alias("c"))
    twice = df.select("c", clean_text("c").alias("cc")).collect()
    assert all(r.c == r.cc for r in twice)


def test_binarise(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (4,), (None,)], "v int")
    assert [r[0] for r in df.select(binarise("v")).collect()] == [0, 0, 1, 1, 0]


def test_parse_multilabel(spark):
    vals = ["[0, 1, 0]", "[0,0]", None, "", "[10]", "[0.5]"]
    assert [r[0] for r in one_col(spark, vals).select(parse_multilabel("v")).collect()] == [1, 0, 0, 0, 1, 1]


def test_coerce_id(spark):
    vals = ["12", "12.0", "x", None]
    assert [r[0] for r in one_col(spark, vals).select(coerce_id("v")).collect()] == [12, 12, None, None]


def test_alpha_filter(spark):
    vals = ["été", "n't", "x1", "中", ""]
    assert [r[0] for r in one_col(spark, vals).select(is_alpha("v")).collect()] == [True, False, False, True, False]


def test_ngram_sizes(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(F.size(ngrams(F.col("t"), 2))).collect()]
    assert got == [2, 0, 0]
    assert df.select(ngrams(F.col("t"), 2)).first()[0] == ["a b", "b c"]


def test_tokenizer_keeps_contractions_and_punct(spark):
    got = one_col(spark, ["Don't stop, NOW!"]).select(tokenize("v")).first()[0]
    assert got == ["don't", "stop", ",", "now", "!"]


def test_span_substring_codepoints(spark):
    df = spark.createDataFrame([("héllo world", 2, 5)], "t string, s int, f int")
    assert df.select(F.substring("t", F.col("s") + 1, F.col("f") - F.col("s"))).first()[0] == "llo"


def test_argmax_tie_goes_to_zero(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.1, 0.9), (0.9, 0.1)], "z0 double, z1 double")
    assert [r[0] for r in df.select(argmax2("z0", "z1")).collect()] == [0, 1, 0]


def test_few_characters_are_encoded_at_a_time():
    from textlab.functions import subword as W
    seen = []

    def encode(texts):
        seen.append(sum(map(len, texts)))
        return [t.split() for t in texts]
    texts = ["a b " * n for n in (1, 30, 2, 2, 500, 0, 3)]
    assert W._sizes(encode, texts, 100) == [len(t.split()) for t in texts]
    assert sorted(seen)[-1] == 2000 and max(sorted(seen)[:-1]) <= 120 and W._sizes(encode, [], 100) == []

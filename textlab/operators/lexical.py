"""Lexical contrast between the two classes: term frequencies, vocabulary
totals, smoothed log-odds, distinctive terms, n-grams, word-cloud terms and
vocabulary set sizes.

All class-level totals are aggregates over the (already aggregated) term
table, broadcast back as one row; the only shuffle over raw tokens is the
``groupBy(term)``, whose partial aggregation collapses hot terms map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import binarise
from ..functions.text import ENGLISH_STOP_WORDS, content_tokens, ngrams, tokenize
from .common import attach, r6, stored, top_k_per_group, union_all


def class_tokens(df: DataFrame, text: str = "text", label: str = "label",
                 words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(binary_label, term)`` rows: lower-cased, alphabetic, non-stop tokens
    of non-null texts (the class-contrast token stream)."""
    toks = content_tokens(tokenize(text), words)
    return (df.where(F.col(text).isNotNull())
            .select(binarise(label).alias("binary_label"), F.explode_outer(toks).alias("term"))
            .where(F.col("term").isNotNull()))


def term_freq(tokens: DataFrame) -> DataFrame:
    """``(term, pcl_freq, non_pcl_freq)`` in one pass with conditional counts."""
    y = F.col("binary_label")
    return tokens.groupBy("term").agg(
        F.sum(y).cast("long").alias("pcl_freq"),
        F.sum(1 - y).cast("long").alias("non_pcl_freq"))


def class_vocab_stats(freq: DataFrame) -> DataFrame:
    """Vocabulary size and token total per class, from the term table."""
    f1, f0 = F.col("pcl_freq"), F.col("non_pcl_freq")
    one = freq.agg(F.sum((f1 > 0).cast("long")).alias("v1"), F.sum(f1).cast("long").alias("n1"),
                   F.sum((f0 > 0).cast("long")).alias("v0"), F.sum(f0).cast("long").alias("n0"))
    return one.select(F.inline(F.array(
        F.struct(F.lit(1).alias("binary_label"), F.col("v1").alias("vocab_size"), F.col("n1").alias("n_tokens")),
        F.struct(F.lit(0).alias("binary_label"), F.col("v0").alias("vocab_size"), F.col("n0").alias("n_tokens")),
    )))


def log_odds(freq: DataFrame, min_freq: int = 1) -> DataFrame:
    """Add-one smoothed log-odds of every term, positive class over negative:

    ln( ((f1 + 1) / (N1 + V)) / ((f0 + 1) / (N0 + V)) ),  V = union vocabulary.
    """
    totals = freq.agg(F.sum("pcl_freq").alias("_n1"), F.sum("non_pcl_freq").alias("_n0"),
                      F.count(F.lit(1)).alias("_v"))
    f1, f0 = F.col("pcl_freq"), F.col("non_pcl_freq")
    p1 = (f1 + 1).cast("double") / (F.col("_n1") + F.col("_v"))
    p0 = (f0 + 1).cast("double") / (F.col("_n0") + F.col("_v"))
    out = attach(freq, totals).select("term", "pcl_freq", "non_pcl_freq",
                                      r6(F.log(p1 / p0)).alias("log_odds"))
    if min_freq > 1:
        out = out.where(f1 + f0 >= min_freq)
    return out


def distinctive_terms(lo: DataFrame, k: int = 20) -> DataFrame:
    """k lowest and k highest log-odds terms (two TakeOrdered, unioned);
    ties broken by term."""
    pcl = lo.orderBy(F.desc("log_odds"), F.asc("term")).limit(k).withColumn("side", F.lit("pcl"))
    non = lo.orderBy(F.asc("log_odds"), F.asc("term")).limit(k).withColumn("side", F.lit("non_pcl"))
    return pcl.unionByName(non).select("side", "term", "log_odds", "pcl_freq", "non_pcl_freq")


def class_ngrams(df: DataFrame, n: int, text: str = "text", label: str = "label",
                 words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(binary_label, ngram)`` rows over each document's content tokens
    (n-grams stay inside a document).

    The token array is projected as its own column first: inside the n-gram
    lambda a reference to a column is a lookup, while an inlined tokeniser
    expression would be re-run for every element (quadratic regex work).
    Catalyst keeps the two projections apart because the array is used more
    than once and is not cheap.
    """
    toks = (df.where(F.col(text).isNotNull())
            .select(binarise(label).alias("binary_label"),
                    content_tokens(tokenize(text), words).alias("toks")))
    return (toks.select("binary_label", F.explode_outer(ngrams(F.col("toks"), n)).alias("ngram"))
            .where(F.col("ngram").isNotNull()))


def stream_bigram_counts(df: DataFrame, key: str = "par_id", text: str = "text", label: str = "label",
                         words=ENGLISH_STOP_WORDS, blocks: int = 256) -> DataFrame:
    """Bigram counts when each class's documents are read as one token stream in
    ``key`` order, so that bigrams cross document edges.

    The text is tokenised once: every document yields its inner bigrams and one
    edge (first and last token, key), all as plain strings that go through the same
    count.  The counts are written to the shared folder, as bigrams and edges are both
    read from them.  Edges are cut into blocks at quantiles of the keys that occur, so
    sparse ids make no more blocks than dense ones; ``lag`` runs inside a block
    and a block's last token is carried over a table of one row a block.
    """
    toks = df.where(F.col(text).isNotNull()).select(
        F.col(key).alias("k"), binarise(label).alias("binary_label"), content_tokens(tokenize(text), words).alias("t"))
    # tokens are letters only, so a line feed marks an edge
    edge = F.concat_ws("\n", F.element_at("t", 1), F.element_at("t", -1), F.col("k").cast("string"))
    rows = toks.select("binary_label", F.explode_outer(F.when(F.size("t") > 0, F.concat(ngrams(F.col("t"), 2), F.array(edge)))).alias("ngram")) \
        .where(F.col("ngram").isNotNull())
    counted = stored(ngram_counts(rows), "stream-bigrams")
    is_edge = F.contains("ngram", F.lit("\n"))
    part = F.split("ngram", "\n", 3)
    ends = counted.where(is_edge).select("binary_label", F.get(part, F.lit(2)).cast(df.schema[key].dataType).alias("k"),
                                         part[0].alias("first"), part[1].alias("last"))
    bounds = df.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 10_000).alias("_bounds"))
    ends = attach(ends, bounds).select(
        "binary_label", "k", "first", "last", F.size(F.filter("_bounds", lambda x: x < F.col("k"))).alias("blk"))
    w = Window.partitionBy("binary_label", "blk").orderBy("k")
    inside = ends.withColumn("prev", F.lag("last").over(w)).withColumn("next", F.lead("k").over(w))
    carry = (inside.where(F.col("next").isNull()).select("binary_label", "blk", "last")
             .withColumn("carry", F.lag("last").over(Window.partitionBy("binary_label").orderBy("blk")))
             .select("binary_label", "blk", "carry"))
    prev = F.coalesce("prev", "carry")
    crossing = (inside.join(carry, ["binary_label", "blk"]).where(prev.isNotNull())
                .select("binary_label", F.concat_ws(" ", prev, "first").alias("ngram"), F.lit(1).cast("long").alias("freq")))
    return (counted.where(~is_edge).unionByName(crossing)
            .groupBy("binary_label", "ngram").agg(F.sum("freq").alias("freq")))


def ngram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("binary_label", "ngram").agg(F.count(F.lit(1)).alias("freq"))


def top_bigrams(df: DataFrame, k: int = 15, cross_doc: bool = False, **kw) -> DataFrame:
    """Most common content bigrams per class (top k, ties by n-gram)."""
    counts = stream_bigram_counts(df, **kw) if cross_doc else ngram_counts(class_ngrams(df, 2, **kw))
    return top_k_per_group(counts, ["binary_label"], [F.desc("freq"), F.asc("ngram")], k) \
        .select("binary_label", "rank", "ngram", "freq")


def top_ngrams(df: DataFrame, sizes=(2, 3), k: int = 25, text: str = "text") -> DataFrame:
    """Top k corpus n-grams for each size.  The text is tokenised once: every
    size's n-grams are exploded from the same token array as ``(n, ngram)``
    rows, counted in one aggregation, and ranked per size."""
    toks = (df.where(F.col(text).isNotNull())
            .select(F.filter(tokenize(text), lambda t: t.rlike(r"[\p{L}\p{N}]")).alias("toks")))
    # tokens hold no spaces, so an n-gram's size is its word count: plain
    # strings are exploded and ``n`` is recovered after the aggregate
    grams = toks.select(F.explode_outer(F.concat(*[ngrams(F.col("toks"), n) for n in sizes])).alias("ngram")) \
        .where(F.col("ngram").isNotNull())
    counts = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("freq")) \
        .withColumn("n", F.size(F.split("ngram", " ")).cast("long"))
    # a per-size filter here would be pushed below the aggregate and split
    # the plan into one tokenising branch per size; rank per size instead
    top = top_k_per_group(counts, ["n"], [F.desc("freq"), F.asc("ngram")], k)
    return top.select("n", "ngram", "freq")


def cloud_terms(freq: DataFrame, k: int = 150) -> DataFrame:
    """Word-cloud input: top k terms per class with weight freq / max freq."""
    long = freq.select("term", F.inline(F.array(
        F.struct(F.lit(1).alias("binary_label"), F.col("pcl_freq").alias("freq")),
        F.struct(F.lit(0).alias("binary_label"), F.col("non_pcl_freq").alias("freq")),
    ))).where(F.col("freq") > 0)
    top = top_k_per_group(long, ["binary_label"], [F.desc("freq"), F.asc("term")], k)
    mx = top.where(F.col("rank") == 1).select("binary_label", F.col("freq").alias("_max"))
    return (top.join(F.broadcast(mx), "binary_label")
            .select("binary_label", "rank", "term", "freq",
                    r6(F.col("freq") / F.col("_max")).alias("weight")))


def vocab_contrast(tokens: DataFrame) -> DataFrame:
    """Term table as a full outer join of the two class vocabularies, missing
    side filled with 0 (the set-union form of ``term_freq``).

    Both vocabularies are cut from one term aggregate with filters on its
    *outputs*, which Catalyst cannot push below it, so the tokens are produced
    once and both join sides arrive hash-partitioned by term."""
    freq = term_freq(tokens)
    f1, f0 = F.col("pcl_freq"), F.col("non_pcl_freq")
    # each side's filter reads both counts (the second test always holds):
    # column pruning then leaves the two aggregates identical -> one exchange
    pos = freq.where((f1 > 0) & (f0 >= 0)).select("term", "pcl_freq")
    neg = freq.where((f0 > 0) & (f1 >= 0)).select("term", "non_pcl_freq")
    return pos.join(neg, "term", "full_outer").select(
        "term", F.coalesce("pcl_freq", F.lit(0)).cast("long").alias("pcl_freq"),
        F.coalesce("non_pcl_freq", F.lit(0)).cast("long").alias("non_pcl_freq"))


def vocab_sets(freq: DataFrame) -> DataFrame:
    """Union, intersection and one-sided vocabulary sizes and the overlap
    share, from the term table (no second pass over tokens)."""
    a, b = F.col("pcl_freq") > 0, F.col("non_pcl_freq") > 0
    one = freq.agg(F.count(F.lit(1)).alias("n_union"),
                   F.sum((a & b).cast("long")).alias("n_both"),
                   F.sum((a & ~b).cast("long")).alias("n_pcl_only"),
                   F.sum((~a & b).cast("long")).alias("n_non_pcl_only"))
    return one.withColumn("overlap_share", r6(F.col("n_both") / F.col("n_union")))

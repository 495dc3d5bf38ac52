"""Corpus profile: class balance, keyword/country shares, token, character,
sentence and vocabulary statistics, noise and duplicate profiles, span
statistics.  Every function is lazy ``DataFrame -> DataFrame``.

Inputs follow the paragraph table (``par_id, keyword, country_code, text,
label``); functions that need a binary label derive it with ``binarise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import binarise
from ..functions.text import ENGLISH_STOP_WORDS, HTML_ENTITY, HTML_TAG, is_stop_word, sentences, tokenize
from .common import DECIMALS, attach, r6, top_k_per_group, union_all, with_share

WORD_CHAR = r"[\p{L}\p{N}]"


def with_binary(df: DataFrame, label: str = "label", out: str = "binary_label") -> DataFrame:
    return df.withColumn(out, binarise(label))


# ---------------------------------------------------------------- class balance

def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share of every ordinal label; the share counts null-label rows
    in the total, like ``value_counts() / len(df)``."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts).where(F.col("label").isNotNull()).orderBy("label")


def class_imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    """n, per-class counts and shares, and the non-positive : positive ratio."""
    y = binarise(label)
    agg = df.agg(F.count(F.lit(1)).alias("n_total"),
                 F.sum(1 - y).cast("long").alias("n_non_pcl"),
                 F.sum(y).cast("long").alias("n_pcl"))
    return agg.select(
        "n_total", "n_non_pcl", "n_pcl",
        r6(F.col("n_non_pcl") * 100.0 / F.col("n_total")).alias("pct_non_pcl"),
        r6(F.col("n_pcl") * 100.0 / F.col("n_total")).alias("pct_pcl"),
        F.when(F.col("n_pcl") == 0, F.lit(float("inf")))
         .otherwise(r6(F.col("n_non_pcl").cast("double") / F.col("n_pcl")))
         .alias("imbalance_ratio"),
    )


def rate_by_keyword(df: DataFrame, key: str = "keyword", label: str = "label") -> DataFrame:
    """Positive rate, positive count and total per keyword, by rate."""
    y = binarise(label)
    return (df.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(r6(F.avg(y)).alias("pcl_rate"),
                 F.sum(y).cast("long").alias("pcl_count"),
                 F.count(F.lit(1)).alias("total"))
            .orderBy("pcl_rate", key))


def counts_by_keyword(df: DataFrame, key: str = "keyword", label: str = "label") -> DataFrame:
    """Absolute positive / negative counts per keyword, by total."""
    y = binarise(label)
    return (df.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("total"), F.sum(y).cast("long").alias("pcl_count"))
            .withColumn("non_pcl_count", F.col("total") - F.col("pcl_count"))
            .orderBy("total", key))


def value_distribution(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Count and share per value (nulls skipped), most frequent first."""
    counts = with_share(df.where(F.col(col).isNotNull()).groupBy(col)
                        .agg(F.count(F.lit(1)).alias("n")))
    ordered = counts.orderBy(F.desc("n"), F.asc(col))
    return ordered.limit(top) if top else ordered


def keyword_distribution(df: DataFrame) -> DataFrame:
    return value_distribution(df, "keyword")


def country_distribution(df: DataFrame, top: int = 15) -> DataFrame:
    return value_distribution(df, "country_code", top)


# ------------------------------------------------------------- text statistics

def doc_token_counts(df: DataFrame, text: str = "text", mode: str = "word") -> DataFrame:
    """Adds ``n_tokens`` (word tokens incl. punctuation) for non-null texts."""
    return (df.where(F.col(text).isNotNull())
            .withColumn("n_tokens", F.size(tokenize(text, mode)).cast("long")))


def token_stats(df: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    n = F.col(n_tokens)
    return df.agg(F.count(F.lit(1)).alias("n_docs"),
                  r6(F.avg(n)).alias("avg_tokens"),
                  F.min(n).cast("long").alias("min_tokens"),
                  F.max(n).cast("long").alias("max_tokens"),
                  r6(F.percentile(n, 0.5)).alias("median_tokens"),
                  r6(F.stddev_samp(n)).alias("std_tokens"))


def char_stats(df: DataFrame, n_chars: str = "n_chars") -> DataFrame:
    n = F.col(n_chars)
    return df.agg(r6(F.avg(n)).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"),
                  F.max(n).cast("long").alias("max_chars"))


def sentence_stats(df: DataFrame, text: str = "text") -> DataFrame:
    n = F.size(sentences(text))
    return (df.where(F.col(text).isNotNull())
            .agg(r6(F.avg(n)).alias("avg_sentences"),
                 F.min(n).cast("long").alias("min_sentences"),
                 F.max(n).cast("long").alias("max_sentences")))


def word_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Exploded ``token`` rows holding at least one letter or digit (pure
    punctuation dropped).  ``explode_outer`` + null filter avoids Catalyst
    re-running the regex in an inferred ``size(...) > 0`` filter."""
    return (df.where(F.col(text).isNotNull())
            .select(*keep, F.explode_outer(tokenize(text)).alias("token"))
            .where(F.col("token").isNotNull() & F.col("token").rlike(WORD_CHAR)))


def vocabulary_stats(tokens: DataFrame) -> DataFrame:
    """Total word tokens, distinct vocabulary, type-token ratio.  Two-level
    aggregate (group by token, then count) instead of a global distinct."""
    per_term = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    return per_term.agg(F.sum("f").cast("long").alias("total_tokens"),
                        F.count(F.lit(1)).alias("vocab_size")) \
        .withColumn("ttr", r6(F.col("vocab_size") / F.col("total_tokens")))


def stopword_density(tokens: DataFrame, words=ENGLISH_STOP_WORDS) -> DataFrame:
    s = is_stop_word("token", words).cast("long")
    return (tokens.agg(F.count(F.lit(1)).alias("total_tokens"), F.sum(s).alias("stop_tokens"))
            .withColumn("stop_pct", r6(F.col("stop_tokens") * 100.0 / F.col("total_tokens")))
            .withColumn("content_pct", r6(100.0 - F.col("stop_tokens") * 100.0 / F.col("total_tokens"))))


def term_counts(tokens: DataFrame) -> DataFrame:
    """``(token, freq)``; partial aggregation collapses hot terms map-side."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def top_stopwords(tokens: DataFrame, k: int = 15, words=ENGLISH_STOP_WORDS) -> DataFrame:
    return (term_counts(tokens.where(is_stop_word("token", words)))
            .orderBy(F.desc("freq"), F.asc("token")).limit(k))


def top_words(tokens: DataFrame, k: int = 30, words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Most common words, once over all tokens and once without stop words.

    One term aggregate feeds both lists: each term row is tagged with the
    scopes it belongs to and ranked per scope (a stop-word filter on the
    grouping key would be pushed below the aggregate and split the plan)."""
    counts = term_counts(tokens)
    scopes = F.when(is_stop_word("token", words), F.array(F.lit("all"))) \
        .otherwise(F.array(F.lit("all"), F.lit("content")))
    tagged = counts.select("token", "freq", F.explode(scopes).alias("scope"))
    top = top_k_per_group(tagged, ["scope"], [F.desc("freq"), F.asc("token")], k)
    return top.select("scope", "token", "freq")


def word_length_distribution(tokens: DataFrame) -> DataFrame:
    return (tokens.groupBy(F.length("token").cast("long").alias("word_len"))
            .agg(F.count(F.lit(1)).alias("n_words")).orderBy("word_len"))


def word_length_summary(tokens: DataFrame) -> DataFrame:
    """Mean and median word length, from the per-length table (small)."""
    dist = word_length_distribution(tokens)
    return dist.agg(
        r6(F.sum(F.col("word_len") * F.col("n_words")) / F.sum("n_words")).alias("avg_word_len"),
        r6(F.percentile(F.col("word_len"), F.lit(0.5), F.col("n_words"))).alias("median_word_len"))


def short_texts(df: DataFrame, n_tokens: str = "n_tokens", very_short: int = 3) -> DataFrame:
    n = F.col(n_tokens)
    return df.agg(F.sum((n == 0).cast("long")).alias("n_empty"),
                  F.sum((n <= very_short).cast("long")).alias("n_very_short"))


def duplicate_profile(df: DataFrame, key: str = "par_id", text_key: str = "text_key") -> DataFrame:
    """Exact duplicate texts and duplicate ids, as counts and shares.

    Texts are compared by their SHA-256, computed where the text lies.  Each of
    the two counts is a group-by on one narrow column: no row is doubled."""
    by_text = (df.groupBy(text_key).agg(F.count(F.lit(1)).alias("n"))
               .agg(F.sum("n").alias("n_docs"), F.coalesce(F.sum(F.when(F.col(text_key).isNotNull(), F.col("n") - 1)),
                                                           F.lit(0)).alias("dup_texts")))
    by_id = (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0)).alias("dup_ids")))
    return attach(by_text, by_id).select(
        F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.col("dup_texts").cast("long").alias("dup_texts"),
        r6(F.col("dup_texts") * 100.0 / F.col("n_docs")).alias("dup_text_pct"), F.col("dup_ids").cast("long").alias("dup_ids"))


# Own definitions of the noise patterns (Java and RE2 agree on all of them).
ARTIFACT_PATTERNS = (
    ("special_quotes", "[\"“”‘’«»]"),
    ("html_tags", HTML_TAG),
    ("html_entities", HTML_ENTITY),
    ("hashtags", r"#[A-Za-z0-9_]+"),
    ("mentions", r"@[A-Za-z0-9_]+"),
    ("urls", r"https?://|www\."),
    ("emails", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("newline_tab", r"[\n\t\r]"),
    ("multiple_spaces", "  "),
    ("non_ascii", r"[^\x00-\x7F]"),
    ("numbers_only", r"^[0-9 .,]+$"),
)

PATTERN_CHECKS = (
    ("questions", r"\?"),
    ("exclamations", "!"),
    ("quoted_text", "\"[^\"]+\"|“[^”]+”"),
)


#: A pattern can only match a text that holds one of these: a byte search before the regex.
_NEEDED = {"html_tags": ("<",), "html_entities": ("&",), "hashtags": ("#",), "mentions": ("@",),
           "urls": ("http", "www."), "emails": ("@",), "quoted_text": ('"', "“")}
#: Patterns that are one fixed string.
_FIXED = {"multiple_spaces": "  ", "questions": "?", "exclamations": "!"}


def _hit(name: str, pattern: str, text: str) -> Column:
    c = F.col(text)
    if name in _FIXED:
        return c.contains(_FIXED[name])
    hit = c.rlike(pattern)
    if name in _NEEDED:
        some = c.contains(_NEEDED[name][0])
        for literal in _NEEDED[name][1:]:
            some = some | c.contains(literal)
        return F.when(some, hit).otherwise(F.lit(False))
    return hit


def pattern_flags(patterns, text: str = "text") -> dict[str, Column]:
    """One flag per pattern, to be derived on the documents' side of a join."""
    return {f"f_{name}": _hit(name, pattern, text) for name, pattern in patterns}


def _flag_profile(df: DataFrame, patterns, key: str) -> DataFrame:
    """All flags in one narrow aggregate, then one row per pattern with the
    smallest id that shows it."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for name, _ in patterns:
        aggs += [F.sum(F.col(f"f_{name}").cast("long")).alias(f"n_{name}"),
                 F.min(F.when(F.col(f"f_{name}"), F.col(key))).alias(f"k_{name}")]
    n = {name: F.coalesce(F.col(f"n_{name}"), F.lit(0)) for name, _ in patterns}
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("pattern"), n[name].cast("long").alias("n_docs"),
                 r6(n[name] * 100.0 / F.col("_n")).alias("pct"), F.col(f"k_{name}").alias("_key"))
        for name, _ in patterns])))


def artifact_profile(flags: DataFrame, texts: DataFrame, key: str = "par_id", text: str = "text",
                     example_len: int = 150) -> DataFrame:
    """Noise patterns: documents, share and one example.  ``flags`` holds the ids
    and flags only; the examples' texts (one a pattern, of a repeated id the first in
    text order) are fetched by id."""
    found = _flag_profile(flags, ARTIFACT_PATTERNS, key).collect()  # one row a pattern
    spark = texts.sparkSession
    counts = spark.createDataFrame([tuple(r) for r in found],
                                   f"pattern string, n_docs long, pct double, _key {dict(texts.dtypes)[key]}")
    wanted = [r["_key"] for r in found if r["_key"] is not None]
    flag = pattern_flags(ARTIFACT_PATTERNS, text)
    head = (texts.where(F.col(key).isin(wanted)).groupBy(F.col(key).alias("_key"))
            .agg(*[F.min(F.when(hit, F.substring(text, 1, example_len))).alias(f"_{name}") for name, hit in flag.items()]))
    example = F.coalesce(*[F.when(F.col("pattern") == name[2:], F.col(f"_{name}")) for name in flag])
    return counts.join(head, "_key", "left").select("pattern", "n_docs", "pct", example.alias("example"))


def pattern_profile(flags: DataFrame, key: str = "par_id") -> DataFrame:
    return _flag_profile(flags, PATTERN_CHECKS, key).drop("_key")


# ------------------------------------------------------------------ span table

def category_distribution(spans: DataFrame) -> DataFrame:
    return value_distribution(spans, "pcl_category")


def annotator_agreement(spans: DataFrame) -> DataFrame:
    return value_distribution(spans, "num_annotators").orderBy("num_annotators")


def span_length_stats(spans: DataFrame) -> DataFrame:
    n = F.length("span_text")
    return (spans.where(F.col("span_text").isNotNull())
            .agg(r6(F.avg(n)).alias("avg_span_len"),
                 r6(F.percentile(n, 0.5)).alias("median_span_len"),
                 F.min(n).cast("long").alias("min_span_len"),
                 F.max(n).cast("long").alias("max_span_len")))


def span_check(spans: DataFrame) -> DataFrame:
    """Re-cut every span from its paragraph text and compare (0-based, half-open)."""
    cut = F.substring(F.col("text"), F.col("span_start") + 1, F.col("span_finish") - F.col("span_start"))
    return spans.select("par_id", "span_start", "span_finish",
                        cut.alias("extracted"), (cut == F.col("span_text")).alias("matches"))


def table_shapes(named: dict[str, DataFrame]) -> DataFrame:
    """Rows x columns of each table: one count per table, unioned."""
    frames = [df.agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit(name).alias("table_name"), "n_rows",
                      F.lit(len(df.columns)).cast("long").alias("n_cols"))
              for name, df in named.items()]
    return union_all(frames)


def extreme_lengths(df: DataFrame, k: int = 5, cut: int = 100, key: str = "par_id",
                    text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Shortest and longest k documents, text cut to ``cut``.  Every document
    is tagged for both ends (longest ranks by the negated length) and ranked
    per end by one limited window, so the text is tokenised once."""
    ends = F.array(F.struct(F.lit("shortest").alias("side"), F.col(n_tokens).alias("_o")),
                   F.struct(F.lit("longest").alias("side"), (-F.col(n_tokens)).alias("_o")))
    x = df.select(F.col(key), F.col(n_tokens), F.substring(F.col(text), 1, cut).alias("text_head"),
                  F.explode(ends).alias("_e")).select(key, n_tokens, "text_head", "_e.side", "_e._o")
    top = top_k_per_group(x, ["side"], [F.col("_o"), F.col(key)], k)
    return top.select("side", key, n_tokens, "text_head")


def class_slice(df: DataFrame, cls: int, key: str = "par_id", text: str = "text",
                label: str = "label") -> DataFrame:
    """Texts of one binary class (filter pushed to the scan side of the join)."""
    return df.where(binarise(label) == cls).select(key, text)


def category_samples(spans: DataFrame, k: int = 3, cut: int = 80) -> DataFrame:
    """k sample spans per category, picked by a stable hash order, span text
    cut to ``cut`` characters.  Every task sends at most k rows a category to
    the ranking window."""
    order_key = F.md5(F.concat_ws(":", F.col("par_id").cast("string"), F.col("span_start").cast("string")))
    x = spans.select("pcl_category", "par_id", "span_start",
                     F.substring("span_text", 1, cut).alias("span_head"), order_key.alias("_h"))
    top = top_k_per_group(x, ["pcl_category"], [F.col("_h"), F.col("par_id"), F.col("span_start")], k)
    return top.select("pcl_category", "rank", "par_id", "span_start", "span_head")


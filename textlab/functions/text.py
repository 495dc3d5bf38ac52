"""Text expressions built only from Spark's JVM-side functions.

Every function takes and returns a ``Column`` so it stays inside whole-stage
codegen; no Python UDF is involved.  The regular expressions are written so
that Java (Spark), RE2 (DuckDB) and Python's ``regex`` agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ENGLISH_STOP_WORDS

# Python's Unicode ``\s`` spelled out: Java's ``\s`` is ASCII-only and RE2's
# lacks \x0B, so an explicit class is the only portable form.
WS_CLASS = r"\t\n\x0B\f\r\x1c-\x1f\x{85}\p{Z}"
WS_RUN = f"[{WS_CLASS}]+"

HTML_TAG = r"<[^>]+>"
HTML_ENTITY = r"&[a-zA-Z]+;|&#[0-9]+;"

# Word tokens: letter/digit runs with inner apostrophe parts ("don't"),
# else any single non-space, non-word character (punctuation).
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:['’]\p{L}+)*|" + f"[^{WS_CLASS}\\p{{L}}\\p{{N}}]"
# Whitespace tokens (the labelled corpus is already space-tokenised).
WHITESPACE_TOKEN = f"[^{WS_CLASS}]+"
ALPHA_PATTERN = r"^\p{L}+$"
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col: Column | str) -> Column:
    """Blank HTML tags and entities, collapse whitespace, strip."""
    c = F.regexp_replace(_c(col), HTML_TAG, " ")
    c = F.regexp_replace(c, HTML_ENTITY, " ")
    c = F.regexp_replace(c, WS_RUN, " ")
    return F.trim(c)


def tokenize(col: Column | str, mode: str = "word", lower: bool = True) -> Column:
    """ARRAY<STRING> of tokens; ``mode`` is ``word`` or ``whitespace``."""
    c = _c(col)
    if lower:
        c = F.lower(c)
    pattern = TOKEN_PATTERN if mode == "word" else WHITESPACE_TOKEN
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def is_alpha(col: Column | str) -> Column:
    """``str.isalpha()``: non-empty and letters only."""
    return _c(col).rlike(ALPHA_PATTERN)


def stop_words_array(words=ENGLISH_STOP_WORDS) -> Column:
    return F.array(*[F.lit(w) for w in words])


def content_tokens(tokens: Column | str, words=ENGLISH_STOP_WORDS) -> Column:
    """Alphabetic tokens that are not stop words, order and repeats kept.

    ``isin`` over the literal list becomes a hash-set test (InSet) even
    inside the lambda; ``array_contains`` would scan the list per token."""
    return F.filter(_c(tokens), lambda t: ~t.isin(*words) & t.rlike(ALPHA_PATTERN))


def is_stop_word(col: Column | str, words=ENGLISH_STOP_WORDS) -> Column:
    return _c(col).isin(*words)


def ngrams(tokens: Column | str, n: int) -> Column:
    """ARRAY<STRING> of space-joined n-grams, in order (empty when too short)."""
    t = _c(tokens)
    if n == 1:
        return t
    last = F.size(t) - F.lit(n - 1)
    return F.when(last >= 1, F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.array_join(F.slice(t, i, n), " "),
    )).otherwise(F.array().cast("array<string>"))


def sentences(col: Column | str) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(SENTENCE_PATTERN), 0)


def truncate_tokens(tokens: Column | str, max_len: int) -> Column:
    return F.slice(_c(tokens), 1, max_len)


def text_hash(col: Column | str) -> Column:
    """Stable content key for exact-duplicate checks."""
    return F.sha2(_c(col), 256)

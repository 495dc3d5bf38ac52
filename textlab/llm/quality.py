"""Quality: a non-negative positive-unlabelled classifier over the form of a text.

Trusted positives are documents labelled good; the rest of the fold is
unlabelled.  Features describe form, not vocabulary: the shapes of words
(letters, capitals, digits and marks, runs shortened) and of neighbouring
words, how much repeats, and the length of words, lines and text, in steps.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo
from .pu import Fit, Linear, learn, remainder, scored

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
FIT = Fit(positives=4000, unlabelled=8000, dims=1 << 16)
_MEMO = 400_000
_LONG = re.compile(r"(.)\1{2,}")


def _number(form: str) -> int:
    return zlib.crc32(_LONG.sub(r"\1\1", form)[:24].encode("utf-8", "replace")) & 0xFFFF


_FORMS = Memo(_number, _MEMO)


def _letters(part: str) -> str:
    if part.islower():
        return "x"
    if part.isupper():
        return "XX" if len(part) > 1 else "X"
    return "Xx" if part[1:].islower() else "Xm"


def _shape(word: str) -> int:
    """Feature number of a word's form: 'Thing,' is Xx, 'ON!!' is XX!!, 'a1' is x9."""
    end = len(word)
    while end and not word[end - 1].isalnum():
        end -= 1
    stem, tail = word[:end], word[end:]
    if stem.isalpha():
        return _FORMS[_letters(stem) + tail]
    form = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", lambda m: _letters(m[0]), stem))
    return _FORMS[form + tail]


_SHAPES = Memo(_shape, _MEMO)


def _step(name: str, value: float, width: float, most: int) -> int:
    return zlib.crc32(f"{name}{min(int(value / width), most)}".encode()) & (FIT.dims - 1)


def form_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    n = len(words)
    if not n:
        return np.array([_step("empty", 0, 1, 0)], np.int32), np.ones(1, np.float32)
    memo = _SHAPES
    shapes = np.array([memo[w] for w in words], dtype=np.int64)
    single = np.bincount(shapes, minlength=1)
    s_idx = np.flatnonzero(single)
    pairs = (shapes[:-1] * 40503 + shapes[1:] * 2654435 + 12345) & (FIT.dims - 1)
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    p_idx, p_n = pairs[first], np.diff(first, append=len(pairs))
    counts = Counter(words).values()
    lines = [x for x in text.split("\n") if x.strip()]
    steps = [
        _step("kinds", len(counts) / n * min(n, 400) ** 0.25, 0.25, 30),
        _step("same", sum(map(eq, words, islice(words, 1, None))) / n, 0.05, 20),
        _step("often", max(counts) / n, 0.04, 20),
        _step("letters", (len(text) - text.count(" ")) / n, 1.0, 15),
        _step("count", np.log2(n), 1.0, 16),
        _step("lines", np.log2(n / max(len(lines), 1)), 1.0, 12),
        _step("line kinds", len(set(lines)) / max(len(lines), 1), 0.1, 10),
    ]
    idx = np.concatenate([s_idx, p_idx, steps]).astype(np.int32)
    val = np.concatenate([np.sqrt(single[s_idx] / n), np.sqrt(p_n / n), np.full(len(steps), 0.5)])
    return idx, val.astype(np.float32)


def learn_quality(docs: DataFrame, labels: DataFrame, fit: Fit = FIT) -> Linear:
    """Model from the rows outside the held-out fold; ``labels``: doc_id, quality."""
    return learn(docs, labels, "quality", remainder("doc_id", FOLDS) != HELD_OUT, form_features, fit)[0]


def quality_scores(docs: DataFrame, labels: DataFrame, fit: Fit = FIT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts share one score; repeated rows are scored alike;
    without labels every score is the same.  An empty table gives no rows.
    """
    model = learn_quality(docs, labels, fit)
    return scored(docs, model, form_features, "doc_id").select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

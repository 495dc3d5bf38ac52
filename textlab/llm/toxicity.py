"""Toxicity: a non-negative positive-unlabelled classifier over words and word beginnings.

Features of a text are its distinct lower-case words and the first four and
five letters of each, hashed.  One confirmed word marks a text however long it
is, so values are not divided by length; in return the fit uses only features
that are clearly commoner among the confirmed texts than among the unlabelled.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo
from .pu import Fit, Linear, learn, remainder, scored

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Only features that mark toxic texts are fitted, so that long texts gather no noise.
FIT = Fit(purity=0.4, sigmas=6.0)
_LETTERS = re.compile(r"[^\W\d_]+")
_MEMO = 400_000


def _numbers(word: str) -> bytes:
    """Feature numbers of one word: itself and its beginnings."""
    keys = {"=" + word, "4" + word[:4], "5" + word[:5]}
    return np.array([zlib.crc32(k.encode("utf-8", "replace")) & (FIT.dims - 1) for k in keys], "<i4").tobytes()


_WORDS = Memo(_numbers, _MEMO)


def word_features(text: str) -> tuple[np.ndarray, None]:
    words = set(_LETTERS.findall(text.lower()))
    if not words:
        return np.empty(0, np.int32), None
    memo = _WORDS
    idx = np.unique(np.frombuffer(b"".join([memo[w] for w in words]), "<i4"))
    return idx, None


class MarkedWords:
    """The same features, of which only those with a weight are kept."""

    def __init__(self, weights: np.ndarray):
        self.weighted, self.memo = weights != 0, None

    def _numbers(self, word: str) -> bytes:
        numbers = np.frombuffer(_numbers(word), "<i4")
        return numbers[self.weighted[numbers]].tobytes()

    def __call__(self, text: str) -> tuple[np.ndarray, None]:
        if self.memo is None:  # made on the executor
            self.memo = Memo(self._numbers, _MEMO)
        memo = self.memo
        found = b"".join([memo[w] for w in set(_LETTERS.findall(text.lower()))])
        idx = np.unique(np.frombuffer(found, "<i4")) if found else np.empty(0, np.int32)
        return idx, None


def learn_toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = FIT) -> Linear:
    """Model from the rows outside the held-out fold; ``labels``: doc_id, toxic."""
    return learn(docs, labels, "toxic", remainder("doc_id", FOLDS) != HELD_OUT, word_features, fit)[0]


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit: Fit = FIT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts get the score of a text without words; repeated rows
    are scored alike; without labels every score is the same.  An empty table
    gives no rows.
    """
    model = learn_toxicity(docs, labels, fit)
    return scored(docs, model, MarkedWords(model.weights), "doc_id").select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

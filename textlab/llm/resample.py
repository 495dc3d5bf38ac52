"""Target-distribution importance resampling over hashed word windows.

A Split of the ``tokenizers`` library - a plain pattern, nothing trained - cuts
the text, in which A-Z is lower-cased, into words with offsets.  Every run of
``low`` to ``high`` offset pairs is a feature; its bucket is the CRC-32 of the
words, joined by one space, modulo the number of buckets.  The histograms of
the corpus and of the target texts give one integer gain a bucket, and the
floored mean of the gains of a document's features is its weight.  Gumbel noise
from the doc_id turns the highest scores into a draw without replacement.

A text is tokenised once: the sparse histogram of a document (bucket, times) is
written to the shared folder, and both the corpus histogram and the weights
are read from there.  On the driver there are only the gains (one number a
bucket) and the counts of score bins.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .common import Memo, durable, ranked, small_batches, text_or_empty, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Documents of fewer words are never drawn.
MIN_WORDS = 20
SEED = 2024
#: A longer text is split at the next character that is part of no word.
_PIECE = 1 << 18
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Scores are integers; so many neighbouring ones share a bin when the cut is looked for.
_BIN = 256


def splitter():
    """The untrained pre-tokeniser: pieces that match ``WORD``, everything else removed."""
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def word_offsets(split, low: str) -> Iterator[list[tuple[int, int]]]:
    """Offset pairs of the words of a lower-cased text, a list for each piece of it."""
    at = 0
    while at < len(low):
        gap = _GAP.search(low, at + _PIECE) if len(low) - at > _PIECE else None
        end = gap.start() if gap else len(low)
        part = low if end - at == len(low) else low[at:end]
        pieces = split.pre_tokenize_str(part)
        yield [(at + a, at + b) for _, (a, b) in pieces] if at else [span for _, span in pieces]
        at = end


def document_features(split, bucket, text: str, low_n: int = 1, high_n: int = 1) -> tuple[int, dict[int, int]]:
    """``(words, {bucket: times})`` of one text."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    words, times, tail = 0, Counter(), []
    for spans in word_offsets(split, low):
        words += len(spans)
        window = tail + spans
        for n in range(low_n, high_n + 1):
            # windows that lie in the tail alone were counted with the piece before
            first = max(len(tail) - n + 1, 0)
            if n == 1:
                found = [low[a:b] for a, b in window[first:]]
            else:
                found = [" ".join([low[a:b] for a, b in window[i:i + n]]) for i in range(first, len(window) - n + 1)]
            for feature, k in Counter(found).items():
                times[bucket[feature]] += k
        tail = window[len(window) - high_n + 1:] if high_n > 1 else []
    return words, times


def _histograms(low_n: int, high_n: int, buckets: int):
    def run(batches):
        split = splitter()
        bucket = Memo(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, 1 << 17)
        for batch in small_batches(batches):
            rows = [document_features(split, bucket, t, low_n, high_n) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1],
                 pa.array([w for w, _ in rows], pa.int64()),
                 pa.array([sum(t.values()) for _, t in rows], pa.int64()),
                 pa.array([np.fromiter(t, "<u4", len(t)).tobytes() for _, t in rows], pa.binary()),
                 pa.array([np.fromiter(t.values(), "<u4", len(t)).tobytes() for _, t in rows], pa.binary())],
                names=[*batch.schema.names[:-1], "n_words", "n_features", "buckets", "times"])
    return run


def feature_histograms(rows: DataFrame, *keep: str, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_features`` and the packed histogram of every row's text."""
    rows = rows.select(*keep, text_or_empty().alias("text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_histograms(low, high, buckets),
                           f"{kinds}n_words long, n_features long, buckets binary, times binary")


def _unpacked(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b, t in zip(batch.column("buckets").to_pylist(), batch.column("times").to_pylist()):
        yield np.frombuffer(b, "<u4"), np.frombuffer(t, "<u4").astype(np.int64)


def _totals(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, t in _unpacked(batch):
                total[b] += t  # the buckets of a document are distinct
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                                         names=["bucket", "n"])
    return run


def corpus_histogram(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all rows of :func:`feature_histograms`; a task sends one row a bucket."""
    return (features.select("buckets", "times").mapInArrow(_totals(buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One integer gain a bucket from two histograms of at most ``buckets`` rows."""
    counts = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for found, table in zip(counts, (corpus, target)):
        for r in table.collect():
            found[r["bucket"]] = r["n"]
    s, t = counts
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t)))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def _weights(gains: np.ndarray):
    def run(batches):
        for batch in batches:
            sums = [int((gains[b] * t).sum()) for b, t in _unpacked(batch)]
            weight = [x // n if n else 0 for x, n in zip(sums, batch.column("n_features").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(weight, pa.int64())],
                                             names=[*batch.schema.names[:-2], "weight"])
    return run


def _cut(scored: DataFrame, share: int) -> tuple[int, int]:
    """``(drawn, score)``: how many rows are drawn, and the lowest score that may be among them.

    Two grouped counts, of bins and of the scores of one bin; a gain is a
    thousand times a logarithm, so there are some hundred bins at any size.
    """
    bins = dict(scored.groupBy(F.floor(F.col("score") / _BIN).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    drawn = left = share * sum(bins.values()) // 100
    if not drawn:
        return 0, 0
    for b in sorted(bins, reverse=True):
        if bins[b] >= left:
            break
        left -= bins[b]
    inside = dict(scored.where(F.floor(F.col("score") / _BIN) == b).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect())
    for score in sorted(inside, reverse=True):
        if inside[score] >= left:
            break
        left -= inside[score]
    return drawn, score


def importance_resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS,
                        seed: int = SEED, share: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` for every row of ``docs``.

    ``rank`` (1, 2, 3...) is set for the ``share`` percent of the rows of at least
    ``min_words`` words that have the highest scores, ties to the smaller doc_id.
    ``target``: a table with a ``text`` column whose word windows set the aim.

    Null and empty texts have no features, weight 0 and are never drawn; each of
    several rows with one doc_id is a row of its own (they share the noise, and
    equal ones the order is free among); a null doc_id takes the noise of the
    empty id and comes last among ties.  Without documents there are no rows; an
    empty target leaves the corpus' own counts as the only term of the gains.
    Other columns play no part.
    """
    features = written(feature_histograms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                                          "doc_id", low=low, high=high, buckets=buckets), "features")
    gains = bucket_gains(corpus_histogram(features, buckets),
                         corpus_histogram(feature_histograms(target, low=low, high=high, buckets=buckets), buckets),
                         buckets)
    weighed = features.mapInArrow(_weights(gains), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = durable(weighed.withColumn("score", F.col("weight") + noise))
    may = F.col("n_words") >= min_words
    drawn, score = _cut(scored.where(may), share)
    top = may & (F.col("score") >= score) if drawn else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = (ranked(scored.where(top), order, "rank") if drawn
             else scored.where(top).withColumn("rank", F.lit(None).cast("long")))
    out = (first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
           .unionByName(scored.where(~top).withColumn("rank", F.lit(None).cast("long"))))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")

"""Hard-negative mining with angular triangle filtering.

Reference directions are the mean vectors of the most frequent labels.  Every
vector stores its angles to them and its norm.  By the triangle inequality on
the sphere the angle between an anchor and a row lies between the difference
and the sum of their angles to any reference, so the cosine lies in
``[cos(a + b), cos(a - b)]``; times the norms, widened by a margin well above
the rounding of doubles, that bounds the integer score from both sides.  Rows
whose bounds miss the window of scores that an anchor still needs are left out;
only the others are scored, exactly, in integers.

Rows are kept in tiles of one label with near angles, written once to the shared
folder.  A tile's ranges of angles and norms are tested first, then its rows.
Anchors - a stated share of the rows - are taken in blocks of bounded size; a
block is sent to all tasks, every task keeps the best few per anchor, and those
are merged by Spark.  No row is sent anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, scratch_path, written

#: Scores are inner products of ``floor(SCALE * x)``.
SCALE = 256
TOP = 5
#: A negative has at least so many percent of its positive's score.
SHARE = 80
#: Most reference directions.
REFERENCES = 16
TILE = 256
#: Anchors sent to the tasks at a time, about; hashing deals them out.
BLOCK = 4096
#: References whose intervals are worked out row by row.
_ROW_REFERENCES = 3
_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1
_TILES = ("label long, n int, ids binary, vectors binary, norms binary, angles binary")


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, vector`` of the rows that take part: all three there, every component a finite number."""
    big = F.lit(float("inf"))
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < big))
    return (rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
            .select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("vector")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """``floor(SCALE * x)`` of a list column; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _label_sums(labels: list[int], dims: int):
    def run(batches):
        sums = np.zeros((len(labels), dims))
        for batch in batches:
            of = batch.column("label").to_numpy()
            matrix = _matrix(batch.column("vector"), dims)
            for i, label in enumerate(labels):
                sums[i] += matrix[of == label].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(labels)), dims), pa.int32()),
             pa.array(np.tile(np.arange(dims), len(labels)), pa.int32()), pa.array(sums.ravel())],
            names=["label", "dim", "total"])
    return run


def references(rows: DataFrame, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors along the mean vectors of the most frequent labels (the first axis where there is none).

    Any directions give right results; these lie where the rows are.
    """
    dims = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    often = [r["label"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most).collect()]
    sums = np.zeros((len(often), dims))
    for label, dim, total in (rows.select("label", "vector")
                              .mapInArrow(_label_sums(often, dims), "label int, dim int, total double")
                              .groupBy("label", "dim").agg(F.sum("total")).collect()):
        sums[label, dim] = total
    size = np.abs(sums).max(axis=1, initial=0)
    fit = (size > 0) & np.isfinite(size)
    sums = sums[fit] / size[fit, None]
    units = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return units if len(units) else np.eye(1, dims)


def norms_and_angles(matrix: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of every row and its angles to the references; well conditioned at all angles."""
    size = np.abs(matrix).max(axis=1, keepdims=True, initial=0)
    unit = matrix / np.where(size > 0, size, 1)
    length = np.linalg.norm(unit, axis=1)
    angles = np.empty((len(matrix), len(refs)))
    for k, ref in enumerate(refs):
        along = unit @ ref
        angles[:, k] = np.arctan2(np.linalg.norm(unit - along[:, None] * ref, axis=1), along)
    return length * size[:, 0], angles


def _cut_tiles(refs: np.ndarray, dims: int, tile: int):
    def run(batches):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), dims)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            norms, angles = norms_and_angles(matrix, refs)
            near = angles.argmin(axis=1)
            order = np.lexsort((angles[np.arange(len(near)), near], near, labels))
            edges = np.flatnonzero(np.diff(labels[order])) + 1
            out = []
            for part in np.split(order, edges):
                for lo in range(0, len(part), tile):
                    at = part[lo:lo + tile]
                    out.append((int(labels[at[0]]), len(at), ids[at].tobytes(), _packed(matrix[at]),
                                norms[at].tobytes(), angles[at].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=["label", "n", "ids", "vectors", "norms", "angles"])
    return run


def _packed(matrix: np.ndarray) -> bytes:
    """Integers as 16 bits where they fit, else as doubles, which hold them exactly; the first byte tells."""
    small = np.abs(matrix).max(initial=0) < 1 << 15
    return (b"\0" if small else b"\1") + matrix.astype("<i2" if small else "<f8").tobytes()


def _unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    kind = "<f8" if data[0] else "<i2"
    return np.frombuffer(data, kind, offset=1).reshape(n, dims).astype(np.float64)


def tiles(rows: DataFrame, refs: np.ndarray, tile: int = TILE) -> DataFrame:
    """Rows of :func:`usable` as tiles: one label, near angles; vectors, norms and angles packed."""
    return rows.mapInArrow(_cut_tiles(refs, refs.shape[1], tile), _TILES)


def exact_scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of integer rows; ``most`` bounds their size.  Beyond a long the nearest long."""
    if most < _EXACT:  # every partial sum is below 2^52, so doubles are exact
        return np.rint(a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    product = whole[0] @ whole[1].T
    return np.array([[max(-_LONG - 1, min(_LONG, x)) for x in row] for row in product],
                    np.int64).reshape(len(a), len(b))


class Block:
    """A block of anchors with norms and angles."""

    def __init__(self, ids, labels, matrix, refs):
        self.ids, self.labels, self.matrix, self.refs = ids, labels, matrix, refs
        self.norms, self.angles = norms_and_angles(matrix, refs)

    def __len__(self):
        return len(self.ids)


def _margin(most: np.ndarray) -> np.ndarray:
    """What rounding can take from a bound, many times over, and one for the integers."""
    return 1 + 1e-9 * most


def tile_windows(block: Block, who: np.ndarray, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that each anchor of ``who`` can have with any row of a tile."""
    mine, low, high = block.angles[who], angles.min(axis=0), angles.max(axis=0)
    gap = np.maximum(np.maximum(low - mine, mine - high), 0)
    best = np.cos(gap.max(axis=1))
    worst = np.cos(np.minimum(mine + high, np.pi).min(axis=1))
    size = block.norms[who]
    slack = _margin(size * norms.max())
    top = size * np.where(best > 0, norms.max(), norms.min()) * best
    bottom = size * np.where(worst > 0, norms.min(), norms.max()) * worst
    return bottom - slack, top + slack


def row_overlap(block: Block, who: np.ndarray, angles: np.ndarray, norms: np.ndarray,
                low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows of a tile can have a score between ``low`` and ``high`` with which anchor of ``who``."""
    mine, size = block.angles[who], block.norms[who]
    pick = np.argsort(-np.abs(mine.mean(axis=0) - angles.mean(axis=0)))[:_ROW_REFERENCES]
    top = np.full((len(who), len(norms)), np.inf)
    bottom = -top
    for k in pick:  # cos(a -+ b) times the norms, by the addition theorem
        along = np.outer(size * np.cos(mine[:, k]), norms * np.cos(angles[:, k]))
        across = np.outer(size * np.sin(mine[:, k]), norms * np.sin(angles[:, k]))
        np.minimum(top, along + across, out=top)
        np.maximum(bottom, along - across, out=bottom)
    slack = _margin(np.outer(size, norms))
    # what cannot be compared, because norms overflow, stays
    return ~((top + slack < low[:, None]) | (bottom - slack > high[:, None]))


class Best:
    """The first ``top`` (score, id) of every list, by score down and id up."""

    def __init__(self, lists: int, top: int):
        self.score = np.full((lists, top), -_LONG - 1, np.int64)
        self.id = np.full((lists, top), _LONG, np.int64)
        self.n = np.zeros(lists, np.int64)
        self.top = top

    def least(self, lists: np.ndarray) -> np.ndarray:
        """A score below this one cannot enter a list any more."""
        return np.where(self.n[lists] < self.top, -_LONG - 1, self.score[lists, -1])

    def offer(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """``scores`` (list, row) of rows ``ids``; only ``valid`` ones count."""
        valid = valid & ((self.n[lists] < self.top)[:, None] | (scores >= self.score[lists, -1:]))
        some = valid.any(axis=1)
        if not some.any():
            return
        lists, scores, valid = lists[some], scores[some], valid[some]
        held = np.arange(self.top) < self.n[lists][:, None]
        score = np.concatenate([self.score[lists], scores], axis=1)
        ident = np.concatenate([self.id[lists], np.broadcast_to(ids, scores.shape)], axis=1)
        there = np.concatenate([held, valid], axis=1)
        # reversed scores by complement: -score would not fit for the smallest long
        order = np.lexsort((ident, ~score, ~there), axis=-1)[:, :self.top]
        self.score[lists] = np.take_along_axis(score, order, axis=1)
        self.id[lists] = np.take_along_axis(ident, order, axis=1)
        self.n[lists] = np.minimum(there.sum(axis=1), self.top)

    def batch(self) -> pa.RecordBatch:
        lists, at = np.nonzero(np.arange(self.top) < self.n[:, None])
        return pa.RecordBatch.from_arrays(
            [pa.array(lists, pa.int32()), pa.array(self.score[lists, at]), pa.array(self.id[lists, at])],
            names=["list", "score", "id"])


def _tile(row) -> tuple[int, np.ndarray, bytes, np.ndarray, np.ndarray]:
    n = row["n"]
    return (row["label"], np.frombuffer(row["ids"], np.int64), row["vectors"],
            np.frombuffer(row["norms"]), np.frombuffer(row["angles"]).reshape(n, -1))


def _search(block: Block, same: bool, low: np.ndarray, high: np.ndarray, owner: np.ndarray, top: int):
    """Best rows of every list: list ``i`` asks for scores of anchor ``owner[i]`` in ``[low[i], high[i]]``.

    ``same``: rows of the anchor's label, other than itself; else rows of other labels.
    Lists of an anchor are neighbours in ``owner``.
    """
    start = np.searchsorted(owner, np.arange(len(block)))
    lists_of = np.bincount(owner, minlength=len(block))
    asking = np.flatnonzero(lists_of)
    every = np.arange(len(owner))
    ceiling = np.zeros(len(block), np.int64)
    ceiling[asking] = np.maximum.reduceat(high, start[asking])

    def run(batches):
        best = Best(len(owner), top)
        for batch in batches:
            for row in batch.to_pylist():
                label, ids, packed, norms, angles = _tile(row)
                fit = (block.labels == label) if same else (block.labels != label)
                who = np.flatnonzero(fit & (lists_of > 0))
                if not len(who):
                    continue
                # the lowest score that any list of an anchor still needs
                needed = np.zeros(len(block), np.int64)
                needed[asking] = np.minimum.reduceat(np.maximum(low, best.least(every)), start[asking])
                floor, ceil = needed[who], ceiling[who]
                bottom, peak = tile_windows(block, who, angles, norms)
                stay = ~((peak < floor) | (bottom > ceil))
                who, floor, ceil = who[stay], floor[stay], ceil[stay]
                if not len(who):
                    continue
                overlap = row_overlap(block, who, angles, norms, floor, ceil)
                a, r = overlap.any(axis=1), overlap.any(axis=0)
                if not a.any():
                    continue
                who, overlap, ids, norms = who[a], overlap[np.ix_(a, r)], ids[r], norms[r]
                matrix = _unpacked(packed, row["n"], block.matrix.shape[1])[r]
                scores = exact_scores(block.matrix[who], matrix, float(block.norms[who].max() * norms.max()))
                if same:
                    overlap = overlap & (block.ids[who][:, None] != ids)
                for j in range(int(lists_of[who].max())):
                    having = np.flatnonzero(lists_of[who] > j)
                    lists = start[who[having]] + j
                    part = scores[having]
                    best.offer(lists, part, ids, overlap[having]
                               & (part >= low[lists][:, None]) & (part <= high[lists][:, None]))
        yield best.batch()
    return run


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of every list over all tasks, with their rank."""
    order = Window.partitionBy("list").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _blocks(anchors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Anchors dealt by hash into blocks of about half of ``size``; equal ones count once."""
    distinct = durable(anchors.distinct())
    n = distinct.count()
    blocks = -(-2 * n // size)
    return durable(distinct.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(max(blocks, 1))))), blocks


def hard_negatives(rows: DataFrame, is_anchor: Column, top: int = TOP, share: int = SHARE,
                   block_size: int = BLOCK, most_references: int = REFERENCES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: ``id, label, vector`` as :func:`usable` gives them; ``is_anchor``
    tells the anchors by ``id``.  A score is the inner product of the integer
    vectors; higher scores come first, ties by smaller id.  An anchor's positives
    are its first ``top`` rows of the same label and another id; for each of
    them the first ``top`` rows of other labels with ``share * positive_score <=
    100 * negative_score <= 100 * positive_score`` are returned, ``rank`` from 1.

    A null id takes no part, as nothing could name it.  Rows that repeat an id
    are candidates each; equal anchors are one.  A shorter vector ends in zeros,
    an empty one is zero; products beyond a long count as the nearest long.  A
    positive score below zero has no negatives.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    refs = references(rows, most_references)
    dims = refs.shape[1]
    stored = written(tiles(rows, refs), "tiles")
    anchors, blocks = _blocks(rows.where(is_anchor), block_size)
    path = scratch_path(spark, "negatives")
    names = "list int, score long, id long"
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], result).write.parquet(path)
    for number in range(blocks):
        part = anchors.where(F.col("block") == number).drop("block").toArrow()
        if not part.num_rows:
            continue
        vectors = part.column("vector").combine_chunks()
        block = Block(part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(vectors, dims), refs)
        each = np.arange(len(block))
        any_score = np.full(len(block), _LONG)
        found = _best(stored.mapInArrow(_search(block, True, ~any_score, any_score, each, top), names), top).collect()
        positives = sorted((r["list"], r["rank"], r["score"], r["id"]) for r in found if r["score"] >= 0)
        if not positives:
            continue
        owner, _, score, ident = (np.array(c, np.int64) for c in zip(*positives))
        low = np.array([-(-share * int(s) // 100) for s in score], np.int64)
        pairs = spark.createDataFrame([(i, int(block.ids[a]), int(p), int(s)) for i, (a, s, p)
                                       in enumerate(zip(owner, score, ident))],
                                      "list int, anchor_id long, positive_id long, positive_score long")
        mined = _best(stored.mapInArrow(_search(block, False, low, score, owner, top), names), top)
        (mined.join(F.broadcast(pairs), "list")
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score"))
         .write.mode("append").parquet(path))
    return spark.read.schema(result).parquet(path)


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Embeddings whose label moves on by one where vec_id is divisible by ``every``."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels)
                           .otherwise(F.col("label")))

"""Non-negative positive-unlabelled learning with numpy.

A linear classifier is fitted from trusted positives and unlabelled texts.  With
class prior ``p`` the risk is ``p R+ + max(0, Ru- - p Rp-)`` (logistic loss):
the unlabelled risk, less what the positives among the unlabelled add to it,
never counted below zero.  Where it would be, the step goes back up along it,
which stops the model from memorising unlabelled texts as negatives.

The fit is made on a bounded sample, chosen by the hash of the id; features are
computed on the executors, and the driver receives feature numbers only.
Scoring reads every whole text on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

Features = Callable[[str], tuple[np.ndarray, np.ndarray | None]]


class Fit(NamedTuple):
    """Parameters of one fit.  The two sample sizes are the bound on what is fitted on."""
    positives: int = 3000
    unlabelled: int = 9000
    dims: int = 1 << 18
    min_docs: int = 3
    epochs: int = 40
    batches: int = 8
    rate: float = 0.05
    decay: float = 1e-4
    step_back: float = 0.5
    purity: float = 0.0
    sigmas: float = 0.0
    seed: int = 7


class Linear(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, idx: np.ndarray, val: np.ndarray | None) -> float:
        w = self.weights[idx]
        z = float(w.sum() if val is None else w @ val) + self.bias
        return 1.0 / (1.0 + np.exp(-z)) if z > -500 else 0.0


class Rows:
    """Sparse rows, end to end: sizes, feature numbers, and values (None: all one)."""

    def __init__(self, size: np.ndarray, idx: np.ndarray, val: np.ndarray | None = None):
        self.size, self.idx, self.val = size.astype(np.int64), idx, val
        self.end = np.cumsum(self.size)

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray | None]]) -> "Rows":
        size = np.array([len(i) for i, _ in rows], dtype=np.int64)
        idx = np.concatenate([i for i, _ in rows]).astype(np.int32) if rows else np.empty(0, np.int32)
        if not rows or all(v is None for _, v in rows):
            return cls(size, idx)
        return cls(size, idx, np.concatenate([v for _, v in rows]).astype(np.float32))

    def only(self, usable: np.ndarray) -> "Rows":
        """The same rows with usable features alone."""
        stays = usable[self.idx]
        row = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[stays]
        return Rows(np.bincount(row, minlength=len(self.size)), self.idx[stays],
                    None if self.val is None else self.val[stays])

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        size = self.size[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.end[rows] - size, size)
        return row, self.idx[at], 1.0 if self.val is None else self.val[at]


def _sum_by(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_rows(pos: Rows, unl: Rows, prior: float, how: Fit = Fit()) -> Linear:
    """nnPU fit by mini-batch Adam.

    Without positives every score is the prior (clipped away from 0 and 1).
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    w, b = np.zeros(how.dims), start
    n_pos, n_unl = len(pos.size), len(unl.size)
    if not n_pos or not n_unl:
        return Linear(w.astype(np.float32), b)
    in_p, in_u = np.bincount(pos.idx, minlength=how.dims), np.bincount(unl.idx, minlength=how.dims)
    usable = in_p + in_u >= how.min_docs
    if how.purity:  # features that mark positives: prior x rate among positives / rate among unlabelled
        rate_p, rate_u = in_p / n_pos, np.maximum(in_u, 0.5) / n_unl
        spread = np.sqrt(rate_u * (1 / n_pos + 1 / n_unl))
        usable &= (prior * rate_p >= how.purity * rate_u) & (rate_p - rate_u >= how.sigmas * spread)
    p_rows, u_rows = pos.only(usable), unl.only(usable)
    rng = np.random.default_rng(how.seed)
    m, v = np.zeros(how.dims + 1), np.zeros(how.dims + 1)
    batches = max(1, min(how.batches, n_pos // 8))
    turn = 0
    for epoch in range(how.epochs):
        order_p, order_u = rng.permutation(n_pos), rng.permutation(n_unl)
        for bp, bu in zip(np.array_split(order_p, batches), np.array_split(order_u, batches)):
            turn += 1
            rp, ip, vp = p_rows.part(bp)
            ru, iu, vu = u_rows.part(bu)
            zp = _sum_by(rp, w[ip] * vp, len(bp)) + b
            zu = _sum_by(ru, w[iu] * vu, len(bu)) + b
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp = np.full(len(bp), -prior / len(bp))
                gu = _sigmoid(zu) / len(bu)
            else:
                gp = -prior / len(bp) * _sigmoid(-zp) + how.step_back * prior / len(bp) * _sigmoid(zp)
                gu = -how.step_back * _sigmoid(zu) / len(bu)
            g = np.empty(how.dims + 1)
            g[:-1] = _sum_by(ip, gp[rp] * vp, how.dims) + _sum_by(iu, gu[ru] * vu, how.dims) + how.decay * w
            g[-1] = gp.sum() + gu.sum()
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            step = how.rate * (1 - epoch / how.epochs) * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
            w -= step[:-1]
            b -= step[-1]
    w = w.astype(np.float32)
    if how.purity:
        b = _widest_gap(w, b, u_rows, prior)
    return Linear(w, float(b))


def _widest_gap(w: np.ndarray, b: float, rows: Rows, prior: float) -> float:
    """The bias that puts the boundary into the widest gap of the unlabelled
    scores where a share of positives near the prior lies above it."""
    row, idx, val = rows.part(np.arange(len(rows.size)))
    z = np.sort(_sum_by(row, w[idx] * val, len(rows.size)) + b)[::-1]
    lo, hi = max(1, int(0.85 * prior * len(z))), min(len(z) - 1, int(prior * len(z)) + 1)
    gaps = z[:-1] - z[1:]
    at = lo - 1 + int(gaps[lo - 1:hi].argmax()) if lo <= hi else 0
    if len(gaps) and gaps[at] <= 1e-6:  # texts without any mark start above: the last gap before them
        above = np.flatnonzero(gaps[:lo] > 1e-6)
        at = int(above[-1]) if len(above) else -1
    if not len(gaps) or at < 0:
        return b
    return b - (z[at] + z[at + 1]) / 2


def remainder(col: str, of: int) -> Column:
    """``crc32(id as text) mod of``; a null id reads as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(of)


def _first_ids(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` ids of smallest hash, fewer if there are not as many: ids only, and
    a cut by hash first, so that each task sends about its share of ``4 n`` rows."""
    total = ids.count()
    share = min(1.0, 4.0 * n / max(total, 1))
    if share < 1.0 and total * share > 1000:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _featurise(features: Features):
    def run(batches):
        for batch in small_batches(batches):
            out = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), pa.array([i.astype("<i4").tobytes() for i, _ in out], pa.binary()),
                 pa.array([None if v is None else v.astype("<f4").tobytes() for _, v in out], pa.binary())], names=["positive", "idx", "val"])
    return run


def learn(docs: DataFrame, labels: DataFrame, label: str, learn_fold: Column, features: Features,
          how: Fit = Fit()) -> tuple[Linear, float]:
    """Fit on rows where ``learn_fold`` (an expression of doc_id) holds.

    Positives: documents labelled 1.  Unlabelled: documents of the same fold,
    whatever their label.  The class prior is the share of 1 among the fold's
    labels (all of them).  Returns the model and the prior.
    """
    marks = labels.where(learn_fold & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    share = marks.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    if share is None:
        return fit_rows(Rows.of([]), Rows.of([]), 0.5, how), 0.5
    pos = _first_ids(marks.where(F.col(label) == 1).select("doc_id").distinct(), how.positives)
    unl = _first_ids(docs.where(learn_fold & F.col("doc_id").isNotNull()).select("doc_id").distinct(), how.unlabelled)
    # at most `positives` + `unlabelled` ids: a bounded broadcast
    wanted = F.broadcast(pos.select("doc_id", F.lit(True).alias("positive"))
                         .unionByName(unl.select("doc_id", F.lit(False).alias("positive"))))
    sample = (docs.select("doc_id", text_or_empty().alias("text")).join(wanted, "doc_id")
              .select("positive", "text")
              .mapInArrow(_featurise(features), "positive boolean, idx binary, val binary").toArrow())
    return fit_rows(*(_collected(sample, kind) for kind in (True, False)), prior=share, how=how), share


def _collected(sample: pa.Table, positive: bool) -> Rows:
    """One kind of the sampled rows, without a Python object a row."""
    part = sample.filter(pc.equal(sample.column("positive"), positive))

    def flat(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
        chunks = [c for c in part.column(name).chunks if len(c)]
        size = [np.diff(np.frombuffer(c.buffers()[1], "<i4")[c.offset:c.offset + len(c) + 1]) for c in chunks]
        data = [np.frombuffer(b"".join(c.to_pylist()), kind) for c in chunks]
        return (np.concatenate([*size, np.empty(0, np.int32)]) // 4, np.concatenate([*data, np.empty(0, kind)]))
    size, idx = flat("idx", "<i4")
    if part.column("val").null_count:
        return Rows(size, idx)
    return Rows(size, idx, flat("val", "<f4")[1])


def row_wise(docs: DataFrame, run, keep: tuple[str, ...], added: str) -> DataFrame:
    """``keep`` columns of ``docs`` and the ``added`` ones that ``run(texts)`` gives
    as Arrow columns; ``run`` sees every whole text, null as empty."""
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    names = [*keep, *(part.split()[0] for part in added.split(", "))]

    def each(batches):
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *run(texts)], names=names)
    return rows.mapInArrow(each, f"{kinds}, {added}")


def scored(docs: DataFrame, model: Linear, features: Features, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` columns and the model's score of every whole text."""
    return row_wise(docs, lambda texts: [pa.array([float(model.score(*features(t))) for t in texts], pa.float64())],
                    keep, f"{name} double")

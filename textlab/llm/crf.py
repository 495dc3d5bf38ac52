"""Quality rules by line labelling: a linear-chain CRF marks content and boilerplate.

Every line of a text gets binary features of its form.  A two-state chain
(content, boilerplate) is trained by maximum likelihood in numpy on a bounded
sample of labelled documents: no one has labelled lines, so a line takes the
label of its document (distant supervision), and stretches of good and bad
documents are joined, so that switches of state are seen.  Viterbi decoding labels the lines
of every whole text; a text is kept when content lines hold at least half of
its characters.  Base counts and their limits come first.
"""

from __future__ import annotations

import re
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .pu import _first_ids, row_wise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
#: Bounds of the training sample: documents of either label.
GOOD_DOCS, BAD_DOCS = 2000, 2000
#: Lines of one training document; longer ones are trained on in stretches.
STRETCH = 64
CONTENT, BOILERPLATE = 0, 1
#: The characters that count as symbols.
_SYMBOLS = "#*$%&|<>"
#: Words are runs of characters other than these.
_BLANKS = " \t\n\x0b\x0c\r"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n + 2)
    base = len(codes)
    if base < 2_000_000:  # three codes fit a 64-bit number
        keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        keys = pair[:-1].astype(np.int64) * base + ids[2:]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift:n + shift] |= twice
    return int(covered.sum())


def split_words(text: str) -> list[str]:
    """Runs of characters other than ASCII blanks."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return _WORDS.findall(text)


def base_counts(text: str, words: list[str]) -> Base:
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    blanks = sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, _SYMBOLS))
    return Base(len(words), len(text) - blanks, symbols, dup, repeated_words(words))


_STEPS = 6
N_FEATURES = 8 * _STEPS + 6


def _step(value: float, limits: tuple[float, ...]) -> int:
    at = 0
    for limit in limits:
        if value <= limit:
            break
        at += 1
    return at


def line_features(line: str, before: set[str]) -> list[int]:
    """Numbers of the features that hold for one line; ``before``: earlier lines."""
    words = line.split()
    n = len(words)
    if not n:
        return [8 * _STEPS]
    chars = len(line) - line.count(" ")
    kinds = len(set(words))
    marks = sum(map(line.count, _SYMBOLS))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    bangs = line.count("!")
    digits = sum(map(line.count, "0123456789"))
    stops = line.count(".") + line.count(",")
    same = sum(map(str.__eq__, words, words[1:]))
    out = [
        _step(n, (1, 3, 8, 20, 60)),
        _STEPS + _step(marks / chars, (0, 0.02, 0.05, 0.1, 0.2)),
        2 * _STEPS + _step(upper / n, (0, 0.05, 0.2, 0.5, 0.9)),
        3 * _STEPS + _step(kinds / n, (0.1, 0.25, 0.45, 0.7, 0.9)),
        4 * _STEPS + _step(bangs / n, (0, 0.05, 0.2, 0.5, 0.9)),
        5 * _STEPS + _step(digits / chars, (0, 0.02, 0.1, 0.3, 0.6)),
        6 * _STEPS + _step(stops / n, (0, 0.03, 0.08, 0.2, 0.5)),
        7 * _STEPS + _step(same / n, (0, 0.02, 0.1, 0.3, 0.6)),
    ]
    if line in before:
        out.append(8 * _STEPS + 1)
    if line[0].isupper():
        out.append(8 * _STEPS + 2)
    if line.rstrip()[-1] in ".!?":
        out.append(8 * _STEPS + 3)
    if "|" in line:
        out.append(8 * _STEPS + 4)
    out.append(8 * _STEPS + 5)
    return out


def text_lines(text: str) -> tuple[list[list[int]], list[int]]:
    """Features and characters (blanks aside) of the lines that hold a word."""
    feats, sizes, before = [], [], set()
    for line in text.split("\n"):
        if line.strip():
            feats.append(line_features(line, before))
            sizes.append(len(line) - line.count(" "))
            before.add(line)
    return feats, sizes


class Chain(NamedTuple):
    """Weights: (features, 2) emissions and (2, 2) transitions."""
    emit: np.ndarray
    move: np.ndarray

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        size = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = np.fromiter((f for x in feats for f in x), np.int64, int(size.sum()))
        return np.add.reduceat(self.emit[flat], np.cumsum(size) - size, axis=0)

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        """Best state of every line (ties to content)."""
        if not feats:
            return []
        rows = self.scores(feats).tolist()
        (cc, cb), (bc, bb) = self.move.tolist()
        c, b = rows[0]
        back = []
        for ec, eb in rows[1:]:
            from_c, from_b = c + cc >= b + bc, c + cb >= b + bb
            back.append((CONTENT if from_c else BOILERPLATE, CONTENT if from_b else BOILERPLATE))
            c, b = (c + cc if from_c else b + bc) + ec, (c + cb if from_b else b + bb) + eb
        state = CONTENT if c >= b else BOILERPLATE
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        out.reverse()
        return out

    def content_share(self, text: str) -> float:
        """Share of the characters in content lines (0 for a text without words)."""
        feats, sizes = text_lines(text)
        total = sum(sizes)
        if not total:
            return 0.0
        return sum(compress(sizes, (s == CONTENT for s in self.viterbi(feats)))) / total


def joined_stretches(sequences: list[tuple[list[list[int]], int]]) -> list[tuple[list[list[int]], list[int]]]:
    """Every stretch by itself, and stretches of good and bad texts joined by turns, so that both
    states and the switches between them are seen.

    Both states get as many stretches: those of the rarer one are taken again in
    turn.  A joined sequence takes half a stretch of each, and every other one
    begins with the bad half.
    """
    by_state = [[feats[i:i + STRETCH] for feats, state in sequences if state == s for i in range(0, len(feats), STRETCH)]
                for s in (CONTENT, BOILERPLATE)]
    out = [(x, [s] * len(x)) for s, parts in enumerate(by_state) for x in parts]
    if not all(by_state):
        return out
    for k in range(max(map(len, by_state))):
        halves = []
        for s in (CONTENT, BOILERPLATE):
            x = by_state[s][k % len(by_state[s])]
            x = x[:STRETCH // 2]
            halves.append((x, [s] * len(x)))
        if k % 2:
            halves.reverse()
        out.append((halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]))
    return out


class Likelihood:
    """Negative log-likelihood of labelled sequences, a weight each, and its gradient.

    Sequences are stretched over a grid (sequence, line, state), so that one
    evaluation is a forward and a backward sweep over the longest sequence.
    """

    def __init__(self, parts: list[tuple[list[list[int]], list[int]]], weight: np.ndarray):
        order = np.argsort([-len(f) for f, _ in parts], kind="stable")  # longest first: a step takes a head of the rows
        parts, weight = [parts[i] for i in order], weight[order]
        size = np.array([len(f) for f, _ in parts])
        self.n, self.width, self.weight, self.last = len(parts), int(size[0]), weight, size - 1
        self.live = [int((size > t).sum()) for t in range(self.width)]
        self.seq = np.repeat(np.arange(self.n), size)  # of every line, as its position
        self.pos = np.concatenate([np.arange(k) for k in size])
        many = np.array([len(x) for f, _ in parts for x in f])
        self.first, self.line = np.cumsum(many) - many, np.repeat(np.arange(len(many)), many)
        self.num = np.array([k for f, _ in parts for x in f for k in x])  # the features of all lines
        self.moved = np.zeros((2, 2))
        state = np.array([s for _, states in parts for s in states])
        self.observed = self._by_feature((state[:, None] == np.arange(2)) * weight[self.seq, None])
        for w, (_, states) in zip(weight, parts):
            np.add.at(self.moved, (states[:-1], states[1:]), w)

    def _by_feature(self, lines: np.ndarray) -> np.ndarray:
        """Sums of a (line, state) table over the lines of every feature."""
        return np.stack([np.bincount(self.num, lines[self.line, s], N_FEATURES) for s in range(2)], axis=1)

    def __call__(self, emit: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        live, weight, seq, pos = self.live, self.weight, self.seq, self.pos
        grid = np.zeros((self.n, self.width, 2))
        grid[seq, pos] = np.add.reduceat(emit[self.num], self.first)
        fwd, bwd = np.zeros_like(grid), np.zeros_like(grid)
        fwd[:, 0] = grid[:, 0]
        for t in range(1, self.width):
            k = live[t]
            fwd[:k, t] = np.logaddexp(fwd[:k, t - 1, :1] + move[0], fwd[:k, t - 1, 1:] + move[1]) + grid[:k, t]
        for t in range(self.width - 2, -1, -1):
            k = live[t + 1]
            ahead = grid[:k, t + 1] + bwd[:k, t + 1]
            bwd[:k, t] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        end = fwd[np.arange(self.n), self.last]
        total = np.logaddexp(end[:, 0], end[:, 1])
        prob = np.exp(fwd[seq, pos] + bwd[seq, pos] - total[seq, None])
        g_emit = self._by_feature(prob * weight[seq, None]) - self.observed
        g_move = -self.moved
        for t in range(1, self.width):
            k = live[t]
            pair = np.exp(fwd[:k, t - 1, :, None] + move + (grid[:k, t] + bwd[:k, t])[:, None, :] - total[:k, None, None])
            g_move += (pair * weight[:k, None, None]).sum(axis=0)
        value = float((weight * total).sum() - (self.observed * emit).sum() - (self.moved * move).sum())
        return value, g_emit, g_move


def train_chain(sequences: list[tuple[list[list[int]], int]], rounds: int = 150, rate: float = 0.2,
                decay: float = 1e-3) -> Chain:
    """Maximum likelihood by full-batch Adam over the stretches of (line features, state) sequences
    and their joins (:func:`joined_stretches`).

    Without sequences of both states every weight is zero: all lines are content.
    """
    parts = [p for p in joined_stretches(sequences) if p[0]]
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len({s for _, states in parts for s in states}) < 2:
        return Chain(emit, move)
    # good, bad and joined sequences weigh alike, however many of each there are
    kind = np.array([states[0] if min(states) == max(states) else 2 for _, states in parts])
    weight = (1 / 3 / np.maximum(np.bincount(kind, minlength=3), 1))[kind]
    likelihood = Likelihood(parts, weight)
    m = [np.zeros_like(emit), np.zeros_like(move)]
    v = [np.zeros_like(emit), np.zeros_like(move)]
    for turn in range(1, rounds + 1):
        _, g_emit, g_move = likelihood(emit, move)
        for k, (par, grad) in enumerate(((emit, g_emit), (move, g_move))):
            grad = grad + decay * par
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            par -= rate * (m[k] / (1 - 0.9 ** turn)) / (np.sqrt(v[k] / (1 - 0.99 ** turn)) + 1e-8)
    return Chain(emit, move)


def _line_rows():
    def run(batches):
        for batch in small_batches(batches):
            states, out = batch.column("bad").to_pylist(), []
            for text in batch.column("text").to_pylist():
                feats = text_lines(text)[0]
                out.append(np.array([k for x in feats for k in (len(x), *x)], "u1").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(states, pa.int32()), pa.array(out, pa.binary())],
                                             names=["bad", "lines"])
    return run


def _unpack(data: bytes) -> list[list[int]]:
    out, at = [], 0
    while at < len(data):
        out.append(list(data[at + 1:at + 1 + data[at]]))
        at += 1 + data[at]
    return out


def learn_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """Chain fitted on at most ``GOOD_DOCS`` + ``BAD_DOCS`` labelled documents (whole texts)."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = _first_ids(marks.where("quality = 1").select("doc_id").distinct(), GOOD_DOCS)
    bad = _first_ids(marks.where("quality = 0").select("doc_id").distinct(), BAD_DOCS)
    wanted = F.broadcast(good.select("doc_id", F.lit(CONTENT).alias("bad"))
                         .unionByName(bad.select("doc_id", F.lit(BOILERPLATE).alias("bad"))))
    rows = (docs.select("doc_id", text_or_empty().alias("text")).join(wanted, "doc_id")
            .select("bad", "text").mapInArrow(_line_rows(), "bad int, lines binary").toArrow())
    return train_chain([(_unpack(b), s) for s, b in zip(rows.column("bad").to_pylist(), rows.column("lines").to_pylist())])


def _verdicts(chain: Chain):
    def run(texts: list[str]) -> list[pa.Array]:
        base = [base_counts(t, split_words(t)) for t in texts]
        share = [chain.content_share(t) for t in texts]
        failed = [b.failed() for b in base]
        kept = [not f and s >= MIN_CONTENT_SHARE for f, s in zip(failed, share)]
        counts = [pa.array([b[k] for b in base], pa.int64()) for k in range(len(Base._fields))]
        return [*counts, pa.array(failed, pa.bool_()), pa.array(share, pa.float64()), pa.array(kept, pa.bool_())]
    return run


def quality_verdicts(docs: DataFrame, chain: Chain, *keep: str, prefix: str = "") -> DataFrame:
    """``keep`` columns, the five base counts, ``base_failed``, ``content_share``, ``kept``.

    Null and empty texts have no words and fail the base limits; repeated rows
    are judged alike; an empty table gives no rows.  ``prefix`` goes before the
    names of the added columns.
    """
    added = [*(f"{prefix}{n} long" for n in Base._fields), f"{prefix}base_failed boolean",
             f"{prefix}content_share double", f"{prefix}kept boolean"]
    return row_wise(docs, _verdicts(chain), keep, ", ".join(added))

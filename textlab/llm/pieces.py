"""SentencePiece encoding and decoding.

Encoding: an Aho-Corasick automaton over the vocabulary pieces reads a segment
once; at every character the matches that end there (the output links) relax
that position, and the segmentation is read back from the end.

* A unigram model scores a path by the sum of its pieces' scores (Viterbi).
* A BPE model (the public file) scores by its merge order.  Summing those ranks
  would pick many frequent short pieces, so the pass works on transitions: two
  pieces may follow each other (score 0) exactly if merging their joined text
  gives the two pieces back, else not (minus infinity).  A path of such
  transitions is the segmentation that merging gives, and there is one for every
  prefix, so a position is settled by the first match that may follow what is
  best at its start.  Transitions are solved once and kept.

A character that no piece covers becomes its UTF-8 byte pieces.

A text is first cut where no piece can cross: before every run of spaces
(pieces hold the space mark only in front, or nothing else), around line feeds
(in no piece), and before marks that no piece has after a letter.  The cuts
change no result, and let equal segments be solved once.

Decoding joins the pieces' bytes; it restores every text except that a literal
space mark (U+2581) comes back as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, small_batches, text_or_empty

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments kept by a worker; the table starts anew when it is full.
MEMO = 500_000
_NORMAL, _BYTE, _USER = 1, 6, 4
_BPE = 2
#: Transitions kept by a worker.
_PAIRS = 300_000
#: Whole numbers keep long sums exact.
_UNCOVERED = -(10 ** 13)
_NEVER = float("-inf")
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class PieceModel:
    """Vocabulary, automaton and byte table of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.scores: dict[str, tuple[int, int | float]] = {}
        self.raw: list[bytes] = []
        self.byte_id: list[int] = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.raw.append(bytes([value]))
            elif p.type in (_NORMAL, _USER):
                self.scores[p.piece] = (i, int(p.score) if p.score == int(p.score) else p.score)
                self.raw.append(p.piece.replace(MARK, " ").encode("utf-8"))
            else:
                self.raw.append(b"")
        if any(MARK in piece[1:] and set(piece) != {MARK} or "\n" in piece for piece in self.scores):
            raise ValueError("a piece of this model crosses a space or a line")
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.scores.items():
            self.automaton.add_word(piece, (len(piece) - 1, i, score))  # from the last to the first character
        self.automaton.make_automaton()
        # marks that no piece has right after a letter: a segment may be cut there as well
        self.marks = frozenset(m for m in ".,!?;:" if not any(
            a.isalpha() and b == m for piece in self.scores for a, b in zip(piece, piece[1:])))
        self.memo = Memo(self._solve, MEMO)
        self.bpe = proto.trainer_spec.model_type == _BPE
        self.text_of = {i: piece for piece, (i, _) in self.scores.items()}
        self.follows = Memo(self._follows, _PAIRS)

    def merged(self, text: str) -> list[str]:
        """Symbols of ``text`` after merging: best score first, ties from the left."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(symbols):
                joined = symbols[left] + symbols[right]
                if joined in self.scores:
                    heapq.heappush(heap, (-self.scores[joined][1], left, joined))

        for left in range(len(symbols) - 1):
            offer(left)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left] if symbols[left] is not None else len(symbols)
            if right >= len(symbols) or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[right] < len(symbols):
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [x for x in symbols if x is not None]

    def _follows(self, pair: tuple[int, int]) -> bool:
        """Whether the second piece may stand after the first (-1: after the start or a byte)."""
        parts = [self.text_of[i] for i in pair if i >= 0]
        return self.merged("".join(parts)) == parts

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            if part in self.scores:
                out.append(self.scores[part][0])
            else:
                out += [self.byte_id[b] for b in part.encode("utf-8", "surrogatepass")]
        return out

    def admissible(self, text: str) -> list[int]:
        """Ids of the path of admissible transitions: what merging ``text`` gives."""
        if text.startswith(MARK + MARK):  # runs of spaces have equal scores: merged from the left
            return self._ids(self.merged(text))
        n, follows = len(text), self.follows
        last: list[int | None] = [-1] + [None] * n
        back = [0] * (n + 1)
        known = self.scores
        done = 0

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:  # characters in no piece
                if last[done + 1] is None and last[done] is not None and text[done] not in known:
                    last[done + 1], back[done + 1] = -1, done
                done += 1

        for end, (length, i, _) in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end - length
                if start > done:
                    settle(start)
                prev = last[start]
                if prev is not None and follows[prev, i]:
                    last[end + 1], back[end + 1] = i, start
        settle(n)
        parts, at = [], n
        while at:
            parts.append(text[back[at]:at])
            at = back[at]
        return self._ids(parts[::-1])

    def segment(self, text: str) -> list[int]:
        """Ids of the best-scored segmentation of ``text`` (already marked)."""
        n = len(text)
        score: list = [0] + [_NEVER] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for end, (length, i, gain) in self.automaton.iter(text):
            start, stop = end - length, end + 1
            value = score[start] + gain
            if value > score[stop]:
                score[stop] = value
                back[stop] = (start, i)
        if score[n] == _NEVER:  # some character is in no piece
            self._relax_bytes(text, score, back)
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.byte_id[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass"))]
            at = start
        ids.reverse()
        return ids

    def _relax_bytes(self, text: str, score: list, back: list[tuple[int, int]]) -> None:
        """The same pass with a step of one character into bytes at every position."""
        score[1:] = [_NEVER] * len(text)
        done = 0  # positions up to here have their best score

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if (value := score[done - 1] + _UNCOVERED) > score[done]:
                    score[done], back[done] = value, (done - 1, -1)

        for end, (length, i, gain) in self.automaton.iter(text):
            settle(end - length)  # matches come by their end: nothing changes there any more
            start, stop = end - length, end + 1
            value = score[start] + gain
            if value > score[stop]:
                score[stop] = value
                back[stop] = (start, i)
        settle(len(text))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``; none for the empty text."""
        if not text:
            return b""
        memo = self.memo
        return b"".join([memo[key] for key in _SEGMENT.findall(MARK + text.replace(" ", MARK))])

    def _solve(self, key: str) -> bytes:
        if key[-1] in self.marks and key[-2:-1].isalpha():
            return self.memo[key[:-1]] + self.memo[key[-1]]
        return array("i", self.admissible(key) if self.bpe else self.segment(key)).tobytes()

    def decode(self, ids) -> str:
        """The text of ``ids``: pieces' bytes, marks as spaces, the leading one off."""
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        return data[1:].decode("utf-8", "surrogatepass")


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _encoder(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            codes = [np.frombuffer(m.encode(t), dtype="<i4") for t in texts]
            offsets = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int32)
            restored = [m.decode(c.tolist()) == t.replace(MARK, " ") for c, t in zip(codes, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(c) for c in codes], pa.int64()),
                 pa.array([zlib.crc32(c.tobytes()) for c in codes], pa.int64()), pa.array(restored, pa.bool_()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes), pa.int32()))],
                names=["doc_id", "n_ids", "ids_crc32", "restored", "ids"])
    return run


def piece_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids of every whole text: ``doc_id, n_ids, ids_crc32, restored, ids``.

    ``restored`` tells whether decoding the ids gave the text back.  Null and
    empty texts have no ids; rows keep their number and may repeat; an empty
    table gives no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_encoder(model_path),
                           "doc_id long, n_ids long, ids_crc32 long, restored boolean, ids array<int>")


def _decoder(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return run


def piece_texts(coded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the inverse of :func:`piece_ids`."""
    return coded.select("doc_id", "ids").mapInArrow(_decoder(model_path), "doc_id long, text string")

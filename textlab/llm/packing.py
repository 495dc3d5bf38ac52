"""Vector bin packing of token sequences with the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence
is a bin with a limit on each.  A bin is filled by taking, again and again, the
example that fits and has the largest dot product of its vector with what is
left of the bin, both in shares of the limits.  When nothing fits whole, the
largest example is cut to what is left.  What is left over at the end of a
partition is closed at powers of two, so that no sequence needs padding.

Examples are packed inside the partition that holds them: no token crosses the
network, a lost executor repeats its own partitions only, and a partition keeps
``WINDOW`` examples and one open sequence in memory, whatever its size.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, small_batches, text_or_empty

SEQUENCE = 4096
SEGMENTS = 256
END_ID = 2
#: Examples that compete for the open bin.
WINDOW = 256
#: Word codes kept by a worker; the table starts anew when it is full.
MEMO = 600_000
TOKENIZER = "word_bpe_49k.json"
#: Plain texts: scripts where lower case and composition act letter by letter, and of the
#: control characters only those that all agree to be white space.
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-įı-ɏ]*")
#: The word pattern of the tokenizer file, for plain lower-case texts.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-zß-öø-ɏ0-9]+")


class Limits(NamedTuple):
    tokens: int = SEQUENCE
    segments: int = SEGMENTS
    loss: int = SEQUENCE


class Piece(NamedTuple):
    example: int
    start: int
    length: int
    sequence: int
    offset: int


def powers(n: int) -> list[int]:
    """``n`` as a falling sum of powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _loss_in(marks: np.ndarray | None, start: int, length: int) -> int:
    return length if marks is None else int(marks[start + length] - marks[start])


def pack(examples: Iterable[tuple[int, int, np.ndarray | None]], limits: Limits = Limits(),
         window: int = WINDOW) -> Iterator[Piece]:
    """Pieces of ``(key, n_tokens, loss_marks)`` examples, sequence by sequence.

    ``loss_marks`` is the running count of loss-bearing tokens (length n + 1),
    or None when every token bears loss.  Every token of every example is in
    exactly one piece; every sequence keeps all three limits; a sequence has
    ``limits.tokens`` tokens or a power of two.
    """
    source = iter(examples)
    waiting: list[tuple[int, int, int, np.ndarray | None]] = []  # key, start, tokens, marks
    sequence, more = 0, True
    caps = np.array(limits, dtype=float)

    def refill() -> None:
        nonlocal more
        while more and len(waiting) < window:
            item = next(source, None)
            if item is None:
                more = False
            elif item[1]:
                waiting.append((item[0], 0, item[1], item[2]))

    refill()
    while waiting:
        left = np.array(limits, dtype=np.int64)
        chosen: list[tuple[int, int, int]] = []
        vec = np.array([(n, 1, n if m is None else _loss_in(m, s, n)) for _, s, n, m in waiting], dtype=np.int64)
        while len(waiting) and left.min() > 0:
            score = (vec @ (left / caps / caps)) * (vec <= left).all(axis=1)
            at = int(score.argmax())
            key, start, n, marks = waiting[at]
            take = n
            if not score[at]:  # nothing fits whole: the largest is cut
                at = int(vec[:, 0].argmax())
                key, start, n, marks = waiting[at]
                take = min(n, int(left[0]))
                if marks is not None:  # as many tokens as the loss limit lets in
                    take = int(np.searchsorted(marks[start:start + take + 1], marks[start] + left[2], side="right")) - 1
                if not take:
                    break
            chosen.append((key, start, take))
            left -= (take, 1, _loss_in(marks, start, take))
            if take == n:
                waiting[at] = waiting[-1]
                vec[at] = vec[-1]
                waiting.pop()
                vec = vec[:-1]
            else:
                waiting[at] = (key, start + take, n - take, marks)
                vec[at] = (n - take, 1, _loss_in(marks, start + take, n - take))
        used = int(limits.tokens - left[0])
        # a full bin is one sequence; any other is cut into sequences of powers of two
        sizes = [used] if used == limits.tokens else powers(used)
        room, offset, size = sizes[0], 0, 0
        for key, start, n in chosen:
            while n:
                part = min(n, room)
                yield Piece(key, start, part, sequence, offset)
                start, n, room, offset = start + part, n - part, room - part, offset + part
                if not room:
                    sequence, offset, size = sequence + 1, 0, size + 1
                    room = sizes[size] if size < len(sizes) else 0
        refill()


class WordCoder:
    """Ids of whole texts, word by word: the tokenizer drops white space and never
    joins over it, so a text's ids are those of its words in order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        self.bpe = self.tok.model
        # the letter that stands for each byte, read off the tokenizer's own byte-level step
        step = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter: dict[int, str] = {}
        for code in (*range(0x21, 0x800), *range(0x800, 0x10000, 0x400), *range(0x10000, 0x110000, 0x8000)):
            if not 0xD800 <= code < 0xE000:
                self.letter.update(zip(chr(code).encode("utf-8"), step.pre_tokenize_str(chr(code))[0][0]))
        self.parts = Memo(self._part, MEMO)
        self.words = Memo(self._word, MEMO // 4)

    def _part(self, part: str) -> bytes:
        text = "".join([self.letter[b] for b in part.encode("utf-8")])
        return array("I", [t.id for t in self.bpe.tokenize(text)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.parts[p] for p in _WORD.findall(text.lower())])
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """32-bit ids of ``text`` in the machine's (little-endian) order, without special tokens."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            parts = self.parts
            return b"".join([parts[p] for p in _WORD.findall(text.lower())])
        words = self.words
        return b"".join([words[w] for w in text.encode("utf-8", "replace").split()])


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _encoded(encode, batch) -> Iterator[tuple[int | None, bytes, np.ndarray | None]]:
    """Id, token ids and loss marks of every row: of its text, or of its parts one after the other."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    ids = batch.column("doc_id").to_pylist()
    if "text" in batch.schema.names:
        for doc_id, text in zip(ids, batch.column("text").to_pylist()):
            yield doc_id, encode(text) + end, None
        return
    for doc_id, parts in zip(ids, batch.column("parts").to_pylist()):
        codes, bears = [], []
        for part in parts or ():
            found = encode((part or {}).get("text") or "")
            codes.append(found)
            bears.append(np.full(len(found) // 4, bool((part or {}).get("loss"))))
        # the end is learned where the last part is
        bears.append(np.full(1, bool(parts and parts[-1] and parts[-1].get("loss"))))
        yield doc_id, b"".join(codes) + end, np.concatenate(([0], np.cumsum(np.concatenate(bears))))


def _packer(path: str, limits: Limits):

    def run(batches):
        encode = coder(path).encode
        base = TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}  # example -> doc_id, its ids, pieces still to come in tokens

        def examples():
            number = 0
            for batch in small_batches(batches):
                for doc_id, codes, marks in _encoded(encode, batch):
                    held[number] = [doc_id, codes, len(codes) // 4, marks]
                    yield number, len(codes) // 4, marks
                    number += 1

        rows: list[tuple] = []
        for p in pack(examples(), limits):
            entry = held[p.example]
            doc_id, codes, _, marks = entry
            rows.append((doc_id, p.start, p.length, zlib.crc32(codes[4 * p.start:4 * (p.start + p.length)]),
                         len(codes) // 4, base + p.sequence, p.offset, _loss_in(marks, p.start, p.length)))
            entry[2] -= p.length
            if not entry[2]:
                del held[p.example]
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
    return run


_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=list(_NAMES))


def packed_pieces(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits()) -> DataFrame:
    """Pieces of every document's ids: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, loss_tokens``.

    A document is its ids followed by id 2, so an empty or null text is one
    token.  Rows are examples of their own: repeated rows are packed as often
    as they come.  All tokens of plain documents bear loss.  ``sequence_id`` is
    the partition number times 2^32 plus the sequence's number there.  An empty
    table gives no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, limits), ", ".join(f"{n} long" for n in _NAMES))


def packed_examples(examples: DataFrame, tokenizer_path: str, limits: Limits = Limits(), key: str = "doc_id",
                    parts: str = "parts") -> DataFrame:
    """The same for instruction data: ``parts`` is an array of ``(text, loss)``, prompts and responses
    in order, and only tokens of parts with ``loss`` count towards the limit on loss-bearing tokens.

    The ids of an example are those of its parts one after the other and id 2,
    which bears loss where the last part does.  Null or empty arrays, parts and
    texts have no ids; a null ``loss`` is false.
    """
    rows = examples.select(F.col(key).cast("long").alias("doc_id"), F.col(parts).alias("parts"))
    return rows.mapInArrow(_packer(tokenizer_path, limits), ", ".join(f"{n} long" for n in _NAMES))

"""Line dedup: a segment-partition edit join over the lines of all documents.

Every line that is not blank takes part, white space at its ends off.  Equal
lines are collapsed first.  How many edits two lines may differ by depends on
the length of the shorter one (``BANDS``): none for the shortest, where one
edit makes another word or number, then a share that stays about the same.

Two different lines within that limit are found by their segments: a line with
limit ``k`` is cut into ``k + 1`` segments, and ``k`` edits leave at least one of
them whole, so the other line has it as a substring.  Each line is indexed
under (length, segment number, segment) and looks up, for every length up to
its own, the few start positions where a match can still be within the limit.
All these keys come from one array of prefix sums over a batch of lines.

Every two lines that share a key are compared.  First each line meets one line
of each key that it shares: counts of characters are compared in the join, a
banded bit-parallel edit distance verifies the text.  Lines that are alone under
their keys go no further; the others are compared with each other.  Where a key
is shared by more than ``CROWD`` lines (a passage that many lines have), it is
split: characters are dealt into ``2 k + 1`` groups, and as an edit touches two
characters at most, ``k`` edits leave the counts of at least one group as they
were, so the key is joined with the counts of each group in turn; there counts
and edits are compared inside the join.  So all links between different lines are
found, inside a class too.  (Lines of one template that share a key and a group's
counts, but are not near, are still compared with each other.)

Lines that are equal or linked form a class; its first line (smallest doc_id,
then position) stays, every other occurrence is removed.

Equal lines are collapsed inside each batch of documents before they travel, so
a line that every document has costs one row a batch.  The text of a distinct
line that may have near ones is shuffled once, by its 64-bit id, and written to
the shared folder; verification reads the texts of candidates from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, small_batches, text_or_empty, written

#: Edits by the length of the shorter line: from so many characters on, so many edits.
BANDS = ((0, 0), (20, 1), (40, 2))
#: Keys shared by more lines than this are split by character counts.
CROWD = 32
#: Candidate ids up to this many are broadcast to the written lines (eight bytes each).
_BROADCAST = 1_000_000


def edits_of(length, bands=BANDS):
    """Allowed edits of lines of the given length or lengths."""
    starts, edits = (np.array(x) for x in zip(*bands))
    return edits[np.searchsorted(starts, length, side="right") - 1]


def segments(length, edits: int):
    """(start, length) of the ``edits + 1`` even segments of a line, or of many; the later ones are longer."""
    parts, short = edits + 1, length // (edits + 1)
    longer = length - short * parts
    return [(i * short + np.maximum(i - (parts - longer), 0), short + (i >= parts - longer)) for i in range(parts)]


def probes(gap: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment number, first shift, last shift) of the substrings that a line
    ``gap`` characters longer than the indexed one has to look up: a match may be
    moved by what the edits before and after it allow."""
    out = []
    for i in range(edits + 1):
        # i edits at most before segment i (else an earlier segment is whole), the rest after it
        low = max(-i, gap - (edits - i))
        high = min(i, gap + (edits - i))
        if low <= high:
            out.append((i, low, high))
    return out


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``most``.

    Bit-parallel columns over a band of ``2 most + 1`` diagonals: bit ``j`` of
    ``reach[e]`` tells whether diagonal ``j - most`` can be reached with ``e``
    edits at the current character of ``a``.
    """
    if abs(len(a) - len(b)) > most:
        return False
    lead = 0
    for x, y in zip(a, b):
        if x != y:
            break
        lead += 1
    a, b = a[lead:], b[lead:]
    trail = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        trail += 1
    if trail:
        a, b = a[:-trail], b[:-trail]
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True
    band = (1 << (2 * most + 1)) - 1
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << (j + most + 1)
    last = len(b) - len(a) + most  # the diagonal that must be reached at the end

    def closed(reach: list[int]) -> list[int]:
        # an insertion goes to the next diagonal up, at the same character of a
        for e in range(1, most + 1):
            reach[e] |= reach[e - 1] | (reach[e - 1] << 1 & band)
        return reach

    reach = closed([1 << most] + [0] * most)
    for i, x in enumerate(a):
        # bit j: b at diagonal j equals x  (b index i + j - most)
        equal = places.get(x, 0) >> (i + 1) & band
        new = [reach[0] & equal]
        for e in range(1, most + 1):
            new.append(reach[e] & equal | reach[e - 1] | reach[e - 1] >> 1)
        # diagonals beyond either end of b are not positions of b
        valid = 0
        for j in range(2 * most + 1):
            if 0 <= i + 1 + j - most <= len(b):
                valid |= 1 << j
        reach = [r & valid for r in closed([r & valid for r in new])]
        if not any(reach):
            return False
    return any(r >> last & 1 for r in reach)


def line_words(text: str) -> Iterator[tuple[int, str]]:
    """``(position, line)`` of the lines that are not blank, white space at the ends off."""
    for pos, raw in enumerate(text.split("\n")):
        line = raw.strip()
        if line:
            yield pos, line


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines in a row, and where each line begins (and the last one ends)."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate(([0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))))


def line_ids(lines: list[str]) -> np.ndarray:
    """Signed 64-bit ids of lines: 40 hash bits, then eight 3-bit counts of a line's
    characters by class.

    An edit changes at most two counts by one, so near lines have near counts:
    :func:`may_be_near` reads that off two ids.  Lines are told apart by their
    text, ids only bring pairs together.
    """
    codes, at = _codes(lines)
    row = np.repeat(np.arange(len(lines)), np.diff(at))
    counts = np.bincount(row * 8 + (codes & 7), minlength=8 * len(lines)).reshape(-1, 8) & 7
    hashes = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    return (hashes & ~np.uint64(0xFFFFFF) | (counts @ _PLACES).astype(np.uint64)).view(np.int64)


_PLACES = 1 << (3 * np.arange(8, dtype=np.int64))


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether the counts in two line ids differ by what ``edits`` edits can explain."""
    total = F.lit(0)
    for k in range(8):
        x, y = (F.shiftright(c, 3 * k).bitwiseAND(F.lit(7)) for c in (a, b))
        gap = (x - y + 8).bitwiseAND(F.lit(7))
        total = total + F.least(gap, F.lit(8) - gap)
    return total <= 2 * edits


def _distinct_lines(least: int):
    def run(batches):
        for batch in batches:
            lines = list({line for part in small_batches([batch]) for text in part.column("text").to_pylist()
                          for _, line in line_words(text) if len(line) >= least})
            for lo in range(0, len(lines), 20_000):
                part = lines[lo:lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(line_ids(part)), pa.array(part, pa.string())], names=["id", "line"])
    return run


def distinct_lines(docs: DataFrame, bands=BANDS) -> DataFrame:
    """``id, line`` of every different line that may have near ones, in the shared folder."""
    least = min((n for n, k in bands if k), default=0)
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(_distinct_lines(least), "id long, line string")
    return written(rows.distinct() if any(k for _, k in bands) else rows.limit(0), "lines")


def _occurrences(batches):
    for batch in small_batches(batches, 2048):
        out: list[tuple] = []
        for doc_id, doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc", "text"))):
            out += [(doc_id, doc, pos, hashlib.md5(line.encode("utf-8", "surrogatepass")).digest())
                    for pos, line in line_words(text)]
        for lo in range(0, len(out), 50_000):
            a, b, c, d = zip(*out[lo:lo + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.binary())],
                names=["doc_id", "doc", "pos", "key"])


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, pos, key`` of every line; ``doc`` tells texts of one doc_id apart."""
    text = text_or_empty()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), text.alias("text"))
            .mapInArrow(_occurrences, "doc_id long, doc long, pos int, key binary"))


class SubstringKeys:
    """64-bit keys of substrings of many lines at once.

    With prefix sums of ``c[j] * B^j`` (modulo 2^64, B odd) the sum over a
    substring times ``B^-start`` does not depend on where it lies.  Equal
    substrings have equal keys; unequal ones that do not are told apart later.
    """

    _B, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, lines: list[str]):
        codes, at = _codes(lines)
        self.start, self.length = at[:-1], np.diff(at)
        power = np.full(len(codes) + 1, self._B)
        back = np.full(len(codes) + 1, self._INVERSE)
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        terms = self._mixed(codes.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:-1]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def of(self, rows: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
        """Keys of the substrings ``at, size`` of ``rows`` as segment number ``segment`` of lines of ``length``."""
        begin = self.start[rows] + at
        raw = (self.sums[begin + size] - self.sums[begin]) * self.back[begin]
        tag = (length * 16 + segment).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return self._mixed(raw ^ tag).view(np.int64)


def segment_keys(lines: list[str], bands=BANDS, own_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, row, own`` of all substrings that the lines look up; ``own`` marks the
    segments under which a line itself is indexed (a line looks these up too)."""
    text = SubstringKeys(lines)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for edits in sorted({k for _, k in bands if k}):
        for gap in range(1 if own_only else edits + 1):
            length = text.length - gap
            rows = np.flatnonzero((length > 0) & (edits_of(np.maximum(length, 0), bands) == edits))
            if not len(rows):
                continue
            cuts = segments(length[rows], edits)
            for i, low, high in probes(gap, edits):
                at, size = cuts[i]
                for shift in range(0 if own_only else low, 1 if own_only else high + 1):
                    fits = (at + shift >= 0) & (at + shift + size <= text.length[rows])
                    r = rows[fits]
                    key = text.of(r, (at + shift)[fits], size[fits], length[r], i)
                    found.append((key, r, np.full(len(r), gap == 0 and shift == 0)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _segment_rows(bands, own_only: bool):
    def run(batches):
        for batch in small_batches(batches, 2048):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            key, row, own = segment_keys(batch.column("line").to_pylist(), bands, own_only)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), pa.array(own)], names=["segment", "id", "own"])
    return run


def group_sums(lines: list[str], groups: int) -> np.ndarray:
    """(line, group) sums of hashed characters; equal counts of a group's characters have equal sums."""
    codes, at = _codes(lines)
    mixed = SubstringKeys._mixed(codes.astype(np.uint64) + np.uint64(1))
    row, out = np.repeat(np.arange(len(lines)), np.diff(at)), np.zeros((len(lines), groups), np.uint64)
    group = (mixed >> np.uint64(33)) % np.uint64(groups)
    for g in range(groups):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(group == g, mixed, np.uint64(0)), dtype=np.uint64)))
        out[:, g] = sums[at[1:]] - sums[at[:-1]]
    return out.view(np.int64)


def odd_counts(lines: list[str]) -> np.ndarray:
    """64 bits a line, one for each class of hashed characters: whether the line has an odd number of them.

    An edit flips two bits at most.
    """
    codes, at = _codes(lines)
    kind = (SubstringKeys._mixed(codes.astype(np.uint64) + np.uint64(2)) >> np.uint64(40)).astype(np.int64) & 63
    row = np.repeat(np.arange(len(lines)), np.diff(at))
    odd = np.bincount(row * 64 + kind, minlength=64 * len(lines)).reshape(-1, 64) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()


def _sum_rows(groups: int):
    def run(batches):
        for batch in small_batches(batches, 2048):
            lines = batch.column("line").to_pylist()
            sums, ids = group_sums(lines, groups), batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, groups)), pa.array(np.tile(np.arange(groups, dtype=np.int32), len(sums))),
                 pa.array(sums.ravel()), pa.array(np.repeat(odd_counts(lines), groups)),
                 batch.column("line").take(pa.array(np.repeat(np.arange(len(lines)), groups)))], names=["id", "part", "sum", "odd", "line"])
    return run


def _verify(bands):
    def run(batches) -> Iterator[pa.RecordBatch]:
        names = ["id_a", "id_b", "a", "b"]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "line_a", "line_b")]
            pairs = [r for r in zip(*columns) if r[2] != r[3]
                     and edit_distance_within(r[2], r[3], int(edits_of(min(len(r[2]), len(r[3])), bands)))]
            digest = lambda k: pa.array([hashlib.md5(r[k].encode("utf-8", "surrogatepass")).digest() for r in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in pairs], pa.int64()), pa.array([r[1] for r in pairs], pa.int64()),
                                              digest(2), digest(3)], names=names)
    return run


def _verified(pairs: DataFrame, lines: DataFrame, bands) -> DataFrame:
    """``id_a, id_b, a, b``: the pairs ``(a, b)`` of ids whose lines are different and within the limit, with the lines' digests."""
    pairs = durable(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    text = durable(_of_ids(lines, ids, 2 * pairs.count()))
    both = (pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
            .join(text.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b"))
    return both.select("a", "b", "line_a", "line_b").mapInArrow(_verify(bands), "id_a long, id_b long, a binary, b binary")


def _of_ids(lines: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows of ``lines`` with one of ``ids``, which are broadcast where ``most`` of them are few."""
    return lines.join(F.broadcast(ids) if most <= _BROADCAST else ids, "id")


def _pairs(rows: DataFrame, edits: int) -> DataFrame:
    """Pairs ``(a, b)`` of different ids that share a key, one of them indexed under it, and whose
    character counts are near enough; where the rows have their lines (crowded keys), whose
    lines are within the most edits of all bands."""
    split = "line" in rows.columns
    side = lambda k: [F.col("segment"), *[F.col(c).alias(f"{c}_{k}") for c in ("id", *(("odd", "line") if split else ()))]]
    near = (F.col("id_a") != F.col("id_b")) & may_be_near(F.col("id_a"), F.col("id_b"), edits)
    if split:
        near = (near & (F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2 * edits)
                & (F.levenshtein("line_a", "line_b", edits) >= 0))
    return (rows.where("own").select(*side("a")).join(rows.select(*side("b")), "segment").where(near)
            .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` of keys that several lines share, with ``crowded``: whether their key has more than ``CROWD`` rows."""
    keys = (rows.groupBy("segment").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("own").alias("some"),
                                        F.count(F.lit(1)).alias("n")).where("lo <> hi and some"))
    return durable(rows.join(keys.select("segment", (F.col("n") > CROWD).alias("crowded")), "segment"))


def _among(members: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Pairs of different lines that share a key, crowded keys split by character counts."""
    shared = _shared(members)
    crowded = shared.where("crowded").drop("crowded")
    size = crowded.count()
    if not size:
        return _pairs(shared, edits)
    sums = (_of_ids(lines, crowded.select("id").distinct(), size).select("id", "line")
            .mapInArrow(_sum_rows(2 * edits + 1), "id long, part int, sum long, odd long, line string"))
    finer = crowded.join(sums, "id").select(F.xxhash64("segment", "part", "sum").alias("segment"), "own", "id", "odd", "line")
    return _pairs(shared.where("not crowded"), edits).unionByName(_pairs(_shared(finer), edits))


def near_lines(lines: DataFrame, bands=BANDS) -> DataFrame:
    """Every link ``(a, b)`` within the limit between the keys of different lines, verified.

    ``lines``: distinct ``id, line`` in the shared folder.
    """
    edits = max(k for _, k in bands)
    kind = "segment long, id long, own boolean"
    stored = lines.mapInArrow(_segment_rows(bands, True), kind)
    wanted = lines.mapInArrow(_segment_rows(bands, False), kind)
    # one row a key, however many lines share it: the rows that look up need no sort
    pivots = stored.groupBy("segment").agg(F.min("id").alias("pivot")).hint("shuffle_hash")
    # lines that share a key with another one; most share none
    members = durable(wanted.join(pivots, "segment").where(F.col("id") != F.col("pivot")))
    stars = members.where(may_be_near(F.col("id"), F.col("pivot"), edits)).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    found = stars.unionByName(_among(members.drop("pivot"), lines, edits)).distinct()
    return _verified(found, lines, bands).select("a", "b").distinct()


def repeated_lines(docs: DataFrame, bands=BANDS) -> DataFrame:
    """Occurrences in classes of two or more: ``doc_id, doc, pos, first_doc_id, kept, links``.

    ``kept`` marks the first occurrence of the class, ``links`` counts the
    links of the line to different lines.
    """
    links = durable(near_lines(distinct_lines(docs, bands), bands))
    degree = (links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key")))
              .groupBy("key").agg(F.count(F.lit(1)).alias("links")))
    near = (components(links, "a", "b").select(F.col("node").alias("key"), F.col("root").alias("class"))
            .join(degree, "key"))
    # counted by digest: the lines' texts are not shuffled a second time
    often = occurrences(docs).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    known = durable(often.join(near, "key", "full_outer").select(
        "key", F.coalesce("class", "key").alias("class"), F.coalesce("links", F.lit(0)).alias("links")))
    # of all occurrences only those of repeated lines go further
    found = durable(occurrences(docs).join(known, "key").drop("key"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "pos")
    first = durable(found.groupBy("class").agg(F.min(place).alias("first")))
    return found.join(first, "class").select(
        "doc_id", "doc", "pos", F.col("first.doc_id").alias("first_doc_id"),
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.doc") == F.col("doc"))
         & (F.col("first.pos") == F.col("pos"))).alias("kept"), "links")


def line_report(docs: DataFrame, bands=BANDS) -> DataFrame:
    """Per document: ``doc_id, class_id, n_links, n_removed, removed``.

    ``removed``: the line numbers (from 0) that go, in order; ``n_links``: all
    links of its lines to different lines; ``class_id``: the smallest doc_id that
    holds a line equal or near to one of its own, itself included.  Null and
    empty texts lose nothing; rows that repeat an id with its text are one
    document and each gets its result; an empty table gives no rows.
    """
    found = (repeated_lines(docs, bands).distinct().groupBy("doc_id", "doc").agg(
        F.min("first_doc_id").alias("low"), F.sum("links").alias("n_links"),
        F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("pos")))).alias("removed")))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("doc"))
    none = F.array().cast("array<int>")
    same = found.withColumnRenamed("doc_id", "d").withColumnRenamed("doc", "h")
    return (every.join(same, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc") == F.col("h")), "left")
            .select("doc_id", F.least("doc_id", "low").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.size(F.coalesce("removed", none)).cast("long").alias("n_removed"),
                    F.coalesce("removed", none).alias("removed")))


def _without(text_at: int):
    def run(batches):
        for batch in small_batches(batches):
            out, stays = [], []
            for text, removed in zip(batch.column(text_at).to_pylist(), batch.column("__removed").to_pylist()):
                if removed:
                    gone = set(removed)
                    left = [x for i, x in enumerate(text.split("\n")) if i not in gone]
                    text = "\n".join(left)
                    stays.append(any(x.strip() for x in left))
                else:
                    stays.append(True)
                out.append(text)
            columns = [*batch.columns[:-1], pa.array(stays, pa.bool_())]
            columns[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__stays"])
    return run


def without_repeated_lines(docs: DataFrame, bands=BANDS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, all other columns as they were.

    A document of which nothing is left goes; one that had no such line stays as it is,
    a null or empty text too.
    """
    gone = (repeated_lines(docs, bands).where("not kept").select("doc_id", "doc", "pos").distinct()
            .groupBy(F.col("doc_id").alias("__d"), F.col("doc").alias("__h"))
            .agg(F.collect_list("pos").alias("__removed")))
    keyed = docs.withColumn("__key", F.xxhash64(text_or_empty()))
    joined = keyed.join(gone, keyed["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__h")),
                        "left").select(*docs.columns, "__removed")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return (joined.mapInArrow(_without(docs.columns.index("text")), f"{kinds}, __stays boolean")
            .where("__stays").select(*docs.columns))

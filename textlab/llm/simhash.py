"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into ``BLOCKS`` blocks.  Two fingerprints that differ in
at most ``MAX_BITS`` bits agree in at least ``BLOCKS - MAX_BITS`` blocks, so
they share one of the keys made of that many blocks (20 keys of about 32 bits
for 6 blocks and 3 bits).  Equal fingerprints are collapsed before any join.

Inside a key no set of all pairs is made.  First every member is compared with
the smallest member of its key (one grouped minimum, one join); what that
links is contracted to components.  Only keys that still hold more than one
component are joined with themselves, and only across components: every link
between different components is found, links inside one add nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, small_batches, text_or_empty

SHINGLE = 3
MAX_BITS = 3
BLOCKS = 6
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text`` (0 without words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, _CHUNK):
        part = words[lo:lo + _CHUNK + shingle - 1]
        hashes = np.fromiter((digest(join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)))),
                             dtype="<u8", count=min(_CHUNK, n - lo))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    out = np.packbits(ones * 2 > n, bitorder="little").view("<u8")
    return int(out[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in small_batches(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()),
                              dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])
    return run


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and the fingerprint ``fp`` (bits of a signed long) per row."""
    rows = docs.select(*keep, text_or_empty().alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_fingerprints(shingle), f"{kinds}, fp long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Signed 64-bit masks; fingerprints within ``max_bits`` agree under one."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links ``(a, b)`` whose components are those of the full distance graph.

    ``fps``: distinct fingerprints ``fp``, durable.
    """
    masks = block_masks(blocks, max_bits)
    keys = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
        for i, m in enumerate(masks)])).alias("k")).select("fp", "k.part", "k.bits")
    shared = (keys.groupBy("part", "bits").agg(F.min("fp").alias("pivot"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    members = durable(keys.join(shared, ["part", "bits"]))
    stars = (members.where((F.col("fp") != F.col("pivot")) & near(F.col("fp"), F.col("pivot"), max_bits))
             .select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct())
    stars = durable(stars)
    group = components(stars, "a", "b")
    labelled = durable(members.join(group.withColumnRenamed("node", "fp"), "fp", "left")
                       .select("part", "bits", "fp", F.coalesce("root", "fp").alias("root")))
    mixed = (labelled.groupBy("part", "bits").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("part", "bits"))
    left = labelled.join(mixed, ["part", "bits"])
    right = labelled.select("part", "bits", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    across = (left.join(right, ["part", "bits"])
              .where((F.col("root") < F.col("root2")) & near(F.col("fp"), F.col("fp2"), max_bits))
              .select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct())
    return stars.unionByName(across)


def near_groups(rows: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint of ``rows``; root names its group."""
    distinct = durable(rows.select("fp").distinct())
    found = components(fingerprint_links(distinct, max_bits, blocks), "a", "b")
    return (distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits.  Null texts count as empty; texts without
    words have fingerprint 0 and link like any other; rows with a null doc_id
    are linked but never name a component unless it has no other id.
    """
    rows = durable(fingerprints(docs, "doc_id", shingle=shingle))
    per_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    group = durable(near_groups(rows, max_bits, blocks).join(per_fp, "fp"))
    lowest = group.groupBy("root").agg(F.min("low").alias("component_id"))
    return (rows.join(group.join(lowest, "root").select("fp", "component_id"), "fp")
            .select("doc_id", "fp", "component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id (null last).

    Rows that repeat a doc_id are told apart by their text, and rows that repeat
    both are one document, of which one row stays.
    """
    text = F.xxhash64(text_or_empty())
    rows = durable(fingerprints(docs.select(F.col("doc_id").alias("id"), text.alias("doc"), "text"),
                                "id", "doc", shingle=shingle))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc")
    keys = rows.join(near_groups(rows, max_bits), "fp").select("root", "id", "doc")
    best = keys.groupBy("root").agg(F.min(first).alias("best"))
    judged = (keys.groupBy("root", "id", "doc").agg(F.count(F.lit(1)).alias("n")).join(best, "root")
              .select(F.col("id").alias("__id"), F.col("doc").alias("__doc"), "n",
                      (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.doc") == F.col("doc"))).alias("stays")))
    marked = docs.withColumn("__key", text)
    same = marked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__doc"))
    judged = durable(judged.where("not stays or n > 1"))
    out = marked.join(judged, same, "left_anti")
    again = marked.join(judged.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return out.unionByName(again).select(*docs.columns)

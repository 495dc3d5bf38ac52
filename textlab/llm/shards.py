"""Balanced label propagation: linked documents move to one another's shard.

Documents are linked through hubs (here: equal texts), so a group with
millions of members costs one row a member, not one a pair.  All rows start in
a shard by hash.  In a round, each hub counts its members by shard (combined
before the shuffle), each linked document adds up the counts of its hubs and
asks for the shard with the most neighbours, in every other round for the best
one that still has room.  Requests are granted as far as the target has room or
as many documents leave it: along exchanges between two shards, rings of shards
and chains that end at a shard with room.  A document that stays put keeps its
label.  Rounds end when neither kind brings more equal texts together.
Quotas count linked documents only: unlinked ones cut no edge wherever
they go, so they fill the shards up to the exact quota at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, numbered, text_or_empty

SHARDS = 8
#: Steps of the request histogram that is read by the driver: SHARDS x SHARDS x STEPS rows at most.
STEPS = 256
_FINE = 1_000_000


def quotas(n: int, shards: int) -> list[int]:
    """Rows of every shard when counts are at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def _best(shards: int, open_to: list[bool]):
    """The shard a document asks for: most neighbours, ties by a hash that linked
    documents share; one that is not open counts only for those already in it."""
    votes = [F.col(f"v{s}") for s in range(shards)]
    choices = [F.when(F.lit(open_to[s]) | (F.col("shard") == s),
                      F.struct(votes[s].alias("v"), F.xxhash64("link", F.lit(s)).alias("tie"),
                               F.lit(s).alias("s"))) for s in range(shards)]
    return F.greatest(*choices)["s"]


def _route(left: dict[tuple[int, int], int], start: int, room: list[int]) -> list[int]:
    """The shortest way along requests from ``start`` to a shard with room or back to itself, empty if none."""
    ways, seen = [[start]], {start}
    for way in ways:
        for t in range(len(room)):
            if left.get((way[-1], t), 0) > 0:
                if t == start or room[t] > 0:
                    return [*way, t]
                if t not in seen:
                    seen.add(t)
                    ways.append([*way, t])
    return []


def flows(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Granted requests by (from, to): no shard gains more than its room, every step of a route moves as many."""
    left, room = dict(asked), list(free)
    while True:
        routes = [r for s in range(len(free)) if (r := _route(left, s, room))]
        if not routes:
            return {pair: n - left[pair] for pair, n in asked.items()}
        route = min(routes, key=len)
        pairs = list(zip(route, route[1:]))
        n = min(left[p] for p in pairs)
        if route[0] != route[-1]:
            n = min(n, room[route[-1]])
            room[route[-1]] -= n
            room[route[0]] += n
        for p in pairs:
            left[p] -= n


def _grants(rows, free: list[int]) -> tuple[dict[tuple[int, int], tuple[int, float]], int]:
    """Per (from, to): the first step not granted in full and the share of it granted."""
    asked: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        asked.setdefault((r["shard"], r["want"]), {})[r["step"]] = r["n"]
    granted = flows({pair: sum(steps.values()) for pair, steps in asked.items()}, free)
    cuts = {}
    for pair, steps in asked.items():
        room, cut, share = granted[pair], STEPS, 0.0
        for step in sorted(steps):
            if steps[step] > room:
                cut, share = step, room / steps[step]
                break
            room -= steps[step]
        cuts[pair] = (cut, share)
    return cuts, sum(granted.values())


def propagate(links: DataFrame, state: DataFrame, quota: list[int], max_rounds: int | None = None) -> DataFrame:
    """Rounds of moves over ``links`` (row, hub) from ``state`` (row, shard) until two in a row gain nothing."""
    shards = len(quota)
    best, best_state, idle, moved, turn = -1, state, 0, True, 0
    while idle < 2 and (max_rounds is None or turn < max_rounds):
        if moved:
            held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
            free = [max(0, quota[s] - held.get(s, 0)) for s in range(shards)]
            # durable, so that the join on hub has an exchange on either side and a hot hub can be split
            hubs = durable(links.join(state, "row").groupBy("hub")
                           .agg(*[F.sum((F.col("shard") == s).cast("long")).alias(f"v{s}") for s in range(shards)]))
            together = [F.sum(F.col(f"v{s}").cast("decimal(19,0)") * F.col(f"v{s}")) for s in range(shards)]
            value = sum(n or 0 for n in hubs.agg(*together).first())
            if value > best:
                best, best_state, idle = value, state, 0
            else:
                idle += 1
                if idle == 2:
                    break
            votes = (links.join(hubs, "hub").groupBy("row")
                     .agg(F.min(F.xxhash64("hub")).alias("link"), *[F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)]))
        open_to = [turn % 2 == 0 or n > 0 for n in free]
        step = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(STEPS)).cast("int")
        wants = durable(votes.join(state, "row").withColumn("want", _best(shards, open_to))
                        .select("row", "shard", "want", step.alias("step")))
        asked = (wants.where("want <> shard").groupBy("shard", "want", "step")
                 .agg(F.count(F.lit(1)).alias("n")).collect())
        cuts, granted = _grants(asked, free)
        moved = granted > 0
        if moved:
            dice = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(_FINE)) / F.lit(float(_FINE))
            yes = F.lit(False)
            for (source, target), (cut, share) in cuts.items():
                yes = yes | ((F.col("shard") == source) & (F.col("want") == target)
                             & ((F.col("step") < cut) | ((F.col("step") == cut) & (dice < share))))
            state = durable(wants.select("row", F.when(yes, F.col("want")).otherwise(F.col("shard")).alias("shard")))
        else:
            idle += 1
        turn += 1
    return best_state


def balanced_shards(docs: DataFrame, shards: int = SHARDS, max_rounds: int | None = None) -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, shard, slot``.

    Counts of any two shards differ by one at most; slots run from 0 without
    gaps.  Rows with equal texts are linked (null reads as empty); a group
    larger than a shard fills several.  Repeated rows are rows of their own.
    An empty table gives no rows.
    """
    text = text_or_empty()
    rows = durable(docs.select("doc_id", text.alias("text")).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("hub"), F.monotonically_increasing_id().alias("row")))
    quota = quotas(rows.count(), shards)
    many = durable(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub"))
    links = durable(rows.select("row", "hub").join(many, "hub"))
    start = links.select("row", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).distinct()
    state = propagate(links, durable(start), quota, max_rounds)
    placed = durable(rows.drop("hub").join(state, "row", "left")
                     .withColumn("place", F.coalesce("shard", F.lit(shards))).drop("shard"))
    held = {r["place"]: r["n"] for r in placed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = numbered(placed, "place", ["row"])
    # rows beyond a quota join the unlinked ones in the pool that fills the shards up
    over, at = F.col("rank"), held.get(shards, 0)
    fill_from, total, shard, slot = [], 0, None, None
    for s in range(shards):
        kept = min(held.get(s, 0), quota[s])
        over = F.when((F.col("place") == s) & (F.col("rank") >= quota[s]), F.col("rank") - quota[s] + at).otherwise(over)
        at += held.get(s, 0) - kept
        fill_from.append((total, kept))
        total += quota[s] - kept
    stays = F.lit(False)
    for s in range(shards):
        stays = stays | ((F.col("place") == s) & (F.col("rank") < quota[s]))
    shard, slot = F.lit(0), F.col("pool")
    for s, (first, kept) in enumerate(fill_from):
        shard = F.when(F.col("pool") >= first, F.lit(s)).otherwise(shard)
        slot = F.when(F.col("pool") >= first, F.col("pool") - first + kept).otherwise(slot)
    return (ranked.withColumn("pool", over).select(
        "doc_id", "size", "text_crc32", F.when(stays, F.col("place")).otherwise(shard).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot")))

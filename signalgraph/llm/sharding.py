"""Shards of even row counts that keep linked documents together.

Balanced label propagation (Ugander and Backstrom, 2013). Links come as membership
in hubs: a hub joins all its members (equal texts, a site, or one hub for each edge).
Linked documents start dealt out evenly. In every round a join with the counts of its
hubs tells each which shard holds most of its neighbours; wishes are counted by
(from, to, priority), a matrix of bounded size, and the driver grants as many of the
most useful as the quotas allow, in chains and rings of moves that leave sizes as they
are. Documents without neighbours have no wish; they fill the room that is left in the
end, with the few that a grant of whole priorities left above a quota, so counts are
at most one apart.

A hub is never gathered: only its counts by shard are, summed on the map side. The
join of members with these counts is an equi-join that adaptive execution splits for
a large hub. Each round is a settled table.

The query's links are equal texts. Null and empty texts have size 1, checksum 0 and
are equal. Null ``doc_id`` come first within a shard; repeated rows are placed each.
An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K

GAINS, SLICES = 20, 64  # priorities: binary magnitude of the gain, then a slice by hash


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    rounds: int = 12


def indexed(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``df`` settled in a global order with each row's place in it, from 0."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = C.settle(rows, "indexed").withColumn("_part", F.shiftright("_at", 33))
    starts = C.with_offsets(kept.groupBy("_part").count(), "_part", "count", "_start")
    return kept.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def circulation(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wishes (from, to) can be granted so that no shard takes in more
    than it gives away and has room for. Shortest chains of moves first: into a shard
    with room, then swaps, then longer rings, until none is left."""
    left = {edge: n for edge, n in wishes.items() if n}
    spare = list(room)
    flow = dict.fromkeys(wishes, 0)
    shards = range(len(room))

    def ring() -> list[int] | None:
        """Shards in the order of a shortest chain that ends with room or where it began."""
        best = None
        for begin in shards:
            came, queue = {begin: None}, [begin]
            while queue:
                at = queue.pop(0)
                path, k = [at], came[at]
                while k is not None:
                    path.append(k)
                    k = came[k]
                if best and len(path) >= len(best):
                    break
                if len(path) > 1 and spare[at] > 0:
                    best = path[::-1]
                    break
                if left.get((at, begin)) and (not best or len(path) + 1 < len(best)):
                    best = [*path[::-1], begin]
                    break
                for to in shards:
                    if to not in came and left.get((at, to)):
                        came[to] = at
                        queue.append(to)
        return best

    while path := ring():
        steps = list(zip(path, path[1:]))
        n = min(left[e] for e in steps)
        if path[0] != path[-1]:
            n = min(n, spare[path[-1]])
            spare[path[-1]] -= n
            spare[path[0]] += n
        for e in steps:
            flow[e] += n
            left[e] -= n
    return flow


def granted(wishes: dict[tuple[int, int, int], int], load: list[int], quota: list[int]) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Priority below which each (from, to) may move, and the loads that follow. Whole
    priorities are granted, so a shard may end a little above its quota."""
    total: dict[tuple[int, int], int] = {}
    by_edge: dict[tuple[int, int], list] = {}
    for (a, b, prio), n in wishes.items():
        total[a, b] = total.get((a, b), 0) + n
        by_edge.setdefault((a, b), []).append((prio, n))
    flow = circulation(total, [max(q - x, 0) for q, x in zip(quota, load)])
    limit, now = {}, list(load)
    for (a, b), entries in by_edge.items():
        limit[a, b], moved = 0, 0
        for prio, n in sorted(entries):
            if moved + n > flow[a, b] + n // 2:
                break
            moved += n
            limit[a, b] = prio + 1
        now[a] -= moved
        now[b] += moved
    return limit, now


def propagate(members: DataFrame, start: DataFrame, quota: list[int], load: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """``node, shard`` after at most ``rounds``, and the loads, which may be a little above
    quotas. ``members``: node, hub; ``start``: node, shard."""
    shards = len(quota)
    spark = members.sparkSession
    state, idle = start, 0
    for turn in range(rounds):
        placed = members.join(state, "node")
        # written first: a join of two plain tables is one that adaptive execution can split at a hot hub
        counts = C.settle(
            placed.groupBy("hub").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"c{s}") for s in range(shards)]), "hub_counts"
        )
        votes = placed.join(counts, "hub").groupBy("node").agg(
            F.first("shard").alias("shard"), F.min("hub").alias("anchor"), *[F.sum(f"c{s}").alias(f"c{s}") for s in range(shards)]
        )
        # every other round asks only for shards with room, so that a large hub goes on to the next one
        may = [turn % 2 == 0 or load[s] < quota[s] for s in range(shards)]
        options = [
            F.when(
                F.lit(may[s]) | (F.col("shard") == s),
                F.struct(F.col(f"c{s}").alias("n"), F.pmod(F.col("anchor") + s, F.lit(shards)).alias("tie"), F.lit(s).alias("to")),
            )
            for s in range(shards)
        ]
        best = F.array_max(F.array(*options))
        own = sum((F.when(F.col("shard") == s, F.col(f"c{s}")).otherwise(0) for s in range(shards)), F.lit(0))
        wished = votes.select("node", "shard", best.alias("best"), own.alias("own")).withColumn("to", F.col("best.to"))
        gain = F.least(F.lit(GAINS - 1), F.floor(F.log2(F.col("best.n") - F.col("own") + 1)).cast("int"))
        prio = (GAINS - 1 - gain) * SLICES + F.pmod(F.xxhash64("node"), F.lit(SLICES)).cast("int")
        wished = C.settle(wished.select("node", "shard", "to", prio.alias("prio")), "wishes")
        C.discard(counts)
        found = wished.filter("`to` != shard").groupBy("shard", "to", "prio").count().collect()  # at most shards² · 1280 rows
        wishes = {(r["shard"], r["to"], r["prio"]): r["count"] for r in found}
        limit, load = granted(wishes, load, quota)
        if not any(n for (a, b, prio), n in wishes.items() if prio < limit[a, b]):
            C.discard(wished)
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        grants = spark.createDataFrame([(a, b, n) for (a, b), n in limit.items()], "shard int, `to` int, below int")
        moved = wished.join(F.broadcast(grants), ["shard", "to"], "left")  # at most shards² rows
        after = C.settle(moved.select("node", F.when(F.col("prio") < F.col("below"), F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
        C.discard(wished, state)
        state = after
    return state, load


def shard_documents(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    rows = C.settle(
        K.texts_of(docs).select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hub")
        ),
        "shard_rows",
    )
    shared = C.settle(rows.groupBy("hub").count().filter("count > 1").select("hub", F.lit(0).alias("lone")), "shared_hubs")
    marked = rows.join(shared, "hub", "left").withColumn("lone", F.coalesce("lone", F.lit(1)))
    placed = C.settle(indexed(marked, ["lone", "hub", "doc_id"], "node"), "shard_nodes")
    total, linked = placed.agg(F.count(F.lit(1)), F.count(F.when(F.col("lone") == 0, 1))).first()
    quota, load = quotas(total, p.shards), quotas(linked, p.shards)
    members = placed.filter("lone = 0").select("node", "hub")
    start = members.select("node", F.pmod("node", F.lit(p.shards)).cast("int").alias("shard"))
    state, load = propagate(members, start, quota, load, p.rounds) if linked else (start, load)
    # what stands above a quota loses its place, hub by hub, and fills room like the rest
    ranked = indexed(members.join(state, "node"), ["shard", "hub", "node"], "rank")
    here = ranked.withColumn("rank", F.col("rank") - _starts(load)[F.col("shard")]).filter(F.col("rank") < F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1))
    settled = C.settle(placed.join(here.select("node", "shard"), "node", "left"), "shard_places")
    taken = dict(settled.filter("shard is not null").groupBy("shard").count().collect())
    homeless = indexed(settled.filter("shard is null").drop("shard"), ["hub", "node"], "rank")
    room, ends = 0, []
    for s in range(p.shards):
        room += quota[s] - taken.get(s, 0)
        ends.append(room)
    fill = sum((F.when(F.col("rank") >= end, 1).otherwise(0) for end in ends), F.lit(0)).cast("int")
    rows = ["doc_id", "size", "text_crc32", "shard"]
    where = settled.filter("shard is not null").select(*rows).union(homeless.withColumn("shard", fill).select(*rows))
    final = indexed(where, ["shard", "doc_id", "text_crc32"], "slot")
    return final.withColumn("slot", F.col("slot") - _starts(quota)[F.col("shard")])


def _starts(sizes: list[int]) -> Column:
    """Map from a shard to the rows of the shards before it."""
    return F.create_map(*[F.lit(x) for s in range(len(sizes)) for x in (s, sum(sizes[:s]))])


def digest(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_documents(docs, p).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

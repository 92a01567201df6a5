"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys (a row's id, size and checksum) hash to cells of a ring; every shard owns ``vnodes`` points on it, and a cell belongs to the next point
clockwise.  A shard holds no more than its quota; the keys beyond it continue clockwise to the next shard with
room.  With quotas that add up to the number of rows (``slack=0``) shard counts differ by one at most, which is
the law ``rows``; a positive slack leaves more keys at home and moves fewer when a shard joins.

Only the number of rows of each cell reaches the driver (``cells`` numbers at most); what comes back to the rows
is one table of ranges, at most ``cells + 4 * n_shards * vnodes`` of them, which bounds the broadcast.  A row finds its
range by its rank within its cell.  Equal rows are counted before they are shuffled and spread again after, and rows of one
id with different texts have different cells, so neither a repeated id nor repeated rows make a hot task.

Defined cases: null text has 8 bytes and checksum 0; null ids are ids like others; equal rows get different slots; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS, VNODES = 1 << 14, 40
#: Equal rows are spread again in chunks of this many.
CHUNK = 1 << 16


def cell_of(*keys: Column, cells: int = CELLS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(cells)).cast("int")


def quotas(n: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [-(-int(n * (1 + slack) * 1_000_000) // (shards * 1_000_000))] * shards


def plan_ring(counts: dict[int, int], points: list[tuple[int, int]], shards: int, slack: float, cells: int = CELLS) -> list[dict]:
    """Ranges (cell, lo, hi, shard, base): ranks lo..hi-1 of the cell go to the shard, the first to slot ``base``.

    Two turns round the ring: in the first, each cell's keys and whatever was carried there before them ask for
    room at the cell's own shard; in the second only what is still carried does.
    """
    room, used = quotas(sum(counts.values()), shards, slack), [0] * shards
    points = sorted(points)
    owners, k = [], 0
    for cell in range(cells):
        while k < len(points) and points[k][0] < cell:
            k += 1
        owners.append(points[k % len(points)][1])
    out: list[dict] = []
    carried: list[list[int]] = []

    def settle(queue: list[list[int]], shard: int) -> list[list[int]]:
        for i, piece in enumerate(queue):
            cell, lo, hi = piece
            take = min(hi - lo, room[shard])
            if not take:
                return queue[i:]
            out.append({"cell": cell, "lo": lo, "hi": lo + take, "shard": shard, "base": used[shard]})
            room[shard] -= take
            used[shard] += take
            if take < hi - lo:
                return [[cell, lo + take, hi], *queue[i + 1 :]]
        return []

    for turn in range(2):
        for cell in range(cells):
            own = [[cell, 0, counts[cell]]] if not turn and counts.get(cell) else []
            if own or carried:
                carried = settle(own + carried, owners[cell])
        if not carried:
            break
    return out


def ring_points(df: DataFrame, shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    rows = df.sparkSession.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.col("id").alias("v"))
    return [(r["cell"], r["shard"]) for r in rows.select("shard", cell_of("shard", "v", F.lit("point"), cells=cells).alias("cell")).collect()]


def assign_shards(docs: DataFrame, *, n_shards: int = 24, vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")).withColumn("cell", cell_of("doc_id", "size", "text_crc32", cells=cells))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one number for each cell
    ranges = plan_ring(counts, ring_points(docs, n_shards, vnodes, cells), n_shards, slack, cells)
    table = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ranges)), "array<struct<cell:int,lo:long,hi:long,shard:int,base:long>>")).alias("r")).select("r.*")
    same = rows.groupBy("cell", "doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    ranked = same.withColumn("upto", F.sum("times").over(W.partitionBy("cell").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)))
    first, last = F.greatest(F.col("upto") - F.col("times"), F.col("lo")), F.least("upto", "hi")
    met = ranked.join(F.broadcast(table), "cell").where((F.col("upto") - F.col("times") < F.col("hi")) & (F.col("upto") > F.col("lo")))
    met = met.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + first - F.col("lo")).alias("from"), (last - first).alias("n"))
    chunks = met.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    slots = chunks.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("i"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows" if slack <= 0 else "bounded").alias("law"), "shard", (F.col("from") + F.col("i")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VNODES points of a ring of RING positions; a row belongs to the first point at or after the
hash of its key. Loads are bounded by row count: shard capacities add up to the number of rows and differ by one
at most, so every shard ends exactly full. Rows that find their shard full continue clockwise to the next point
whose shard has room, and all others stay where plain consistent hashing puts them.

Per-row work is native and needs one shuffle of five narrow columns. The walk along the ring is done on counts of
cells: an arc, or where it holds more than CELL rows, as with a very frequent key, parts of it. The driver gets n_shards * VNODES
counts and one more for every CELL rows; no task sorts more than about CELL rows of an arc.

Defined cases: a null text has size 8 and checksum 0; a null key hashes like any other value; repeated rows and
ties are placed one by one, by row number; a very long text counts whole; an empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

RING = 1 << 16
VNODES = 256
CELL = 200_000


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, by position; a taken position moves its node to the next free one."""
    if n_shards * vnodes > RING // 2:
        raise ValueError("too many virtual nodes for the ring")
    taken: dict[int, int] = {}
    for s in range(n_shards):
        for v in range(vnodes):
            p = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % RING
            while p in taken:
                p = (p + 1) % RING
            taken[p] = s
    return sorted(taken.items())


def arcs_by_position(nodes: list[tuple[int, int]]) -> list[int]:
    """For every ring position, the index of the virtual node that a key there meets first."""
    out, k = [], 0
    for p in range(RING):
        while k < len(nodes) and nodes[k][0] < p:
            k += 1
        out.append(k % len(nodes))
    return out


def walk(counts: list[int], owners: list[int], n_shards: int) -> list[list[tuple[int, int, int, int]]]:
    """For every arc its pieces (first rank, end rank, shard, slot of the first), given the rows of each arc."""
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]

    def put(arc: int, done: int, shard: int) -> int:
        take = min(counts[arc] - done, room[shard] - used[shard])
        if take > 0:
            pieces[arc].append((done, done + take, shard, used[shard]))
            used[shard] += take
            done += take
        return done

    placed = [put(a, 0, owners[a]) for a in range(len(counts))]
    for a, done in enumerate(placed):
        step = 1
        while done < counts[a]:
            done = put(a, done, owners[(a + step) % len(owners)])
            step += 1
    return pieces


def assign(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", vnodes: int = VNODES) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    nodes = ring(n_shards, vnodes)
    owners = [s for _, s in nodes]
    content = F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(F.col(key))
    met = spark.createDataFrame(pa.table({"position": pa.array(range(RING), pa.int32()), "arc": pa.array(arcs_by_position(nodes), pa.int32())}))
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("crc"),
        hashed.alias("h"),
        F.pmod(hashed, F.lit(RING)).cast("int").alias("position"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(narrow.join(F.broadcast(met), "position").drop("position"), "ring-rows")  # RING rows are sent, whatever the table's size
    counts = [0] * len(nodes)
    for a, n in rows.groupBy("arc").count().collect():
        counts[a] = n
    parts = [max(1, -(-n // CELL)) for n in counts]
    split = spark.createDataFrame(pa.table({"arc": pa.array(range(len(nodes)), pa.int32()), "parts": pa.array(parts, pa.int32())}))
    rows = rows.join(F.broadcast(split), "arc").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    cells = [(a, 0, 0) for a, n in enumerate(parts) if n == 1 and counts[a]]
    if max(parts) > 1:
        at: dict[int, int] = {}
        for a, p, n in sorted(map(tuple, rows.join(F.broadcast(split.filter("parts > 1").select("arc")), "arc", "left_semi").groupBy("arc", "part").count().collect())):
            cells.append((a, p, at.get(a, 0)))
            at[a] = at.get(a, 0) + n
    pieces = walk(counts, owners, n_shards)
    before = spark.createDataFrame(pa.table({"arc": pa.array([c[0] for c in cells], pa.int32()), "part": pa.array([c[1] for c in cells], pa.int32()), "before": pa.array([c[2] for c in cells], pa.int64())}))
    piece = pa.struct([(n, pa.int64()) for n in ("first", "end", "shard", "slot")])
    by_arc = pa.table({"arc": pa.array(range(len(nodes)), pa.int32()), "pieces": pa.array([[dict(zip(("first", "end", "shard", "slot"), p, strict=True)) for p in own] for own in pieces], pa.list_(piece))})
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("arc", "part").orderBy("h", "key", "crc", "size", "row")).cast("long") - 1)
    placed = ranked.join(F.broadcast(before), ["arc", "part"]).join(F.broadcast(spark.createDataFrame(by_arc)), "arc").withColumn("rank", F.col("before") + F.col("r"))
    own = F.filter("pieces", lambda x: (x["first"] <= F.col("rank")) & (x["end"] > F.col("rank")))[0]
    return placed.select("key", "size", "crc", "rank", own.alias("p")).select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("p.shard").cast("int").alias("shard"),
        (F.col("p.slot") + F.col("rank") - F.col("p.first")).alias("slot"),
    )

"""Centroids, links between them, spherical k-means, majority votes.

Links by pivots. Every unit vector belongs to the cell of its nearest pivot. A row x and a row y of another cell q are at least
(angle(x, q) - angle(x, own pivot)) / 2 apart, as y is nearer to q than to x's pivot, and at least angle(x, q) less the cell's radius. So x meets
only cells that could hold a row within its angle, and there only rows whose angle to the pivot differs by no more than that.
The angle is that of the least similarity, or for nearest rows without one that of the n-th nearest in x's own cell.

Near cells are packed in blocks of TILE_ROWS rows or TILE_BYTES bytes, large cells in several, so neither a cell nor a group of copies is one task. A block is
copied once for every block that asks for one of its cells: of evenly spread vectors, where nothing can be skipped, rows / TILE_ROWS times. They pass by
the asking block one by one, which gives the n best of each row (more only where rounding is open), never all the pairs it compares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vector as V
from tessel.functions.python import trimmed
from tessel.scratch import written


def centroids(rows: DataFrame, keys: list[str], vector: str, decimals: int | None = 6) -> DataFrame:
    """Unit mean vector of each group, and its number of vectors. Components are summed per position on the map side."""
    parts = rows.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    mean = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("_v"), F.max("_n").alias("chunk_n"))
    unit = V.l2_normalize("_v")
    return mean.select(*keys, "chunk_n", (unit if decimals is None else F.transform(unit, lambda x: F.round(x, decimals))).alias("centroid"))


def similar(sim: Column, least: int) -> Column:
    return sim * 100 + 1e-7 >= least


def nearest_centroids(c: DataFrame, key: str, vector: str, n: int, decimals: int = 6, least: int | None = None) -> DataFrame:
    """a, b, sim: for each centroid the n nearest others, best first, ties by key.

    Centroids are few next to rows; still both sides are dealt in tiles, so no task holds all pairs.
    """
    tiles = 16
    tile = F.pmod(F.xxhash64(key), F.lit(tiles))
    left = c.select(F.col(key).alias("a"), F.col(vector).alias("va"), tile.alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = c.select(F.col(key).alias("b"), F.col(vector).alias("vb"), tile.alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pairs = left.join(right, ["x", "y"]).filter(F.col("a") != F.col("b")).select("a", "b", F.round(V.dot("va", "vb"), decimals).alias("sim"))
    best = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("_rn") <= n).drop("_rn")
    return best if least is None else best.filter(similar(F.col("sim"), least))


PIVOTS, PIVOT_SAMPLE, TILE_ROWS, TILE_BYTES, CHUNK, SLACK = 256, 4096, 4096, 1 << 21, 128, 1e-6
#: A product of matrices and a sum from left to right of the same numbers differ by less.
UNSURE = 1e-12
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def pivots(c: DataFrame, key: str, vector: str, most: int = PIVOTS) -> np.ndarray:
    """Up to `most` rows far from each other, of a sample of PIVOT_SAMPLE rows by the hash of their key: about the square root of the rows."""
    n = c.count()
    some = c.orderBy(F.xxhash64(key), key).limit(PIVOT_SAMPLE).select(F.col(vector).cast("array<double>").alias("v")).collect()
    points = np.array([r.v for r in some])
    if not len(points):
        return np.zeros((0, 0))
    k = max(1, min(most, len(points), math.isqrt(n)))
    out, far = [points[0]], 1 - points @ points[0]
    while len(out) < k and far.max() > 1e-9:
        out.append(points[int(np.argmax(far))])
        far = np.minimum(far, 1 - points @ out[-1])
    return np.array(out)


def _angles(v: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivot.T, -1.0, 1.0))


def celled(c: DataFrame, key: str, vector: str, pivot: np.ndarray) -> DataFrame:
    """key, v (bytes), cell, angle to its pivot, place among the rows of the cell that its task has seen."""
    kind = dict(c.dtypes)[key]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(pivot), np.int64)
        for b in batches:
            if b.num_rows:
                v = np.array(b.column(1).to_pylist(), float)
                at = _angles(v, pivot)
                cell = at.argmin(axis=1)
                order = np.argsort(cell, kind="stable")
                place = np.empty(len(cell), np.int64)
                place[order] = np.arange(len(cell)) - np.searchsorted(cell[order], cell[order]) + seen[cell[order]]
                seen += np.bincount(cell, minlength=len(pivot))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(at[np.arange(len(at)), cell]), pa.array(place)], names=["key", "v", "cell", "angle", "place"])

    return c.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(rows, f"key {kind}, v binary, cell int, angle double, place long")


def _groups(sizes: dict[int, int], pivot: np.ndarray, most: int) -> tuple[dict[int, int], dict[int, int]]:
    """The group of each cell, near cells together up to `most` rows, and the number of tiles of each group: one, but for groups of a cell that is larger."""
    group: dict[int, int] = {}
    tiles: dict[int, int] = {}
    left = set(sizes)
    while left:
        by, held = pivot @ pivot[min(left)], 0
        for c in sorted(left, key=lambda c: (-by[c], c)):
            if held and held + sizes[c] > most:
                break
            group[c], held = len(tiles), held + sizes[c]
            left.remove(c)
        tiles[len(tiles)] = -(-held // most)
    return group, tiles


def _looked_up(found: dict[int, int], at: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(found.items()) for x in kv]), at)


def _block(group: Column) -> Column:
    """The first block of a group; its tiles follow."""
    return F.shiftleft(group.cast("long"), 32)


def _packed(cells: DataFrame, group: dict[int, int], tiles: dict[int, int], most: int) -> DataFrame:
    """block, part, and of its rows in the order of cell and angle: keys, v, cell, angle, reach. A block too full has several parts."""
    kind = dict(cells.dtypes)["key"]

    def made(held: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        numbers = [np.ascontiguousarray(t[x].to_numpy(), d).tobytes() for x, d in (("cell", "<i4"), ("angle", "<f8"), ("reach", "<f8"))]
        keys = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t["key"].chunk(0))
        return pa.RecordBatch.from_arrays([pa.array([t["block"][0].as_py()], pa.int64()), pa.array([part], pa.int32()), keys, pa.array([b"".join(t["v"].to_pylist())], pa.binary()), *[pa.array([x], pa.binary()) for x in numbers]], names=["block", "part", "keys", "v", "cell", "angle", "reach"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, part, last = 0, 0, None
        for b in batches:
            block = b.column("block").to_numpy()
            ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            at = 0
            for end in ends:
                while at < end:
                    if held and (n == most or block[at] != last):
                        yield made(held, part)
                        held, n, part = [], 0, part + 1 if block[at] == last else 0
                    take = min(end - at, most - n)
                    held.append(b.slice(at, take))
                    last, n, at = block[at], n + take, at + take
        if held:
            yield made(held, part)

    of = _looked_up(group, F.col("cell"))
    block = _block(of) + F.pmod(F.col("place"), _looked_up(tiles, of))
    dealt = cells.select(block.alias("block"), "key", "v", "cell", "angle", "reach").repartition("block").sortWithinPartitions("block", "cell", "angle")
    return dealt.mapInArrow(trimmed(rows), f"block long, part int, keys array<{kind}>, v binary, cell binary, angle binary, reach binary")


def _numbers(b: pa.RecordBatch, i: int, name: str, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b.column(name)[i].as_buffer(), kind)


def _asking(blocks: DataFrame, pivot: np.ndarray, radius: dict[int, float], group: dict[int, int], tiles: dict[int, int], own: bool) -> DataFrame:
    """block, to: every other block (and itself) with a cell that could hold a row within reach of one of its own; with `own` only the cells of its rows count."""
    held = np.array([radius.get(i, -1.0) for i in range(len(pivot))])
    of = np.array([group.get(i, 0) for i in range(len(pivot))])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell, angle, reach = _numbers(b, i, "cell", "<i4"), _numbers(b, i, "angle"), _numbers(b, i, "reach")
                if own:
                    groups = np.unique(of[cell])
                else:
                    at = _angles(_numbers(b, i, "v").reshape(len(cell), -1), pivot)
                    asks = (np.maximum((at - angle[:, None]) / 2, at - held) <= reach[:, None] + SLACK) & (held >= 0)
                    groups = np.unique(of[asks.any(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array([b.column("block")[i].as_py()] * len(groups), pa.int64()), pa.array(groups.astype(np.int32))], names=["block", "group"])

    asked = blocks.select("block", "v", "cell", "angle", "reach").mapInArrow(trimmed(rows), "block long, group int")
    first = _block(F.col("group"))
    return asked.distinct().select("block", F.explode(F.sequence(first, first + _looked_up(tiles, F.col("group")) - 1)).alias("to"))


def _ranked(sim: np.ndarray, rank: np.ndarray, decimals: int) -> np.ndarray:
    """Numbers in the order of the rounded sim, the smaller rank first among equals."""
    return np.floor(sim * 10.0**decimals + 0.5).astype(np.int64) * (int(rank.max(initial=0)) + 1) - rank


def _best(sim: np.ndarray, hit: np.ndarray, rank: np.ndarray, n: int, decimals: int) -> None:
    """Leaves of each row's hits those that may be among its n best. Where a sim is so near a half that its last digits decide, both ways are open."""
    many = np.flatnonzero(hit.sum(axis=1) > n)
    if len(many):
        s = np.where(hit[many], sim[many], -2.0)
        low, high = (_ranked(s + e, rank, decimals) for e in (-UNSURE, UNSURE))
        hit[many] &= high >= np.partition(low, -n, axis=1)[:, -n][:, None]


class _Nearest:
    """Of the rows of a block, the pairs that may be among the n best of each so far (place of a, b, sim), and the sim that more of them must have."""

    def __init__(self, rows: int, n: int, decimals: int) -> None:
        self.n, self.decimals = n, decimals
        self.i, self.b, self.sim = np.zeros(0, np.int64), None, np.zeros(0)
        self.floor = np.full(rows, -np.inf)

    def add(self, i: np.ndarray, b: pa.Array, sim: np.ndarray) -> None:
        self.i, self.sim = np.concatenate([self.i, i]), np.concatenate([self.sim, sim])
        self.b = b if self.b is None else pa.concat_arrays([self.b, b])
        rank = np.empty(len(self.i), np.int64)
        rank[pc.array_sort_indices(self.b).to_numpy()] = np.arange(len(rank))
        low, high = (_ranked(self.sim + e, rank, self.decimals) for e in (-UNSURE, UNSURE))
        order = np.lexsort((-low, self.i))
        row = self.i[order]
        nth = order[np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.n - 1)]
        least = np.full(len(self.floor), np.iinfo(np.int64).min)
        least[self.i[nth]] = low[nth]
        self.floor[self.i[nth]] = self.sim[nth] - 1.001 * 10.0**-self.decimals - 1e-9
        kept = np.flatnonzero(high >= least[self.i])
        self.i, self.b, self.sim = self.i[kept], self.b.take(pa.array(kept)), self.sim[kept]


def _few_blocks(df: DataFrame) -> None:
    """Python gets few blocks at a time from now on, unless the session sets the size of batches: two columns of 64 MB each, twice while they grow, are held beside the heap in every task."""
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, "16m")


def _met(blocks: DataFrame, asking: DataFrame, pivot: np.ndarray, radius: dict[int, float], n: int, decimals: int) -> DataFrame:
    """a, b, sim (not rounded) of the pairs that may be among the n best of a; and rows without a, with the number of pairs compared.

    The blocks that a block asks for pass by it one by one. Products of matrices find the pairs, CHUNK rows at a time against the bands of angle within
    their reach; the sim of what is left is summed from left to right, as vector.dot does.
    """
    held = np.array([radius.get(i, -1.0) for i in range(len(pivot))])
    kind = dict(blocks.dtypes)["keys"][len("array<") : -1]

    def passed(b: pa.RecordBatch, i: int, best: _Nearest) -> int:
        ka, kb = b.column("ka")[i].values, b.column("kb")[i].values
        near, reach, cell, angle = _numbers(b, i, "near"), _numbers(b, i, "reach"), _numbers(b, i, "cell", "<i4"), _numbers(b, i, "angle")
        va, vb = _numbers(b, i, "va").reshape(len(ka), -1), _numbers(b, i, "vb").reshape(len(kb), -1)
        names = pa.concat_arrays([ka, kb]).dictionary_encode().indices.to_numpy()
        na, nb = names[: len(ka)], names[len(ka) :]
        both = np.isin(na, nb)
        rank = np.empty(len(kb), np.int64)
        rank[pc.array_sort_indices(kb).to_numpy()] = np.arange(len(kb))
        cells, starts = np.unique(cell, return_index=True)
        ends = [*starts[1:].tolist(), len(cell)]
        at = _angles(va, pivot[cells])
        asks = np.maximum((at - near[:, None]) / 2, at - held[cells]) <= reach[:, None] + SLACK
        first, last = at - reach[:, None] - SLACK, at + reach[:, None] + SLACK
        least = np.maximum(np.cos(np.minimum(reach, math.pi)) - 1e-9, best.floor)
        compared = 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for top in range(0, len(ka), CHUNK):
            r = slice(top, top + CHUNK)
            parts = []
            for k in np.flatnonzero(asks[r].any(axis=0)).tolist():
                m, band = asks[r, k], angle[starts[k] : ends[k]]
                parts.append(np.arange(np.searchsorted(band, first[r, k][m].min()), np.searchsorted(band, last[r, k][m].max(), "right")) + starts[k])
            y = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            if not len(y):
                continue
            sim = va[r] @ vb[y].T
            compared += sim.size
            hit = sim >= least[r][:, None]
            if both[r].any():
                hit &= na[r][:, None] != nb[y]
            _best(sim, hit, rank[y], n, decimals)
            p, q = np.nonzero(hit)
            found.append((p + top, y[q]))
        p, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        for k in range(0, len(p), 100_000):
            x, z = p[k : k + 100_000], q[k : k + 100_000]
            total = np.zeros(len(x))
            for d in range(va.shape[1]):
                total += va[x, d] * vb[z, d]
            best.add(x, kb.take(pa.array(z)), total)
        return compared

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, compared = None, 0
        best: dict[int, tuple[_Nearest, pa.Array]] = {}  # of the parts of one block

        def given() -> Iterator[pa.RecordBatch]:
            for x, ka in best.values():
                if len(x.i):
                    yield pa.RecordBatch.from_arrays([ka.take(pa.array(x.i)), x.b, pa.array(x.sim), pa.nulls(len(x.i), pa.int64())], names=["a", "b", "sim", "compared"])

        for b in batches:
            for i in range(b.num_rows):
                if (at := b.column("block")[i].as_py()) != block:
                    yield from given()
                    block, best = at, {}
                part, ka = b.column("part")[i].as_py(), b.column("ka")[i].values
                x = best[part][0] if part in best else _Nearest(len(ka), n, decimals)
                compared += passed(b, i, x)
                best[part] = x, ka
        yield from given()
        if block is not None:
            none = pa.nulls(1, ka.type)
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.float64()), pa.array([compared], pa.int64())], names=["a", "b", "sim", "compared"])

    x = blocks.select("block", "part", F.col("keys").alias("ka"), F.col("v").alias("va"), F.col("angle").alias("near"), "reach")
    y = blocks.select(F.col("block").alias("to"), F.col("keys").alias("kb"), F.col("v").alias("vb"), "cell", "angle")
    # copies of blocks are many times what Spark expects of either side, so none is sent through the driver
    asked = asking.hint("merge").join(y, "to").drop("to")
    return asked.hint("merge").join(x, "block").mapInArrow(trimmed(rows), f"a {kind}, b {kind}, sim double, compared long")


def nearest_by_pivots(c: DataFrame, key: str, vector: str, n: int, decimals: int = 6, least: int | None = None, most: int = PIVOTS, told: Callable[[dict], None] | None = None) -> DataFrame:
    """a, b, sim: what nearest_centroids gives, comparing only rows whose cells are near. Vectors are unit vectors of one length; null ones and those with a component that is none take no part.

    With `least` all rows at least that similar are met; without it, rows first meet their own cell, and the n-th best there bounds how far they look.
    `told` gets how many pairs were compared, and of how many.
    """
    # a component without a number would leave its whole cell without a radius
    c = c.filter(F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    pivot = pivots(c, key, vector, most)
    if not len(pivot):
        return c.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("sim")).limit(0)
    _few_blocks(c)
    cells = written(celled(c, key, vector, pivot), "cells")
    facts = cells.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell, PIVOTS at most
    radius, sizes = {r.cell: r.radius for r in facts}, {r.cell: r.n for r in facts}
    full = max(1, min(TILE_ROWS, TILE_BYTES // (8 * pivot.shape[1])))
    group, tiles = _groups(sizes, pivot, full)

    def met(reached: DataFrame, digits: int, own: bool = False) -> DataFrame:
        blocks = _packed(reached, group, tiles, full)
        return _met(blocks, _asking(blocks, pivot, radius, group, tiles, own), pivot, radius, n, digits)

    pairs_of = lambda found, digits: found.filter(F.col("a").isNotNull()).select("a", "b", F.round("sim", digits).alias("sim"))
    first_of = lambda pairs: pairs.withColumn("_rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("_rn") <= n).drop("_rn")
    if least is not None:
        reach = F.lit(math.acos(max(-1.0, min(1.0, least / 100 - 10.0**-decimals - 1e-6))))  # similar() is lenient by 1e-7, and sims are rounded
        reached = cells.withColumn("reach", reach)
    else:
        near = first_of(pairs_of(met(cells.withColumn("reach", F.lit(math.pi)), 12, own=True), 12)).groupBy("a").agg(F.min("sim").alias("s"), F.count("*").alias("n"))
        bound = F.when(F.col("n") >= n, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") - 10.0**-decimals - 1e-9)))).otherwise(math.pi)
        reached = written(cells.join(near.select(F.col("a").alias("key"), bound.alias("reach")), "key", "left").withColumn("reach", F.coalesce("reach", F.lit(math.pi))), "reaches")
    found = met(reached, decimals)
    if told is not None:
        found = written(found, "met")
        told({"compared": found.agg(F.sum("compared")).first()[0], "of": sum(sizes.values()) * (sum(sizes.values()) - 1)})
    best = first_of(pairs_of(found, decimals))
    return best if least is None else best.filter(similar(F.col("sim"), least))


SAMPLE, DIMS, MOST, ROUNDS, FEWEST = 400, 96, 7, 12, 8


def fit(points: np.ndarray) -> np.ndarray:
    """Centres of unit points: farthest-point start from the first, nearest by dot product, first of equals."""
    k = min(MOST, max(2, int(math.sqrt(len(points) / 2)) + 1))
    centre = [points[0]]
    far = 1 - points @ points[0]
    for _ in range(1, k):
        nxt = int(np.argmax(far))
        centre.append(points[nxt])
        far = np.minimum(far, 1 - points @ points[nxt])
    c, of = np.array(centre), None
    for turn in range(ROUNDS):
        new = np.argmax(points @ c.T, axis=1)
        if turn >= 1 and of is not None and (new == of).all():
            break
        of = new
        for j in range(k):
            m = points[of == j]
            if len(m) and (n := np.linalg.norm(m.mean(0))) > 0:
                c[j] = m.mean(0) / n
    return c


def kmeans(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and cluster of every row; centres are fitted on 400 rows, those of the smallest hashes of their keys, so the driver holds no more."""
    sample = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(V.truncated(vector, DIMS).alias("v")).collect()
    points = np.array([r.v for r in sample if r.v is not None])
    if len(points) < FEWEST:
        return rows.select(key, F.lit(0).alias("cluster"))
    best = F.lit(0)
    unit = V.truncated(vector, DIMS)
    score = F.array(*[F.struct(V.dot("_u", V.literal(c.tolist())).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(fit(points))])
    best = -F.array_max(score)["i"]
    return rows.select(key, unit.alias("_u")).select(key, best.alias("cluster"))


def majority(rows: DataFrame, source: str, cluster: str) -> DataFrame:
    """The most frequent cluster of each source, the lowest of equals."""
    counts = rows.groupBy(source, cluster).agg(F.count("*").alias("votes"))
    return counts.groupBy(source).agg(F.max(F.struct("votes", (-F.col(cluster)).alias("c"))).alias("b")).select(source, (-F.col("b.c")).alias(cluster), "b.votes")

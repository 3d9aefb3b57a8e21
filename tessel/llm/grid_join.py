"""Exact near-duplicate join of vectors in the order of an epsilon grid.

Two vectors link when their cosine is at least LEAST, that is when their unit vectors lie no further apart than eps = sqrt(2 - 2 LEAST).
Equal vectors are one class before anything is compared, so a vector that a third of all rows hold is one row from there on.

Order: unit vectors are turned to principal directions, fitted on a bounded sample of SAMPLE classes (any orthonormal directions
give the same links; the sample only decides how much can be skipped). The first DIMS coordinates and the length of what remains fall into cells of
edge eps. Classes are range-partitioned and sorted by cell, then by cells of an eighth of that, then by their hash, and the
sequence is cut into blocks of BLOCK rows with a bounding box, a middle and a radius each. Vectors of other lengths are sequences of their own.

Join: intervals of the sequence are joined recursively, from intervals of FAN ** k blocks down to blocks. A pair of intervals whose boxes are provably more
than eps apart is skipped with all it holds; the others meet again as pairs of their parts. A pair of blocks that middles and radii prove to be entirely within eps
is linked as a whole, without looking at its vectors. What is left is compared, TILE by TILE blocks in a task.

A tile compares blocks by matrix products: in single precision what is far from the limit, in double precision what is near it, and within
1e-9 of the limit by the cosine of the original vectors. It gives the number of links per class and enough links to connect what all its links connect, never
all pairs. Components of classes come from alternating stars.

Work: every row of a block moves once per tile that its block could link into. In evenly spread data of many dimensions nothing can be skipped and that
is rows / (TILE * BLOCK) times, and the comparisons are those of all pairs; what lies in clusters is compared within its surroundings only.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and are components of their own; vectors of
different lengths don't link; rows that repeat a vec_id are vectors of their own; a row without vec_id links like any other, and
without any other id in its component it is null; ties (cosine equal to the limit) link; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, ready, trimmed, written
from .ngram_join import connected

LEAST = 0.95
SAMPLE, NUMBERS = 8192, 4_000_000
DIMS = 8
BLOCK = 1024
FAN = 4
TOP = 8  # intervals with which the recursion starts
TILE = 8
NEAR = 1e-9
SLACK = 1e-6
PLACE = 20  # bits of a row's place in its block


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of original rows in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def kind_of(table: DataFrame, vector: str) -> str:
    """How vectors are kept as bytes: in single precision if that is what the table has."""
    return "<f4" if table.schema[vector].dataType.simpleString() == "array<float>" else "<f8"


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def vectors_of(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, cls, v): the vector's bytes and their hash; both null where it takes no part."""
    rows_in = ready(table).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"))
    e, kind = F.col("e"), kind_of(table, vector)
    valid = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [b.column(0), [None if x is None else (np.array(x, kind) + 0).astype(kind).tobytes() for x in b.column(1).to_pylist()]])

    packed = rows_in.select("id", F.when(valid, e).alias("e")).mapInArrow(trimmed(rows), "id long, v binary")
    return packed.select("id", F.sha2("v", 256).alias("cls"), "v")


def directions(classes: DataFrame, kind: str) -> tuple[int, np.ndarray]:
    """(length, DIMS orthonormal columns) of the most common length in a sample of SAMPLE classes or NUMBERS numbers: its principal directions."""
    longest = classes.agg(F.max(F.length("v"))).first()[0]
    if not longest:
        return 0, np.zeros((0, 0))
    some = classes.select("cls", "v").orderBy("cls").limit(max(1, min(SAMPLE, NUMBERS * int(kind[2]) // longest))).collect()
    by_size: dict[int, list[bytes]] = {}
    for r in some:
        by_size.setdefault(len(r.v), []).append(bytes(r.v))
    size = max(by_size, key=lambda n: (len(by_size[n]), n))
    u = unit(matrix(by_size[size], kind))
    _, _, turned = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)
    return u.shape[1], turned[:DIMS].T


def coordinates(m: np.ndarray, fitted: tuple[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates of unit rows and the length of what remains, DIMS + 1 in all."""
    size, turned = fitted
    lead = m @ turned if m.shape[1] == size else m[:, :DIMS]
    out = np.zeros((len(m), DIMS + 1))
    out[:, : lead.shape[1]] = lead
    out[:, DIMS] = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", lead, lead)))
    return out


def in_order(classes: DataFrame, fitted: tuple[int, np.ndarray], eps: float, kind: str) -> DataFrame:
    """Classes with their cells: size, coarse, fine."""
    schema = pa.schema([("cls", pa.string()), ("v", pa.binary()), ("n", pa.int64()), ("size", pa.int32()), ("coarse", pa.list_(pa.int32())), ("fine", pa.list_(pa.int32()))])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(v) // int(kind[2]) for v in b["v"].to_pylist()], np.int64)
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                at = coordinates(unit(matrix(part["v"].to_pylist(), kind)), fitted)
                cells = [np.floor(at / edge).astype(np.int32).tolist() for edge in (eps, eps / 8)]
                yield batch(schema, [part["cls"], part["v"], part["n"], [int(size)] * len(part), *cells])

    return classes.select("cls", "v", "n").mapInArrow(trimmed(rows), "cls string, v binary, n long, size int, coarse array<int>, fine array<int>")


def blocks(ordered: DataFrame, fitted: tuple[int, np.ndarray], size: int, kind: str) -> DataFrame:
    """Blocks of the sequence: part and place in it, length of vectors, rows, their classes and vectors, box (lo, hi), middle and radius."""
    names = "part int, at int, size int, rows int, links long, cls array<string>, v binary, weights array<long>, lo array<double>, hi array<double>, middle array<double>, radius double"
    schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("rows", pa.int32()), ("links", pa.int64()), ("cls", pa.list_(pa.string())), ("v", pa.binary()), ("weights", pa.list_(pa.int64())), *[(x, pa.list_(pa.float64())) for x in ("lo", "hi", "middle")], ("radius", pa.float64())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at = 0
        cls: list[str] = []
        v: list[bytes] = []
        n: list[int] = []

        def made() -> pa.RecordBatch:
            m = unit(matrix(v, kind))
            c = coordinates(m, fitted)
            middle = m.mean(axis=0)
            radius = float(np.sqrt(((m - middle) ** 2).sum(axis=1)).max())
            return batch(schema, [[part], [at], [m.shape[1]], [len(cls)], [sum(n)], [list(cls)], [b"".join(v)], [list(n)], [c.min(axis=0).tolist()], [c.max(axis=0).tolist()], [middle.tolist()], [radius]])

        for b in batches:
            for c, x, k in zip(b["cls"].to_pylist(), b["v"].to_pylist(), b["n"].to_pylist(), strict=True):
                if cls and (len(cls) == size or len(v[0]) != len(x)):
                    yield made()
                    at += 1
                    cls.clear(), v.clear(), n.clear()
                cls.append(c)
                v.append(x)
                n.append(k)
        if cls:
            yield made()

    keys = ["size", *[F.col("coarse")[i] for i in range(DIMS + 1)], *[F.col("fine")[i] for i in range(DIMS + 1)], "cls"]
    return ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("cls", "v", "n").mapInArrow(trimmed(rows), names)


def box_gap(a: str, b: str) -> Column:
    """The squared distance between two boxes."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}lo")[i] - F.col(f"{b}hi")[i], F.col(f"{b}lo")[i] - F.col(f"{a}hi")[i]) for i in range(DIMS + 1)]
    return reduce(lambda x, y: x + y, [g * g for g in gaps])


def side(nodes: DataFrame, x: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{x}{c}") for c in nodes.columns])


def joined_intervals(boxes: DataFrame, count: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks that are not provably apart, by recursion over intervals of the sequence."""

    def level(k: int) -> DataFrame:
        node = F.shiftright("seq", 2 * k)
        if k == 0:
            return boxes.select(F.col("seq").alias("node"), "size_lo", "size_hi", "lo", "hi")
        ends = [F.array(*[f(F.col(c)[i]) for i in range(DIMS + 1)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        return boxes.groupBy(node.alias("node")).agg(F.min("size_lo").alias("size_lo"), F.max("size_hi").alias("size_hi"), *ends)

    top = 0
    while -(-count // FAN**top) > TOP:
        top += 1
    close = (F.col("a_size_lo") <= F.col("b_size_hi")) & (F.col("b_size_lo") <= F.col("a_size_hi")) & (box_gap("a_", "b_") <= eps * eps + SLACK)
    up = level(top)
    # at most TOP intervals: their pairs are at most TOP * TOP rows
    pairs = side(up, "a_").join(F.broadcast(side(up, "b_")), (F.col("a_node") <= F.col("b_node")) & close).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    for k in range(top - 1, -1, -1):
        nodes = level(k)
        a, b = side(nodes, "a_"), side(nodes, "b_")
        met = pairs.join(a, F.shiftright("a_node", 2) == F.col("a")).join(b, F.shiftright("b_node", 2) == F.col("b"))
        pairs = written(met.filter((F.col("a_node") <= F.col("b_node")) & close).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "intervals")
    return pairs


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))


class Forest:
    """Which of the rows of a tile are connected."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def rows(self, at: np.ndarray, left: int, right: int) -> None:
        """Joins row left + i to row right + j wherever at[i, j]: each row to one, round by round, until none that link are apart."""
        x, y = np.arange(left, left + at.shape[0]), np.arange(right, right + at.shape[1])
        for i in np.flatnonzero(at.any(axis=1)).tolist():
            self.join(left + i, right + int(at[i].argmax()))
        for j in np.flatnonzero(at.any(axis=0)).tolist():
            self.join(left + int(at[:, j].argmax()), right + j)
        while True:
            rx, ry = (np.array([self.root(k) for k in side_.tolist()]) for side_ in (x, y))
            apart = at & (rx[:, None] != ry[None, :])
            if not apart.any():
                return
            for i in np.flatnonzero(apart.any(axis=1)).tolist():
                self.join(left + i, right + int(apart[i].argmax()))


def near(ua: np.ndarray, ub: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray | None:
    """Which rows of a and b link; None if none do."""
    rough = ua.astype(np.float32) @ ub.astype(np.float32).T
    found = rough >= least - 1e-4
    i, j = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    if not len(i):
        return None
    exact = ua[i] @ ub[j].T
    link = exact >= least + NEAR
    x, y = np.nonzero((exact >= least - NEAR) & ~link)
    if len(x):
        sure = cosine(a[i[x]], b[j[y]]) >= least
        link[x[sure], y[sure]] = True
    out = np.zeros(rough.shape, bool)
    out[np.ix_(i, j)] = link
    return out


def compared(needs: DataFrame, held: DataFrame, least: float, kind: str) -> DataFrame:
    """Partial results of tiles: (row, links) and connecting links (a, b) of rows."""
    schema = pa.schema([(x, pa.int64()) for x in ("row", "links", "a", "b")])
    stream = needs.join(held, "seq").repartition("tx", "ty").sortWithinPartitions("tx", "ty", "seq")

    def tile(found: list[dict]) -> Iterator[pa.RecordBatch]:
        place = {r["seq"]: k for k, r in enumerate(found)}
        base = np.cumsum([0, *(r["rows"] for r in found)])
        name = np.concatenate([(r["seq"] << PLACE) + np.arange(r["rows"]) for r in found])
        weight = np.array([w for r in found for w in r["weights"]], np.int64)
        m = [np.frombuffer(r["v"], kind).reshape(r["rows"], -1).astype(np.float64) for r in found]
        u = [unit(x) for x in m]
        links = np.zeros(len(name), np.int64)
        forest = Forest(len(name))
        for k, r in enumerate(found):
            for o in (place[x] for x in r["partners"]):
                at = near(u[k], u[o], m[k], m[o], least)
                if at is None:
                    continue
                i, j = int(base[k]), int(base[o])
                if o == k:
                    np.fill_diagonal(at, False)
                else:
                    links[j : j + len(u[o])] += at.T @ weight[i : i + len(u[k])]
                links[i : i + len(u[k])] += at @ weight[j : j + len(u[o])]
                forest.rows(at, i, j)
        hit = np.flatnonzero(links)
        for k in range(0, len(hit), 10_000):
            some = hit[k : k + 10_000]
            none = pa.nulls(len(some), pa.int64())
            yield batch(schema, [pa.array(name[some]), pa.array(links[some]), none, none])
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        for k in range(0, len(edges), 10_000):
            some = name[edges[k : k + 10_000]]
            none = pa.nulls(len(some), pa.int64())
            yield batch(schema, [none, none, pa.array(some[:, 0]), pa.array(some[:, 1])])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, waiting = None, []
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                if (r["tx"], r["ty"]) != where and waiting:
                    yield from tile(waiting)
                    waiting = []
                where = (r["tx"], r["ty"])
                waiting.append(r)
        if waiting:
            yield from tile(waiting)

    return stream.mapInArrow(trimmed(rows), "row long, links long, a long, b long")


def linked(cut: DataFrame, eps: float, least: float, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, links), connecting links (a, b), and (row, cls), from blocks; a row is named by its block's place in the sequence and its own in the block."""
    spark = cut.sparkSession
    offsets, total = [], 0
    for r in cut.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per task
        offsets.append((r.part, total))
        total += r.n
    firsts = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, first long"))
    held = cut.join(firsts, "part").withColumn("seq", F.col("first") + F.col("at"))
    boxes = written(held.select("seq", F.col("size").alias("size_lo"), F.col("size").alias("size_hi"), "lo", "hi", "middle", "radius", "links"), "boxes")
    pairs = joined_intervals(boxes.select("seq", "size_lo", "size_hi", "lo", "hi"), total, eps)
    ends = [boxes.select(F.col("seq").alias(x), F.col("middle").alias(f"{x}_middle"), F.col("radius").alias(f"{x}_radius"), F.col("links").alias(f"{x}_links"), F.col("size_lo").alias(f"{x}_size")) for x in "ab"]
    widest = F.when(F.col("a") == F.col("b"), 2 * F.col("a_radius")).otherwise(distance(F.col("a_middle"), F.col("b_middle")) + F.col("a_radius") + F.col("b_radius"))
    judged = written(pairs.join(ends[0], "a").join(ends[1], "b").filter("a_size = b_size").select("a", "b", "a_links", "b_links", (widest <= eps - SLACK).alias("whole")), "judged")

    tile = [F.floor(F.col(x) / TILE).alias(f"t{y}") for x, y in (("a", "x"), ("b", "y"))]
    open_ = judged.filter("NOT whole").select("a", "b", *tile)
    asks = open_.select("tx", "ty", F.col("a").alias("seq"), F.array("b").alias("partners"))
    answers = open_.select("tx", "ty", F.col("b").alias("seq"), F.array().cast("array<bigint>").alias("partners"))
    needs = asks.unionByName(answers).groupBy("tx", "ty", "seq").agg(F.flatten(F.collect_list("partners")).alias("partners"))  # TILE at most
    found = written(compared(needs, held.select("seq", "rows", "v", "weights"), least, kind), "tiles")

    row = F.shiftleft("seq", PLACE)
    names = written(held.select("seq", row.alias("head"), F.posexplode("cls").alias("i", "cls"), "weights").select("seq", "head", (F.col("head") + F.col("i")).alias("row"), "cls", F.element_at("weights", F.col("i") + 1).alias("weight")), "names")
    whole = judged.filter("whole")
    apart = whole.filter("a != b")
    met = whole.select(F.col("a").alias("seq"), F.col("b_links").alias("n"), (F.col("a") == F.col("b")).alias("own"))
    met = met.unionByName(apart.select(F.col("b").alias("seq"), F.col("a_links").alias("n"), F.lit(False).alias("own")))
    of_blocks = written(met.groupBy("seq").agg(F.sum("n").alias("n"), F.max("own").alias("own")).join(names, "seq"), "of-blocks")
    links = found.filter("row IS NOT NULL").select("row", "links").unionByName(of_blocks.select("row", (F.col("n") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("links")))
    heads = apart.select(F.shiftleft("a", PLACE).alias("a"), F.shiftleft("b", PLACE).alias("b"))
    edges = found.filter("a IS NOT NULL").select("a", "b").unionByName(of_blocks.select(F.col("row").alias("a"), F.col("head").alias("b"))).unionByName(heads)
    return links.groupBy("row").agg(F.sum("links").alias("links")), edges, names.select("row", "cls")


def groups(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    eps, kind = sqrt(2 - 2 * least), kind_of(table, vector)
    rows_in = written(vectors_of(table, key, vector), "vectors")
    classes = written(rows_in.filter("v IS NOT NULL").groupBy("cls").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("id")), "classes")
    fitted = directions(classes, kind)
    cut = written(blocks(in_order(classes, fitted, eps, kind), fitted, block, kind), "blocks")
    links, edges, names = linked(cut, eps, least, kind)
    roots = connected(edges)
    named = names.join(links, "row", "left").join(roots.select(F.col("node").alias("row"), "root"), "row", "left").select("cls", F.coalesce("root", "row").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = written(named.join(classes.select("cls", "n", "id"), "cls").select("cls", "root", "id", (F.col("links") + F.col("n") - 1).alias("links")), "named")
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    of = written(named.join(smallest, "root").select("cls", "links", "component"), "components")
    out = rows_in.select("id", "cls").join(of, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))

"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Index: centroids are fitted by spherical k-means on a bounded sample (SAMPLE ids by their hash, a row of each); every vector is normalised, turned by a fixed
random rotation, and put into the list of its nearest centroid. Short lists share a bin, long ones are split into bins
by a hash of id and row, so that a bin holds about BIN rows whatever the lists are like, and however often an id is repeated.

Search: a query probes the PROBED share of nearest lists, LEAST_PROBED at least. It goes once to every bin that holds one
of them, and there stands behind the bin's rows: a task holds one bin and streams the queries past it. More than
ASKED queries are dealt to several copies of the bins. Within a list the rotated
vectors lie in blocks of BLOCK columns. After each block, a hypothesis test compares every candidate's partial
squared distance, scaled up to all dimensions, with the distance of the k-th nearest id so far: a candidate is
abandoned where it could only be nearer by a deviation of more than CAREFUL standard errors. The k-th distance
starts from that of the sample's rows in the probed lists, so the first list is pruned as well. What survives is scored
exactly on original vectors. Queries that got fewer than k ids, though the table has more, go through all lists without tests.

The probed share is high because nearest neighbours in isotropic data lie in many lists: work grows as queries times
rows there. Recall against brute force is in the README; clustered vectors need a far lower share.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most
take no part, as query or candidate; rows that repeat an id are one candidate, its nearest; with fewer candidates
than k all are returned; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, ready, trimmed, written

SAMPLE = 8192
PER_LIST = 50
MOST_LISTS = 2048
BIN = 1024
ASKED = 20_000
LEAST_PROBED = 32
PROBED = 0.6
BLOCK = 16
CAREFUL = 2.4
ROUNDS = 8
SEED = 20240601


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means over unit vectors; an empty list keeps its centroid."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(ROUNDS):
        of = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def valid(v: Column) -> Column:
    """Whether a vector has only finite components, at least one of them not zero."""
    d = lambda x: x.cast("double")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(d(x)) | (F.abs(d(x)) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: d(x) != 0)


def exact(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of a query with rows, each row summed alike whatever its place."""
    return (x * query).sum(1) / (math.sqrt((query * query).sum()) * np.sqrt((x * x).sum(1)))


def kth(far: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The distance of the k-th nearest distinct id, infinite where there are fewer; rows that repeat an id count once, by their nearest."""
    m = min(k, len(far))
    while m >= k:
        near = np.argpartition(far, m - 1)[:m]
        near = near[np.argsort(far[near])]
        _, first = np.unique(ids[near], return_index=True)
        if len(first) >= k:
            return float(far[near[np.sort(first)[k - 1]]])
        if m == len(far):
            break
        m = min(2 * m, len(far))
    return math.inf


def scan(query: np.ndarray, alive: np.ndarray, blocks: list[np.ndarray], ids: np.ndarray, limit: float, k: int) -> np.ndarray:
    """Of the places alive those that may be among the k nearest distinct ids of a rotated unit query within squared distance `limit`."""
    dim = sum(b.shape[1] for b in blocks)
    far = np.zeros(len(alive))
    seen = 0
    for b in blocks:
        d = b[alive] - query[seen : seen + b.shape[1]]
        far += np.einsum("ij,ij->i", d, d)
        seen += b.shape[1]
        if seen < dim:
            stay = far * (dim / seen) <= limit * (1 + CAREFUL / math.sqrt(seen)) ** 2
            alive, far = alive[stay], far[stay]
            if not len(alive):
                return alive
    return alive[far <= min(limit, kth(far, ids[alive], k)) + 1e-5]


@dataclass
class Index:
    """What a search takes to the workers: a rotation, centroids, the sample's ids, rotated unit vectors and lists, bins (first bin, how many) by list."""

    dim: int
    turn: np.ndarray
    centre: np.ndarray
    own: np.ndarray
    picked: np.ndarray
    bins: np.ndarray

    def unit(self, raw: np.ndarray) -> np.ndarray:
        return (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ self.turn

    def vectors(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, self.dim)

    def probed(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Whether each query probes each list."""
        near = np.argsort(-(unit @ self.centre.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(unit), len(self.centre)), bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    def limits(self, unit: np.ndarray, ids: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """For each query a squared distance within which it finds k ids: the k-th of the sample's rows in the lists it probes."""
        if len(self.own) < k:
            return np.full(len(unit), 4.0)
        near = unit @ self.picked.T
        near[(ids[:, None] == self.own[None, :]) | ~probed[:, np.argmax(self.picked @ self.centre.T, axis=1)]] = -2
        least = np.partition(near, -k, axis=1)[:, -k]
        return np.where(least > -2, 2 - 2 * least, 4.0) + 1e-9


def in_bins(sizes: np.ndarray, rows: int) -> np.ndarray:
    """(first bin, how many) of each list: short lists fill a bin together, long ones are split."""
    out, bin_, held = np.zeros((len(sizes), 2), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            bin_, held = bin_ + 1, 0
        parts = max(1, -(-n // rows))
        out[i] = bin_, parts
        bin_, held = (bin_, held + n) if parts == 1 else (bin_ + parts, 0)
    return out


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, k: int = 5, probed: float = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, among all other rows."""
    spark = vectors.sparkSession
    asked = F.col(key) % 50 == 0 if is_query is None else is_query
    good = ready(vectors).filter(valid(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("q"))
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids")).orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, distinct = dims[0]
    good = good.filter(F.size("v") == dim)
    most = min(SAMPLE, max(256, 2**22 // dim))
    share = min(1.0, 1.5 * most / distinct)
    sample = good.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    turn = rotation(dim)
    picked = np.array(sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
    picked = (picked / np.linalg.norm(picked, axis=1, keepdims=True)) @ turn
    centre = centroids(picked, max(1, min(MOST_LISTS, total // PER_LIST, len(picked))))
    index = Index(dim, turn, centre, np.array(sample["id"].to_numpy()), picked, np.zeros((len(centre), 2), np.int64))
    kinds = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("q", pa.bool_())])

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f8")
                yield batch(kinds, [pa.array(np.argmax(index.unit(raw) @ centre.T, axis=1).astype(np.int32)), b.column(0), [r.tobytes() for r in raw], b.column(2)])

    rows = written(good.mapInArrow(trimmed(dealt), "list int, id long, v binary, q boolean"), "vector-lists")
    sizes = np.zeros(len(centre), np.int64)
    for r in rows.groupBy("list").count().collect():  # a row per list, MOST_LISTS at most
        sizes[r[0]] = r[1]
    index.bins = in_bins(sizes, BIN)
    asking = written(rows.filter("q").groupBy("id").agg(F.min("v").alias("v")), "vector-queries")
    n = len(centre)
    found = written(nearest(rows, asking, index, min(n, max(LEAST_PROBED, math.ceil(probed * n))), k, False), "vector-found")
    counts = found.groupBy(F.col("query_id").alias("id")).count().filter(F.col("count") >= min(k, distinct - 1))
    short = written(asking.join(counts, "id", "left_anti"), "vector-short")
    if distinct > 1 and not short.isEmpty():
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(nearest(rows, short, index, n, k, True))
    return found.select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, asking: DataFrame, index: Index, probes: int, k: int, whole: bool) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest in the lists it probes; with whole there is no limit at first."""
    copies = max(1, -(-asking.count() // ASKED))
    bins = index.bins
    schema = pa.schema([("bin", pa.int32()), ("copy", pa.int32()), ("asks", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("list", pa.int32()), ("limit", pa.float64())])
    ddl = "bin int, copy int, asks int, id long, v binary, list int, limit double"

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, part = b.column(0).to_numpy(), b.column(3).to_numpy()
            bin_ = (bins[lists, 0] + part % bins[lists, 1]).astype(np.int32)
            for c in range(copies):
                same = np.full(b.num_rows, c, np.int32)
                yield batch(schema, [pa.array(bin_), pa.array(same), pa.array(np.zeros_like(same)), b.column(1), b.column(2), b.column(0), [None] * b.num_rows])

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit, ids = index.unit(index.vectors(b.column(1))), b.column(0).to_numpy()
            probed = index.probed(unit, probes)
            limits = np.full(len(ids), 4.0) if whole else index.limits(unit, ids, probed, k)
            for i in range(len(ids)):
                to = np.unique(np.concatenate([np.arange(first, first + n) for first, n in bins[probed[i]]])).astype(np.int32)
                m = len(to)
                yield batch(schema, [pa.array(to), pa.array(np.full(m, b.column(2)[i].as_py(), np.int32)), pa.array(np.ones(m, np.int32)), pa.array(np.full(m, ids[i])), [b.column(1)[i].as_py()] * m, [None] * m, pa.array(np.full(m, limits[i]))])

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        at, kept, here = None, [], None
        for b in batches:
            place = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part, asks = b.slice(i, j - i), place[i, 2]
                if not asks:
                    if at != tuple(place[i, :2]):
                        at, kept, here = tuple(place[i, :2]), [], None
                    kept.append(part)
                elif at == tuple(place[i, :2]):
                    here = here or Bin(index, kept)
                    yield batch(out_schema, here.answers(part, probes, 4.0 if whole else None, k))

    inside = rows.select("list", "id", "v", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 30)).alias("part")).mapInArrow(trimmed(held), ddl)
    around = asking.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int").alias("copy")).mapInArrow(trimmed(asked), ddl)
    near = inside.unionByName(around).repartition("bin", "copy").sortWithinPartitions("bin", "copy", "asks", "id", "v").mapInArrow(trimmed(scanned), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k)


class Bin:
    """The rows of one bin, ready to be scanned."""

    def __init__(self, index: Index, parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts)
        self.index = index
        self.ids, self.list = rows["id"].to_numpy(), rows["list"].to_numpy()
        self.raw = index.vectors(rows["v"])
        unit = index.unit(self.raw)
        self.blocks = [np.ascontiguousarray(unit[:, i : i + BLOCK]) for i in range(0, index.dim, BLOCK)]

    def answers(self, asked: pa.RecordBatch, probes: int, limit: float | None, k: int) -> list[list]:
        """Columns query, id, score: of each query the k nearest distinct ids in the lists that it probes."""
        vectors, out = self.index.vectors(asked.column(4)), ([], [], [])
        units = self.index.unit(vectors)
        probed = self.index.probed(units, probes)
        for q, vector, unit, lists, own in zip(asked.column(3).to_pylist(), vectors, units, probed, asked.column(6).to_pylist(), strict=True):
            at = scan(unit, np.flatnonzero(lists[self.list] & (self.ids != q)), self.blocks, self.ids, own if limit is None else limit, k)
            if not len(at):
                continue
            score = exact(vector, self.raw[at])
            seen: set[int] = set()
            for i in np.lexsort((self.ids[at], -score)):
                if self.ids[at[i]] not in seen:
                    seen.add(self.ids[at[i]])
                    for column, value in zip(out, (q, int(self.ids[at[i]]), float(score[i])), strict=True):
                        column.append(value)
                if len(seen) == k:
                    break
        return list(out)

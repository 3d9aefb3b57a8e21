"""Source divergence audit: how the terms of each source of a language differ from those of the others and of the language.

Sort-based streaming. A task counts the terms of its documents per (lang, term, source): occurrences, and documents that
hold the term, as a document lies whole in one task. So a term that every document holds is a row per task and source,
not one per document, and the last sort key, the document, is folded away before rows move. Rows are repartitioned by (lang, term) and
sorted by (lang, term, source); a scan over runs of equal keys adds them up to document frequencies and counts, and lets
through the runs of terms in LEAST documents or more. They are written as a table, as totals need a first look at them.

The second scan streams the kept runs once more, dealt by (lang, bucket of the term) behind header rows that tell a bucket every source of the language with
its totals. Each run adds to the partial sums of its language's pairs, and gives term rows; both leave a task once per bucket: pairs
summed, terms cut to the TERMS first of a source, as only these can be among the first of all. Buckets grow with the kept runs alone, a bucket for
ROWS of them, so what leaves them is the same on however many partitions. Pairs of more than BLOCK sources are
dealt by blocks of the first one.

Arithmetic is exact: a share is divided in three steps of a thousand, so nothing passes 63 bits while a language has fewer than 9e15
terms in all; squares stay below 1e18 and their sums below (V + 1e9)^2.

Defined cases: null text, lang and source are empty strings; a group whose documents have no term takes part in pairs with count 0
everywhere; V = 0 gives pairs of value 0; a language of one source has no pairs; ties go by item in UTF-8 order; repeated rows are
documents of their own; very long texts are whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, ready, trimmed, written

LEAST = 3
TERMS = 200
SCALE = 1_000_000_000
HELD = 500_000  # counts in a task before it gives them away
CELLS = 1_000_000  # numbers of a block of runs by sources
BLOCK = 512
ROWS = 250_000  # kept runs of a bucket, on average
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def keys(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]


def occurrences(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Partial counts (lang, term, source, docs, n)."""
    held = ready(docs).select(*keys(lang, source), F.col(text).cast("binary").alias("t"))
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
    Counts = dict[tuple[str, str], tuple[Counter, Counter]]

    def given(groups: Counts) -> Iterator[pa.RecordBatch]:
        for (where, who), (docs_, n) in groups.items():
            for terms in _slices(list(n)):
                yield batch(schema, [[where] * len(terms), pa.array(terms, pa.binary()).cast(pa.string()), [who] * len(terms), [docs_[x] for x in terms], [n[x] for x in terms]])
        groups.clear()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: Counts = {}
        for b in batches:
            for key, t in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), strict=True):
                terms = terms_of(t.as_py() or b"")
                counts = groups.get(key)
                if counts is None:
                    counts = groups[key] = (Counter(), Counter())
                counts[1].update(terms)
                counts[0].update(set(terms))
            if sum(len(n) for _, n in groups.values()) > HELD:
                yield from given(groups)
        yield from given(groups)

    return held.mapInArrow(trimmed(rows), "lang string, term string, source string, docs long, n long")


def _slices(items: list, size: int = 10_000) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def starts(*columns: pa.Array) -> np.ndarray:
    """At which rows a run of equal keys begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def runs(partial: DataFrame, least: int) -> DataFrame:
    """Kept terms (lang, term, source, n) by a scan over partial counts sorted by (lang, term, source)."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
    out = pa.schema([schema.field(x) for x in ("lang", "term", "source", "n")])

    def added(t: pa.RecordBatch) -> pa.RecordBatch:
        at = starts(t["lang"], t["term"], t["source"])
        keys = [t[x].take(pa.array(at)) for x in ("lang", "term", "source")]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(np.add.reduceat(t[x].to_numpy(), at)) for x in ("docs", "n")]], schema=schema)

    def enough(t: pa.RecordBatch) -> pa.RecordBatch:
        at = starts(t["lang"], t["term"])
        df = np.add.reduceat(t["docs"].to_numpy(), at)
        keep = np.repeat(df >= least, np.diff(np.append(at, len(t))))
        return t.filter(pa.array(keep)).select(out.names)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None
        for b in batches:
            if not len(b):
                continue
            b = pa.RecordBatch.from_arrays([b[x].cast(schema.field(x).type) for x in schema.names], schema=schema)
            t = added(b if carried is None else pa.concat_batches([carried, b]))
            last = int(starts(t["lang"], t["term"])[-1])
            carried = t.slice(last)
            if last:
                yield enough(t.slice(0, last))
        if carried is not None:
            yield enough(carried)

    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(trimmed(rows), "lang string, term string, source string, n long")


def share(n: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / whole), for n + 1 up to whole, without passing 63 bits."""
    left, out = n + 1, np.zeros(np.broadcast(n, whole).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


class Bucket:
    """The partial result of one (lang, bucket, block): sums of pairs, and the first terms of each source."""

    def __init__(self, sources: list[str], totals: list[int], mine: list[bool], kept: int) -> None:
        self.sources, self.totals, self.kept = sources, np.array(totals, np.int64), kept
        self.place = {s: i for i, s in enumerate(sources)}
        self.mine = np.flatnonzero(mine)
        self.sums = np.zeros((len(self.mine), len(sources)), np.int64)
        self.first: dict[int, tuple[list[str], np.ndarray]] = {}

    def add(self, t: pa.RecordBatch) -> None:
        """Adds whole runs, sorted by (term, source)."""
        at = starts(t["term"])
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(t))))
        column = np.fromiter(map(self.place.__getitem__, t["source"].to_pylist()), np.int64, len(t))
        n = t["n"].to_numpy()
        terms = t["term"].take(pa.array(at))
        step = max(1, CELLS // len(self.sources))
        for i in range(0, len(at), step):
            here = (run >= i) & (run < i + step)
            counts = np.zeros((min(step, len(at) - i), len(self.sources)), np.int64)
            counts[run[here] - i, column[here]] = n[here]
            p = share(counts, self.totals[None, :] + self.kept)
            whole = share(counts.sum(axis=1), int(self.totals.sum()) + self.kept)
            for k, s in enumerate(self.mine.tolist()):
                d = p[:, s, None] - p
                self.sums[k] += (d * d // p).sum(axis=0)
                found = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > whole))
                d = p[found, s] - whole[found]
                value = d * d // whole[found]
                order = np.argsort(-value, kind="stable")[:TERMS]
                self.keep(s, [terms[i + j].as_py() for j in found[order].tolist()], value[order])

    def keep(self, s: int, terms: list[str], value: np.ndarray) -> None:
        """The first TERMS of a source by value, ties in the order of terms, which come sorted."""
        old = self.first.get(s, ([], np.empty(0, np.int64)))
        terms, value = old[0] + terms, np.concatenate([old[1], value])
        order = np.argsort(-value, kind="stable")[:TERMS]
        self.first[s] = ([terms[i] for i in order.tolist()], value[order])

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        for k, s in enumerate(self.mine.tolist()):
            for i, value in enumerate(self.sums[k].tolist()):
                if i != s:
                    yield self.sources[s], "pair", self.sources[i], value
        for s, (terms, value) in self.first.items():
            for term, v in zip(terms, value.tolist(), strict=True):
                yield self.sources[s], "term", term, v


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = written(runs(occurrences(docs, text, lang, source), least), "terms")
    buckets = kept.count() // ROWS + 1
    groups = docs.select(*keys(lang, source)).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    numbered = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("n"), F.coalesce("kept", zero).alias("kept"), ((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / BLOCK).cast("int").alias("of"))
    headed = written(numbered, "groups")
    blocks = headed.select("lang", F.col("of").alias("block")).distinct()
    none = F.lit(None)
    heads = headed.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "block", none.cast("string").alias("term"), "source", "n", "kept", (F.col("of") == F.col("block")).alias("mine"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    tails = kept.join(blocks, "lang").select("lang", bucket, "block", "term", "source", "n", none.cast("long").alias("kept"), none.cast("boolean").alias("mine"))
    stream = heads.unionByName(tails).repartition("lang", "bucket", "block").sortWithinPartitions("lang", "bucket", "block", F.asc_nulls_first("term"), "source")
    schema = pa.schema([(x, pa.string()) for x in ("lang", "source", "part", "item")] + [("value", pa.int64())])

    def given(where: str, found: Bucket) -> Iterator[pa.RecordBatch]:
        for some in _slices(list(found.rows())):
            yield batch(schema, [[where] * len(some), *(list(c) for c in zip(*some, strict=True))])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, heads_, found, waiting = None, [], None, None
        for b in batches:
            if not len(b):
                continue
            cuts = [*starts(b["lang"], b["bucket"], b["block"]).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                t = b.slice(i, j - i)
                key = (t["lang"][0].as_py(), t["bucket"][0].as_py(), t["block"][0].as_py())
                if key != where:
                    if where is not None:
                        yield from given(where[0], _closed(heads_, found, waiting))
                    where, heads_, found, waiting = key, [], None, None
                head = t.filter(pc.is_null(t["term"]))
                heads_ += zip(*(head[x].to_pylist() for x in ("source", "n", "mine", "kept")), strict=True)
                t = t.filter(pc.is_valid(t["term"])).select(["term", "source", "n"])
                if not len(t):
                    continue
                found = found or _opened(heads_)
                t = t if waiting is None else pa.concat_batches([waiting, t])
                last = int(starts(t["term"])[-1])
                waiting = t.slice(last)
                if last:
                    found.add(t.slice(0, last))
        if where is not None:
            yield from given(where[0], _closed(heads_, found, waiting))

    parts = written(stream.mapInArrow(trimmed(rows), "lang string, source string, part string, item string, value long"), "parts")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    every = pairs.unionByName(parts.filter("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return every.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TERMS)).select("lang", "source", "part", "item", "value", "rank")


def _opened(heads: list[tuple]) -> Bucket:
    sources, totals, mine, kept = zip(*heads, strict=True)
    return Bucket(list(sources), list(totals), list(mine), kept[0])


def _closed(heads: list[tuple], found: Bucket | None, waiting: pa.RecordBatch | None) -> Bucket:
    found = found or _opened(heads)
    if waiting is not None:
        found.add(waiting)
    return found

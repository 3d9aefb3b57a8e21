"""Phrase collocations from depth-limited count tries.

Shards: a task streams texts into a count trie of depth DEPTH per language: its leaves are the windows of up to four words that start at each
word and end with the piece. A trie is closed when it holds WINDOWS windows or its words no longer fit 16-bit names; words are then named in
byte order, so that the sorted leaves are the trie in the order of a walk. It is serialised level by level (a node's word and its number of leaves)
and cut where prefix ranges end.

Ranges: cut windows come from a sample of SAMPLED documents at most; they decide only who counts what. There are enough that a range gets about
RANGE windows, RANGES at most. A task gets whole ranges one after the other and merges the tries of a range: the
sorted leaves of all are brought to common names and equal ones summed, every HELD leaves. A walk over the result gives each node's count,
which is the sum of its leaves, and those of the nodes above it: the left parts of every cut. A node whose subtree a cut divides
is summed afterwards; there are at most 2 * DEPTH of them a range, so their table is bounded and broadcast.

Suffix links: the rest of a phrase after its first word is a phrase at least as frequent, so it is in the table of frequent ones; joining each length
to the one below gives it, and with it the rests that phrase was linked to: the right parts of all cuts.

Scores are floors of exact quotients in decimals of 38 digits. Each language's first rows are taken within SALTS parts of it before one task ranks them.

Memory: a task holds one trie or one range. Beyond RANGES * RANGE windows (some 700 GB of text) ranges grow with the input.

Defined cases: null texts are empty and without phrases, a null language is `und` like that language itself, an empty one stays empty; words hold any
characters but spaces, tabs and the marks that end pieces; very long texts are split into words a megabyte at a time; repeated rows count as often as they
are there; ties go by phrase; a language with words but no candidate has no row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, ready, trimmed, written

DEPTH = 4
LEAST = 30
COVERED = 80  # percent of a candidate's count within a longer one, with which it is dropped
FIRST = 2000
SALTS = 32
SCALE = 2_000_000

SAMPLED = 2000
STRIDE, MOST = 16, 2000  # of a sampled document's windows every 16th, 2,000 at most
WINDOWS = 2_000_000
WORDS, STEP = 48_000, 16_000  # a trie is closed beyond so many words; tokens named at a time
RANGE, RANGES = 1_000_000, 65_536
HELD = 3_000_000
PARTS = 8192
CHUNK = 1 << 20
END = b"."
BREAKS = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" .........")

Window4 = tuple[bytes, ...]


def chunks(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut after spaces or tabs."""
    start = 0
    while len(text) - start > CHUNK:
        cut = max(text.rfind(b" ", start, start + CHUNK), text.rfind(b"\t", start, start + CHUNK))
        if cut < 0:
            after = [x for x in (text.find(b" ", start + CHUNK), text.find(b"\t", start + CHUNK)) if x >= 0]
            if not after:
                break
            cut = min(after)
        yield text[start : cut + 1]
        start = cut + 1
    yield text[start:] if start else text


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, with END between pieces."""
    return text.lower().translate(BREAKS).replace(b".", b" . ").split()


def windows(ids: np.ndarray) -> np.ndarray:
    """Packed windows that start at each word of ids but for the last DEPTH - 1 places; 0 ends a piece."""
    n = len(ids) - DEPTH + 1
    a = ids.astype(np.uint64)
    key, open_ = a[:n].copy(), a[:n] > 0
    for i in range(1, DEPTH):
        w = a[i : n + i]
        open_ = open_ & (w > 0)
        key = (key << np.uint64(16)) | np.where(open_, w, np.uint64(0))
    return key[a[:n] > 0]


def columns(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys >> np.uint64(16 * (DEPTH - 1 - i))) & np.uint64(0xFFFF)).astype(np.uint32) for i in range(DEPTH)]


def changes(cols: list[np.ndarray]) -> list[np.ndarray]:
    """For each depth, at which of the sorted leaves a new node of that depth starts."""
    out, new = [], np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        out.append(new)
    return out


class Shard:
    """The count tries that a task is filling, one a language, over common names of words."""

    def __init__(self) -> None:
        self.open: dict[str, list[bytes]] = {}
        self.clear()

    def clear(self) -> None:
        self.names: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.names[END] = 0
        self.keys: dict[str, list[np.ndarray]] = {}
        self.held = 0

    @property
    def full(self) -> bool:
        return self.held > WINDOWS or len(self.names) > WORDS

    def name(self, lang: str, last: bool) -> None:
        """Puts up to STEP of a language's open words into its trie; those whose windows are not complete stay open."""
        words = self.open[lang]
        part = words[: STEP + DEPTH - 1]
        if last and len(words) <= STEP:
            part = words + [END] * (DEPTH - 1)
        ids = np.fromiter(map(self.names.__getitem__, part), np.uint32, len(part))
        keys = windows(ids)
        self.keys.setdefault(lang, []).append(keys)
        self.held += len(keys)
        self.open[lang] = words[len(part) - DEPTH + 1 :] if len(part) > DEPTH - 1 else words

    def closed(self) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """(language, words in byte order from place 1, sorted leaves, their counts)."""
        names = sorted((w, i) for w, i in self.names.items() if i)
        words = [b"", *(w for w, _ in names)]
        rank = np.zeros(len(words), np.uint64)
        rank[[i for _, i in names]] = np.arange(1, len(words), dtype=np.uint64)
        for lang, found in self.keys.items():
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            if not len(keys):
                continue
            ordered = np.zeros(len(keys), np.uint64)
            for c in columns(keys):
                ordered = (ordered << np.uint64(16)) | rank[c]
            order = np.argsort(ordered)
            yield lang, words, ordered[order], n[order]
        self.clear()


def lower_bound(cut: Window4, place: dict[bytes, int], words: list[bytes]) -> int:
    """The smallest packed window, by the given names, that is not before a cut."""
    key = 0
    for i in range(DEPTH):
        w = cut[i] if i < len(cut) else b""
        at = place.get(w) if w else 0
        if at is None:
            at = bisect_left(words, w)
            return (key << 16 | at) << 16 * (DEPTH - 1 - i)
        key = key << 16 | at
    return key


def serialised(cols: list[np.ndarray], n: np.ndarray, words: list[bytes]) -> bytes:
    """A trie's sorted leaves as levels of (word, leaves below), with their counts and the words."""
    used = np.unique(np.concatenate([np.zeros(1, np.uint32), *cols]))
    cols = [np.searchsorted(used, c).astype("<u4") for c in cols]
    fields = [b" ".join(words[i] for i in used[1:])]
    for new, c in zip(changes(cols)[:-1], cols[:-1], strict=True):
        starts = np.flatnonzero(new)
        fields += [c[starts].tobytes(), np.diff(np.append(starts, len(n))).astype("<u4").tobytes()]
    fields += [cols[-1].tobytes(), n.astype("<i8").tobytes()]
    head = np.array([len(f) for f in fields], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(fields))


def restored(blob: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """(words from place 1, columns of leaves, counts) of a serialised trie."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    fields, at = [], 8 * (2 * DEPTH + 1)
    for size in np.frombuffer(data, "<i8", 2 * DEPTH + 1):
        fields.append(data[at : at + int(size)])
        at += int(size)
    numbers = [np.frombuffer(f, "<u4") for f in fields[1:-1]]
    cols = [np.repeat(numbers[2 * i], numbers[2 * i + 1]) for i in range(DEPTH - 1)]
    return [b"", *fields[0].split(b" ")], [*cols, numbers[-1]], np.frombuffer(fields[-1], "<i8")


def tries(docs: DataFrame, text: str, lang: str, cuts: list[tuple[str, Window4]]) -> DataFrame:
    """Serialised tries (lang, part, trie), cut at the ranges that begin at cuts."""
    rows_in = ready(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("t"))
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("trie", pa.binary())])
    by_lang: dict[str, list[tuple[int, Window4]]] = {}
    for i, (where, cut) in enumerate(cuts):
        by_lang.setdefault(where, []).append((i + 1, cut))
    langs = [where for where, _ in cuts]

    def ranges(where: str) -> list[tuple[int, Window4]]:
        return [(bisect_left(langs, where), ()), *by_lang.get(where, [])]

    def emptied(shard: Shard) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        for where, words, keys, n in shard.closed():
            place = place or {w: i for i, w in enumerate(words)}
            parts = ranges(where)
            ends = np.searchsorted(keys, np.array([lower_bound(c, place, words) for _, c in parts[1:]], np.uint64)).tolist()
            cols = columns(keys)
            out: list[list] = [[], [], []]
            for (part, _), i, j in zip(parts, [0, *ends], [*ends, len(keys)], strict=True):
                if i < j:
                    for column, value in zip(out, (where, part, serialised([c[i:j] for c in cols], n[i:j], words)), strict=True):
                        column.append(value)
            for i in range(0, len(out[0]), 64):
                yield batch(schema, [c[i : i + 64] for c in out])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for where, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held = shard.open.setdefault(where, [])
                for chunk in chunks(t.as_py() or b""):
                    held += words_of(chunk)
                    while len(held) > STEP + DEPTH:
                        shard.name(where, False)
                        held = shard.open[where]
                        if shard.full:
                            yield from emptied(shard)
                held.append(END)
            if sum(map(len, shard.open.values())) > WINDOWS:
                yield from ended(shard)
        yield from ended(shard)

    def ended(shard: Shard) -> Iterator[pa.RecordBatch]:
        for where in list(shard.open):
            while len(shard.open[where]) > DEPTH - 1:
                last = len(shard.open[where]) <= STEP
                shard.name(where, last)
                if shard.full:
                    yield from emptied(shard)
                if last:
                    break
            else:
                shard.name(where, True)
            del shard.open[where]
        yield from emptied(shard)

    return rows_in.mapInArrow(trimmed(rows), "lang string, part int, trie binary")


def summed(cols: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Leaves in order, equal ones as one."""
    high, low = (cols[0].astype(np.uint64) << np.uint64(32)) | cols[1], (cols[2].astype(np.uint64) << np.uint64(32)) | cols[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    high, low = high[starts], low[starts]
    half = np.uint64(0xFFFFFFFF)
    return [(high >> np.uint64(32)).astype(np.uint32), (high & half).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint32), (low & half).astype(np.uint32)], np.add.reduceat(n[order], starts)


class Merged:
    """The tries of one range and language brought together."""

    def __init__(self) -> None:
        self.names: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.names[b""] = 0
        self.waiting: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.held = 0
        self.limit = HELD

    def add(self, blob: bytes) -> None:
        words, cols, n = restored(blob)
        name = np.fromiter(map(self.names.__getitem__, words), np.uint32, len(words))
        self.waiting.append(([name[c] for c in cols], n))
        self.held += len(n)
        if self.held > self.limit:
            self.together()
            self.limit = max(HELD, 2 * self.held)

    def together(self) -> None:
        cols = [np.concatenate([w[0][i] for w in self.waiting]) for i in range(DEPTH)]
        n = np.concatenate([w[1] for w in self.waiting])
        self.waiting.clear()
        self.waiting.append(summed(cols, n))
        self.held = len(self.waiting[0][1])

    def walked(self, least: int, edges: list[Window4]) -> tuple[list, int]:
        """(phrase, depth, count, whether a cut divides it, counts of the nodes above or None where a cut divides them) of nodes that are frequent or divided; the count of all words."""
        names = sorted((w, i) for w, i in self.names.items() if i)
        words = [b"", *(w for w, _ in names)]
        rank = np.zeros(len(words), np.uint32)
        rank[[i for _, i in names]] = np.arange(1, len(words), dtype=np.uint32)
        place = {w: i for i, w in enumerate(words)}
        self.waiting = [([rank[c] for c in cols], n) for cols, n in self.waiting]
        self.together()
        cols, n = self.waiting[0]
        news = changes(cols)
        at = [np.cumsum(new) - 1 for new in news]
        starts = [np.flatnonzero(new) for new in news]
        counts = [np.add.reduceat(n, s) for s in starts]
        divided = []
        for depth in range(1, DEPTH + 1):
            hit = np.zeros(len(starts[depth - 1]), bool)
            for cut in edges:
                key = [place.get(w) for w in cut[:depth]]
                if len(key) == depth and None not in key:
                    same = np.ones(len(hit), bool)
                    for c, k in zip(cols, key, strict=False):
                        same &= c[starts[depth - 1]] == k
                    hit |= same
            divided.append(hit)
        out = []
        for d in range(DEPTH):
            keep = np.flatnonzero(((counts[d] >= least) | divided[d]) & (cols[d][starts[d]] > 0))
            first = starts[d][keep]
            above = []
            for e in range(DEPTH - 1):
                up = at[e][first]
                above.append([None if e >= d or cut else int(c) for cut, c in zip(divided[e][up], counts[e][up], strict=True)])
            spelled = [b" ".join(words[c[i]] for c in cols[: d + 1]).decode() for i in first.tolist()]
            out += zip(spelled, repeat(d + 1), counts[d][keep].tolist(), divided[d][keep].tolist(), *above, strict=False)
        return out, int(n.sum())


def merged(shards: DataFrame, cuts: list[tuple[str, Window4]], least: int) -> DataFrame:
    """Nodes (lang, phrase, depth, f, divided, l1, l2, l3) from serialised tries; depth 0 has the count of all words."""
    parts = min(PARTS, len(cuts) + 1)
    kinds = {"lang": "string", "phrase": "string", "depth": "int", "f": "long", "divided": "boolean", "l1": "long", "l2": "long", "l3": "long"}
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, arrow[t]) for n, t in kinds.items()])

    def nodes(where: str, part: int, found: Merged) -> Iterator[pa.RecordBatch]:
        edges = [cuts[i][1] for i in (part - 1, part) if 0 <= i < len(cuts) and cuts[i][0] == where]
        out, total = found.walked(least, edges)
        out.append(("", 0, total, True, None, None, None))
        for i in range(0, len(out), 10_000):
            some = out[i : i + 10_000]
            yield batch(schema, [[where] * len(some), *(list(c) for c in zip(*some, strict=True))])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, str] | None = None
        found = Merged()
        for b in batches:
            for where, part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if current is not None and current != (part, where):
                    yield from nodes(current[1], current[0], found)
                    found = Merged()
                current = (part, where)
                found.add(blob.as_py())
        if current is not None:
            yield from nodes(current[1], current[0], found)

    dealt = shards.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(trimmed(rows), ", ".join(f"{n} {t}" for n, t in kinds.items()))


def cut_points(docs: DataFrame, text: str, lang: str, per_range: int) -> list[tuple[str, Window4]]:
    """Where ranges begin but the first: quantiles of windows of a bounded sample of documents."""
    total = docs.count()
    if not total:
        return []
    some = ready(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("t")).sample(min(1.0, SAMPLED / total), seed=7)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for where, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(t.as_py() or b"")
                starts = [i for i in range(0, len(words), max(STRIDE, len(words) // MOST)) if words[i] != END]
                for i in starts:
                    w = words[i : i + DEPTH]
                    out[0].append(where)
                    out[1].append(b" ".join(w[: w.index(END)] if END in w else w))
                    out[2].append(0)
                out[0].append(where)
                out[1].append(None)
                out[2].append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["lang", "w", "n"])

    found = some.mapInArrow(rows, "lang string, w binary, n long").collect()
    docs_seen = sum(1 for r in found if r.w is None)
    if not docs_seen:
        return []
    expected = sum(r.n for r in found) / docs_seen * total
    marks = sorted((r.lang, tuple(bytes(r.w).split(b" "))) for r in found if r.w is not None)
    ranges = int(min(RANGES, max(1, -(-expected // per_range)), len(marks) + 1))
    return sorted({marks[i * len(marks) // ranges] for i in range(1, ranges)})


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, per_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, depth, f, l1, l2, l3: counts of their first words), and (lang, n)."""
    cuts = cut_points(docs, text, lang, per_range)
    nodes = written(merged(tries(docs, text, lang, cuts), cuts, least), "nodes")
    whole = nodes.filter("NOT divided").drop("divided")
    none = F.lit(None).cast("long")
    over = written(nodes.filter("divided").groupBy("lang", "phrase", "depth").agg(F.sum("f").alias("f")), "divided")
    frequent = whole.unionByName(over.filter((F.col("depth") > 0) & (F.col("f") >= least)).select("*", none.alias("l1"), none.alias("l2"), none.alias("l3")))
    above = over.filter("depth > 0").select(F.col("lang").alias("wl"), F.col("phrase").alias("wp"), F.col("f").alias("wf"))
    for i in range(1, DEPTH):
        left = F.col(f"l{i}")
        here = left.isNull() & (F.col("depth") > i) & (F.col("lang") == F.col("wl")) & (F.substring_index("phrase", " ", i) == F.col("wp"))
        frequent = frequent.join(F.broadcast(above), here, "left").withColumn(f"l{i}", F.coalesce(left, "wf")).drop("wl", "wp", "wf")
    return written(frequent, "frequent"), over.filter("depth = 0").select("lang", F.col("f").alias("n"))


def rest(phrase: Column) -> Column:
    """A phrase without its first word."""
    return F.substr(phrase, F.instr(phrase, " ") + 1)


def linked(frequent: DataFrame) -> DataFrame:
    """Phrases of two words or more with r1, r2, r3: counts of what follows their first words, by suffix links."""
    none = F.lit(None).cast("long")
    below = frequent.filter("depth = 1").select("lang", "phrase", "f", none.alias("r1"), none.alias("r2"))
    out: DataFrame | None = None
    for depth in range(2, DEPTH + 1):
        link = below.select(F.col("lang").alias("sl"), F.col("phrase").alias("sp"), F.col("f").alias("r1"), F.col("r1").alias("r2"), F.col("r2").alias("r3"))
        here = frequent.filter(F.col("depth") == depth)
        level = written(here.join(link, (here["lang"] == link["sl"]) & (rest(here["phrase"]) == link["sp"])).drop("sl", "sp"), f"linked-{depth}")
        out = level if out is None else out.unionByName(level)
        below = level.select("lang", "phrase", "f", "r1", "r2")
    assert out is not None
    return out


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST, per_range: int = RANGE) -> DataFrame:
    """Each language's first collocations: lang, rank, phrase, a, l, r, n, score."""
    frequent, totals = counted(docs, text, lang, least, per_range)
    c = linked(frequent).withColumnRenamed("f", "a")
    wide = F.lit(SCALE).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)")

    def cut(k: int) -> Column:
        return F.when(F.col("depth") > k, F.struct(F.call_function("div", wide, F.col(f"l{k}").cast("decimal(19,0)") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    c = c.withColumn("cut", F.array_min(F.array(*[cut(k) for k in range(1, DEPTH)])))
    w = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("depth") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("depth") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    inside = c.filter("depth > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = c.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * COVERED))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

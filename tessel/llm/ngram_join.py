"""Near-duplicate join on word shingles by filtering under several global token orders.

A document's set holds its distinct SHINGLE-word shingles; two link when their Jaccard similarity is at least
THRESHOLD percent. Equal sets are one class, and the join is among classes.

Orders. Under any order of all tokens two sets that link share a token of their prefixes, the first n - ceil(0.8 n) + 1
tokens. There are three orders. The first puts rare shingles first (by the number of classes that hold them, then by
falling hash); it makes the candidates. The second goes by rising hash and the third by falling hash, whatever the
frequency: where a set's prefix ends there is known as soon as the set is, and travels with the class as a number. A
pair is verified only if it shares prefix tokens under all three. Shingles of one class alone come first in the first order and match
nothing, so they use up prefixes without any row being made for them, and they bound every overlap from above: most
classes drop out right there.

Frequencies come from one shuffle of packed bytes (the 64-bit hash of a shingle, two or four bytes for its document, and an
8-byte class mark per document and packet). Its parts are as many as the bytes of text ask for (PART_BYTES each), so a task
counts a bounded share by sorting, and gives back only shingles that several classes hold.

Classes and shingles are named by 64-bit hashes: of ten thousand million distinct ones about three pairs would share one.

Groups. Within the list of a prefix token every class is compared to one pivot, not to every other. Links to pivots
give components; only pairs that lie in different components are left, one side outside the pivot's component. Their
overlap is bounded by the place of the token they meet at and by what each shares with the pivot (which is why overlaps
with pivots are measured even where an order excludes the link); then come the other orders, and
only then are sets intersected. No pair is dropped unless a bound excludes a link or its ends are connected already,
so components are exact.

Defined cases: null or blank texts have an empty set and link with nothing; fewer than SHINGLE words make one shingle;
repeated rows and equal texts are one class; ties in an order go by hash, ties for a group's first row by key and then by
the text's hash; rows with a null key stand alone, with a null component; very long texts
are whole; an empty table gives an empty result; other columns are not read by components() and pass through keep().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, free, ready, trimmed, written

SHINGLE = 5
THRESHOLD = 80
REMEMBERED = 150_000
SLICE = 2048  # documents, and
FLUSH = 500_000  # shingles that a task holds at once before it packs them, more where parts are many
MOST_FLUSH = 4_000_000
EDGES = 100_000  # of a component's graph in a file
PART_BYTES = 12 << 20  # of text whose shingles a task counts
TOP = np.uint64(1 << 63)
MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    """Hashes of words, remembered in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, words: Hashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(a))
    h = np.full(len(a) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ a[k : len(a) - width + 1 + k]) * MIX
        h ^= h >> np.uint64(31)
    h *= TURN
    h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix_length(n: int) -> int:
    """Of a set of n tokens, how many come first under an order such that sets that link share one of them."""
    return n - -(-n * THRESHOLD // 100) + 1


def tokens_of(h: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers of the same order."""
    return (h ^ TOP).view(np.int64)


def packets(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Document rows (k, n, mark, up, down, h) and packed shingles (marks, at, token), by part; up and down are where the prefixes by rising and falling hash end, h is a hash of the text."""
    keyed = ready(docs).select(docs[key].cast("long").alias("k"), F.col(text).cast("binary").alias("t"), F.xxhash64(F.col(text)).alias("h"))
    kinds = {"part": "int", "k": "long", "n": "long", "mark": "long", "up": "long", "down": "long", "h": "long", "marks": "binary", "at": "binary", "token": "binary"}
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, arrow[t]) for n, t in kinds.items()])
    flush = min(MOST_FLUSH, max(FLUSH, 4000 * parts))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                yield from sliced(b.slice(i, SLICE), words)

    def sliced(b: pa.RecordBatch, words: Hashes) -> Iterator[pa.RecordBatch]:
        facts: list[tuple] = []
        seen: dict[int, int] = {}
        sets: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0
        for t in b.column(1):
            s = shingles(t.as_py() or b"", words)
            if not len(s):
                facts.append((0, None, None, None))
                continue
            mark, ends = signed(xxhash.xxh3_64_intdigest(s.tobytes())), prefix_length(len(s))
            edge = tokens_of(s[[ends - 1, len(s) - ends]])
            facts.append((len(s), mark, int(edge[0]), int(edge[1])))
            if mark not in seen:
                seen[mark] = len(seen)
                sets.append(s)
                owners.append(np.full(len(s), len(seen) - 1, np.uint32))
                held += len(s)
            if held > flush:
                yield made(sets, owners, seen)
                seen, sets, owners, held = {}, [], [], 0
        if sets:
            yield made(sets, owners, seen)
        nothing = [None] * b.num_rows
        n, mark, up, down = (list(c) for c in zip(*facts, strict=True))
        yield batch(schema, [[i % parts for i in range(b.num_rows)], b.column(0), n, mark, up, down, b.column(2), nothing, nothing, nothing])

    def made(sets: list[np.ndarray], owners: list[np.ndarray], seen: dict[int, int]) -> pa.RecordBatch:
        found = packed(np.concatenate(sets), np.concatenate(owners), np.array(list(seen), "<i8"), parts)
        nothing = [None] * len(found[0])
        return batch(schema, [found[0], *[nothing] * 6, *found[1:]])

    return keyed.mapInArrow(trimmed(rows), ", ".join(f"{n} {t}" for n, t in kinds.items()))


def packed(h: np.ndarray, owner: np.ndarray, marks: np.ndarray, parts: int) -> list[list]:
    """Columns of packets: per part the part, the marks of its documents, then for each shingle its document and token."""
    part = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    token, owner, part = tokens_of(h[order]), owner[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    out: list[list] = [[] for _ in range(4)]
    for i, j in zip([0, *cuts], [*cuts, len(h)], strict=True):
        own, at = np.unique(owner[i:j], return_inverse=True)
        for column, value in zip(out, (int(part[i]), marks[own].tobytes(), at.astype(place(len(own))).tobytes(), token[i:j].astype("<i8").tobytes()), strict=True):
            column.append(value)
    return out


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def place(n: int) -> str:
    """The type of a place among n."""
    return "<u2" if n <= 65536 else "<u4"


def shared(packs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark, token, df) of the tokens that several marks hold, from packets (marks, at, token)."""
    base = np.cumsum([0, *(len(m) for m, _, _ in packs)])
    marks = np.concatenate([m for m, _, _ in packs])
    at = np.concatenate([a + np.int32(base[i]) for i, (_, a, _) in enumerate(packs)])
    token = np.concatenate([t for _, _, t in packs])
    packs.clear()
    marks, code = np.unique(marks, return_inverse=True)
    owner = code.astype(np.int32)[at]
    del at, code
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    del order
    same = token[1:] == token[:-1]
    several = np.zeros(len(token), bool)
    several[1:] |= same
    several[:-1] |= same
    token, owner = token[several], owner[several]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    _, which, n = np.unique(token, return_inverse=True, return_counts=True)
    df = n[which]
    return marks[owner[df > 1]], token[df > 1], df[df > 1]


def counted(packets_: DataFrame, parts: int) -> DataFrame:
    """Document rows (k, n, mark, up, down, h), and rows (mark, token, df) of shingles that several classes hold."""
    facts = ("k", "n", "mark", "up", "down", "h")
    schema = pa.schema([(x, pa.int64()) for x in (*facts, "token", "df")])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            doc = b.filter(b.column("marks").is_null())
            if len(doc):
                none = [None] * len(doc)
                yield batch(schema, [*(doc.column(x) for x in facts), none, none])
            full = b.filter(b.column("marks").is_valid())
            for part, marks, at, token in zip(*(full.column(x) for x in ("part", "marks", "at", "token")), strict=True):
                own = np.frombuffer(marks.as_py(), "<i8")
                held.setdefault(part.as_py(), []).append((own, np.frombuffer(at.as_py(), place(len(own))).astype(np.int32), np.frombuffer(token.as_py(), "<i8")))
        for part in sorted(held):
            marks, token, df = shared(held.pop(part))
            for i in range(0, len(token), 50_000):
                j = i + 50_000
                none = [None] * len(token[i:j])
                yield batch(schema, [none, none, pa.array(marks[i:j]), none, none, none, pa.array(token[i:j]), pa.array(df[i:j].astype(np.int64))])

    return packets_.repartitionById(parts, F.col("part")).mapInArrow(trimmed(rows), ", ".join(f"{f.name} long" for f in schema))


def least_overlap(a: Column, b: Column) -> Column:
    """The smallest intersection with which sets of a and b tokens link."""
    return F.ceil((a + b) * THRESHOLD / (100 + THRESHOLD) - 1e-9)


def may_link(n1: Column, c1: Column, n2: Column, c2: Column) -> Column:
    """Whether sizes n, of which c tokens are shared with any class, allow a link."""
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * THRESHOLD) & (F.least(c1, c2) >= least_overlap(n1, n2))


def linked(overlap: Column, n1: Column, n2: Column) -> Column:
    return overlap * 100 >= (n1 + n2 - overlap) * THRESHOLD


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): alternating large and small stars until they stand still. Each table is written in as many files as its rows ask for."""
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    most, before = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, parts = state, min(most, 1 + 2 * state.n // EDGES)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts), "stars")
        large = written(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct().coalesce(parts), "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = written(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "stars")
        small = down.join(low, "u").select("u", "v", "m")
        e = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct().coalesce(parts), "edges")


def compared(pairs: DataFrame, sets: DataFrame, measure_all: bool) -> DataFrame:
    """Pairs (a, b) that share prefix tokens under the second and third order, with sizes and overlap; with measure_all the others too, as not met."""
    side = lambda x: sets.select(F.col("mark").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"), F.col("second").alias(f"s_{x}"), F.col("third").alias(f"d_{x}"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("met", F.arrays_overlap("s_a", "s_b") & F.arrays_overlap("d_a", "d_b"))
    if not measure_all:
        pairs = pairs.filter("met")
    return pairs.select("a", "b", "n_a", "n_b", "met", F.size(F.array_intersect("t_a", "t_b")).cast("long").alias("overlap"))


def class_links(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Enough linked pairs (a, b) of classes to connect all that links connect, from (mark, n, up, down) and (mark, token, df)."""
    held = tokens.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("df", F.bitwise_not("token").alias("turned")))).alias("t")).join(classes, "mark")
    prefix = F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100 - 1e-9) + 1 - (F.col("n") - F.size("t"))
    prefixes = held.withColumn("m", F.least(prefix, F.size("t")).cast("int")).filter("m > 0").withColumn("tokens", F.transform("t.turned", F.bitwise_not))
    unique = (F.col("n") - F.size("t")).alias("u")
    second, third = F.filter("tokens", lambda x: x <= F.col("up")).alias("second"), F.filter("tokens", lambda x: x >= F.col("down")).alias("third")
    sets = written(prefixes.select("mark", "n", unique, F.size("t").cast("long").alias("c"), "tokens", F.slice("tokens", 1, F.col("m")).alias("first"), second, third).filter("size(second) > 0 AND size(third) > 0"), "sets")
    postings = sets.select("mark", "n", "c", "u", F.posexplode("first").alias("i", "token")).select("token", "mark", "n", "c", (F.col("n") - F.col("u") - F.col("i")).alias("rest"))
    pivot = F.max(F.struct((F.col("c") / F.col("n")).alias("share"), "mark", "n", "c")).alias("p")
    lists = written(postings.groupBy("token").agg(F.count("*").alias("members"), pivot).filter("members > 1").select("token", F.col("p.mark").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.c").alias("pc")), "lists")
    members = written(postings.join(lists, "token"), "members")
    n, c, pn, pc = F.col("n"), F.col("c"), F.col("pn"), F.col("pc")
    stars = members.filter((F.col("mark") != F.col("pivot")) & may_link(n, c, pn, pc)).select(F.col("pivot").alias("a"), F.col("mark").alias("b")).distinct()
    seen = written(compared(stars, sets, True), "star-overlaps")
    links = seen.filter(F.col("met") & linked(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    roots = written(connected(links), "roots")
    open_ = open_members(members.drop("pn", "pc"), roots, seen)
    left, right = open_.filter("minor").alias("l"), open_.alias("r")
    ln, lc, rn, rc, lo, ro = (F.col(x) for x in ("l.n", "l.c", "r.n", "r.c", "l.overlap", "r.overlap"))
    least = least_overlap(ln, rn)
    bound = lo.isNull() | ro.isNull() | (F.least(lo, ro) + F.least(lc - lo, rc - ro) >= least)
    apart = (F.col("l.root") != F.col("r.root")) & (~F.col("r.minor") | (F.col("l.mark") < F.col("r.mark")))
    met = F.least("l.rest", "r.rest") >= least  # if this is the first token that both hold, what can still be shared
    crossing = left.join(right, (F.col("l.token") == F.col("r.token")) & apart & may_link(ln, lc, rn, rc) & met & bound)
    pairs = written(crossing.select(F.col("l.mark").alias("a"), F.col("r.mark").alias("b")).distinct(), "crossing")
    more = compared(pairs, sets, False).filter(linked(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    return written(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "links")


def open_members(members: DataFrame, roots: DataFrame, seen: DataFrame) -> DataFrame:
    """Members of the lists that hold several components: root, whether it is not the pivot's (minor), overlap with the pivot where known."""
    rooted = written(members.join(roots.select(F.col("node").alias("mark"), F.col("root").alias("r")), "mark", "left").withColumn("root", F.coalesce("r", "mark")).drop("r"), "rooted")
    several = written(rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token"), "open-lists")
    m = rooted.join(several, "token")
    m = m.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("pr")), "pivot", "left")
    m = m.join(seen.select(F.col("a").alias("pivot"), F.col("b").alias("mark"), "overlap"), ["pivot", "mark"], "left")
    minor = (F.col("root") != F.coalesce("pr", "pivot")).alias("minor")
    return written(m.select("token", "mark", "n", "c", "rest", "root", minor, F.when(F.col("mark") == F.col("pivot"), F.col("c")).otherwise(F.col("overlap")).alias("overlap")), "open-members")


def parts_of(docs: DataFrame, text: str) -> int:
    """Into how many parts shingles are dealt: by the bytes of text, but no fewer than the session's shuffle partitions."""
    held = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))


def grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, n, mark, h, component (the smallest key that links reach) and root (the component's own name, as several can share a key) of every row."""
    parts = parts_of(docs, text)
    base = written(counted(packets(docs, key, text, parts), parts), "shingles")
    rows = base.filter("n is not null").select("k", "n", "mark", "h")
    classes = written(base.filter("n is not null and mark is not null and k is not null").groupBy("mark").agg(F.max("n").alias("n"), F.min("k").alias("k"), F.max("up").alias("up"), F.max("down").alias("down")), "classes")
    links = class_links(classes.drop("k"), base.filter("token is not null").select("mark", "token", "df"))
    roots = connected(links)
    rooted = written(classes.join(roots.select(F.col("node").alias("mark"), "root"), "mark", "left").select("mark", "k", F.coalesce("root", "mark").alias("root")), "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("k").alias("component")), "smallest")
    of = written(rooted.join(smallest, "root").select("mark", "component", "root"), "components")
    out = rows.join(of, "mark", "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce(F.when(F.col("mark").isNotNull(), F.col("component")), F.col("k")))
    return out.select("k", "n", "mark", "h", component.alias("component"), "root")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach) of every row."""
    return grouped(docs, key, text).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest key; rows without a key all stay.

    Rows are told apart by key and a 64-bit hash of the text: of a group's rows with its smallest key the one of the
    smallest hash stays, whatever else its key is on. Of rows that repeat both key and text the one with the smallest other columns
    stays (by their hash). What goes is a small sorted table of keys (and of keys with hashes, for keys of which only some rows
    go), so texts are shuffled only where that table is too large to broadcast.
    """
    found = written(grouped(docs, key, text), "near-copies").filter("k is not null")
    first = written(found.filter("mark is not null").groupBy("root").agg(F.min(F.struct("k", "h")).alias("first")), "firsts")
    met = found.join(first, "root", "left")
    stays = F.col("mark").isNull() | F.coalesce((F.col("k") == F.col("first.k")) & (F.col("h") == F.col("first.h")), F.lit(True))
    own, hash_ = free("_key", docs), free("_hash", docs)
    judged = written(met.groupBy(F.col("k").alias(own), F.col("h").alias(hash_)).agg(F.max(stays).alias("stays"), F.count("*").alias("rows")), "judged")
    by_key = judged.groupBy(own).agg(F.max("stays").alias("some"))
    gone = written(by_key.filter("NOT some").select(own).repartitionByRange(own).sortWithinPartitions(own), "gone")
    rest = docs.join(gone, F.col(key).cast("long") == F.col(own), "left_anti")
    here = (F.col(key).cast("long") == F.col(own)) & (F.xxhash64(F.col(text)) == F.col(hash_))
    partly = written(judged.filter("NOT stays").join(by_key.filter("some"), own, "left_semi").select(own, hash_), "partly-gone")
    if not partly.isEmpty():
        rest = rest.join(partly, here, "left_anti")
    repeated = written(judged.filter("stays AND rows > 1").select(own, hash_), "repeated")
    if repeated.isEmpty():
        return rest
    others = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in docs.columns if c not in (key, text)], F.lit(0))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    once = rest.join(repeated, here, "left_semi").select(F.struct(F.col(key), F.xxhash64(F.col(text))).alias("_id"), others.alias("_others"), row.alias("_row"))
    kept = once.groupBy("_id").agg(F.min_by("_row", "_others").alias("_row"))
    return rest.join(repeated, here, "left_anti").unionByName(kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))

"""A persisted inverted index for the term score: built once, updated by new and removed rows only, searched by skipping blocks.

Layout. An index is a versioned folder (tessel.sources.versions) of segments. A segment has `docs` (key, block, dl, terms) and `postings`, a row per
term and block: how many documents hold the term, the highest count and the shortest length among them, and the arrays of keys, counts and lengths.
A block is a run of BLOCK documents in the order of length, so a term that every document holds has a row per BLOCK documents, never one long list.
An update writes a segment with the new rows, and the keys it takes away from each older segment with their terms; compact() folds all into one.

Search. Lengths, counts of documents and of terms come from small columns. From the highest count and shortest length of each term in a block follows
the most that a document of the block can score. The blocks that promise most are read first; the k-th best score there is the threshold,
and of the others only those that can still reach it. What is skipped cannot be among the first k, so the result is that of a scan of all texts.

Memory: a query's words are literals, a block's rows are at most BLOCK a term; the driver holds a list of segments, one row of statistics, and the threshold.

Defined cases: null and empty texts have no postings but count as documents; rows without key are left out; repeated keys in one table are
one document (of the smallest text hash); an update's row replaces the key's old one; a key removed twice is removed once; words in no document score nothing;
ties go by key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators.retrieve import top
from tessel.scratch import written
from tessel.sources.versions import Log

BLOCK = 1024
FIRST_BLOCKS = 8


def counted(tokens: Column) -> Column:
    """The distinct tokens of an array with their counts, in order: runs of the sorted array."""

    def runs(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return T.bound(starts, lambda s: F.transform(s, lambda x, j: F.struct(F.get(a, x).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(a)) - x).alias("tf"))))

    return F.when(F.size(tokens) > 0, T.bound(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def _documents(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, dl, terms: a row per key."""
    each = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
    once = each.groupBy("key").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")) if each.groupBy("key").count().filter("count > 1").limit(1).count() else each
    return once.select("key", F.size("_t").alias("dl"), counted(F.col("_t")).alias("terms"))


def _postings(docs: DataFrame) -> DataFrame:
    """The lists of a segment's docs. Rows are dealt out by ranges of term and block before they are gathered: they move once, and no task gathers more than its range."""
    rows = docs.select("key", "dl", "block", F.explode("terms").alias("x")).select("x.term", "block", "key", "x.tf", "dl").repartitionByRange("term", "block")
    lists = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("key", "tf", "dl"))).alias("p"))
    lists = lists.select("term", "block", F.size("p").alias("n"), F.array_max("p.tf").alias("tf"), F.array_min("p.dl").alias("dl"), F.col("p.key").alias("keys"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
    return lists.sortWithinPartitions("term", "block")


def _segment(docs: DataFrame, path: str, block: int) -> None:
    """Writes the docs and postings of a segment, from (key, dl, terms)."""
    spark = docs.sparkSession
    found = written(docs, "index-docs").repartitionByRange("dl", "key").sortWithinPartitions("dl", "key")
    row = F.monotonically_increasing_id()  # part << 33 | row, in the order of dl within a part
    placed = found.withColumn("block", F.floor(F.shiftright(row, 33) * ((1 << 33) // block) + row.bitwiseAND((1 << 33) - 1) / block).cast("long"))
    placed.write.parquet(f"{path}/docs")
    _postings(spark.read.parquet(f"{path}/docs")).write.parquet(f"{path}/postings")


def build(docs: DataFrame, key: str, tokens: Column, path: str, block: int = BLOCK) -> int:
    """Writes the index of a table as the first version of a folder; returns the version."""
    name = f"segment-{uuid.uuid4().hex}"
    _segment(_documents(docs, key, tokens), f"{path}/{name}", block)
    return Log(docs.sparkSession, path).commit(0, {"segments": [name], "removed": []})


def _segments(spark: SparkSession, path: str, version: int | None = None) -> tuple[list[str], list[str]]:
    log = Log(spark, path)
    at = log.current() if version is None else version
    if not at:
        raise FileNotFoundError(f"{path}: no index")
    found = log.payload(at)
    return found["segments"], found["removed"]


def _all(spark: SparkSession, path: str, segments: list[str], part: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{s}/{part}").withColumn("segment", F.lit(s)) for s in segments])


def _removed(spark: SparkSession, path: str, removed: list[str]) -> DataFrame | None:
    """key, segment it is taken from, dl, terms."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{r}") for r in removed]) if removed else None


def live(spark: SparkSession, path: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The documents in the index (key, segment, block, dl, terms), where keys are given only those; what was removed is then looked up for these alone."""
    segments, removed = _segments(spark, path, version)
    docs, gone = _all(spark, path, segments, "docs"), _removed(spark, path, removed)
    if keys is not None:
        docs = docs.join(keys.distinct(), "key", "left_semi")
    return docs if gone is None else docs.join(gone.select("key", "segment"), ["key", "segment"], "left_anti")


def update(path: str, rows: DataFrame, key: str, tokens: Column, removed: DataFrame | None = None, block: int = BLOCK) -> int:
    """Adds rows, replacing those of the same keys, and takes away the keys of `removed`; reads of the old only the documents' own rows."""
    spark = rows.sparkSession
    name, gone = f"segment-{uuid.uuid4().hex}", f"removed-{uuid.uuid4().hex}"
    _segment(_documents(rows, key, tokens), f"{path}/{name}", block)
    keys = rows.select(F.col(key).alias("key"))
    if removed is not None:
        keys = keys.unionByName(removed.select(F.col(key).alias("key")))
    at = Log(spark, path).current()
    taken = live(spark, path, at, keys).select("key", "segment", "dl", "terms")
    taken.write.parquet(f"{path}/{gone}")
    before = Log(spark, path).payload(at)
    return Log(spark, path).commit(at, {"segments": [*before["segments"], name], "removed": [*before["removed"], gone]})


def compact(spark: SparkSession, path: str, block: int = BLOCK) -> int:
    """One segment of all that is live, without reading a text."""
    at = Log(spark, path).current()
    name = f"segment-{uuid.uuid4().hex}"
    _segment(live(spark, path, at).select("key", "dl", "terms"), f"{path}/{name}", block)
    return Log(spark, path).commit(at, {"segments": [name], "removed": []})


def _score(tf: Column, dl: Column, idf: float, avgdl: float) -> Column:
    return F.lit(idf) * tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * dl / F.lit(avgdl)))


def search(spark: SparkSession, path: str, question: list[str], k: int, key: str = "key", version: int | None = None, first: int = FIRST_BLOCKS, told: Callable[[dict], None] | None = None) -> DataFrame:
    """key and score of the k best documents. `told` gets the numbers of blocks that hold a word of the question and of those read."""
    words = sorted(set(question))
    empty = live(spark, path, version).select(F.col("key").alias(key), F.lit(0.0).alias("score")).limit(0)
    if not words:
        return empty
    segments, removed = _segments(spark, path, version)
    postings, gone = _all(spark, path, segments, "postings").filter(F.col("term").isin(words)), _removed(spark, path, removed)
    of_docs = [F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")]
    have = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("n"))), F.lit(0)).alias(f"w{i}") for i, w in enumerate(words)]
    size, held = _all(spark, path, segments, "docs").agg(*of_docs).first(), postings.agg(*have).first()
    n, length, df = size["n"], size["dl"], list(held)
    if gone is not None:
        lost = gone.agg(*of_docs, *[F.count_if(F.array_contains("terms.term", w)).alias(f"w{i}") for i, w in enumerate(words)]).first()
        n, length, df = n - lost["n"], length - lost["dl"], [a - lost[f"w{i}"] for i, a in enumerate(df)]
    if not n or not any(df):
        return empty
    avgdl = length / n
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in zip(words, df, strict=True) if d > 0}
    score = lambda tf, dl: reduce(lambda a, w: F.when(F.col("term") == w, _score(tf, dl, idf[w], avgdl)).otherwise(a), idf, F.lit(0.0))
    bounds = written(postings.filter(F.col("term").isin(list(idf))).groupBy("segment", "block").agg(F.sum(score(F.col("tf"), F.col("dl"))).alias("most")), "index-bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        rows = postings.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        each = rows.select("segment", "term", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p")).select("segment", "term", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        if gone is not None:
            each = each.join(gone.select("key", "segment"), ["key", "segment"], "left_anti")
        parts = each.withColumn("s", score(F.col("tf"), F.col("dl")))
        total = reduce(lambda a, b: a + b, [F.coalesce(F.max(F.when(F.col("term") == w, F.col("s"))), F.lit(0.0)) for w in sorted(idf)])
        return parts.groupBy("key").agg(F.round(total, 6).alias("score"))

    best = bounds.orderBy(F.desc("most"), "segment", "block").limit(first)
    seen = top(scored(best), k, "score", "key").agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    wanted = bounds if seen.n < k else bounds.filter(F.col("most") >= F.lit(seen.least) - 1e-6)
    if told is not None:
        told({"blocks": bounds.count(), "read": wanted.unionByName(best).distinct().count()})
    return top(scored(wanted), k, "score", "key").withColumnRenamed("key", key)

"""Exact nearest rows by sign bits through multi-index hashing: words of a code are lookup keys, and the radius grows until the k nearest are proven.

Index: a row per word of each code (place of the word, word, key, the whole code), partitioned by place and sorted by word.

Search: codes that differ in r bits over m words agree with the query in some word up to r // m bits. So after all words within radius 0, 1, .. t of a query's
have been looked up, every row within m * (t + 1) - 1 bits has been met, and a query whose k-th distance is no greater has its answer. Each round looks up
the words at exactly t bits; a row met through several words counts where its nearest word, the first of equals, is. Words at t
bits are C(WIDTH, t) a word and query; they are shuffled to the rows, never broadcast. Where half of all words would be looked up, the open queries
take one scan instead, so a query far from everything costs no more than that.

Defined cases: empty and null vectors have no code and take no part; vectors of other lengths than the query's are passed over; fewer than k rows give all;
ties go by key; a repeated key is its nearest row; queries with the same id are an error of the caller's; words in a code's last, shorter part are words like others.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vector as V
from tessel.scratch import written

WIDTH = 16
SCAN_SHARE = 0.5


def coded(rows: DataFrame, key: str, vector: str, width: int = WIDTH) -> DataFrame:
    """key, dims, code (words of sign bits) of the rows that have a vector."""
    return rows.filter((F.size(vector) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.size(vector).alias("dims"), V.sign_words(vector, width).alias("code"))


def build(rows: DataFrame, key: str, vector: str, path: str, width: int = WIDTH) -> None:
    """Writes the index: key, dims, code by (place, word)."""
    each = coded(rows, key, vector, width).select("key", "dims", "code", F.posexplode("code").alias("place", "word"))
    each.repartitionByRange("place", "word").sortWithinPartitions("place", "word").write.partitionBy("place").parquet(path)


def masks(width: int, bits: int) -> list[int]:
    """Every word of so many bits."""
    return [sum(1 << i for i in c) for c in combinations(range(width), bits)]


def nearest(index: DataFrame, queries: DataFrame, k: int, width: int = WIDTH, told: list[dict] | None = None) -> DataFrame:
    """query, key, distance, rank: the k nearest rows of each query (query, code, dims). `told` gets a row a round: words looked up, rows met, queries left."""
    asks = written(queries.select("query", F.col("code").alias("asked"), F.col("dims").alias("asked_dims")), "sign-queries")
    found: list[DataFrame] = []
    open_, n_open = asks, asks.count()
    m = asks.agg(F.max(F.size("asked"))).first()[0] or 0
    radius = 0
    while n_open:
        whole = sum(comb(width, b) for b in range(radius + 1)) > SCAN_SHARE * 2**width
        if whole:
            # what is left takes one scan of the codes; queries still open are the few far from everything
            rows = index.filter("place = 0").join(F.broadcast(open_) if n_open <= 10_000 else open_, F.col("dims") == F.col("asked_dims"))
            met = rows.select("query", "key", V.hamming("code", "asked").alias("distance"))
            found = [f.join(open_.select("query"), "query", "left_anti") for f in found]
        else:
            flips = F.array(*[F.lit(x) for x in masks(width, radius)]).cast("array<bigint>")
            words = open_.select("query", "asked", "asked_dims", F.posexplode("asked").alias("at", "w")).withColumn("flip", F.explode(flips)).select("query", "asked", "asked_dims", "at", F.col("w").bitwiseXOR(F.col("flip")).alias("look"))
            # the size that Spark expects of the words is that of the queries, before they were made: it would send millions of them through the driver
            rows = index.join(words.hint("merge"), (F.col("place") == F.col("at")) & (F.col("word") == F.col("look")) & (F.col("dims") == F.col("asked_dims")))
            apart = F.zip_with("code", "asked", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
            first = F.array_position(F.col("apart"), F.array_min("apart")) - 1
            met = rows.select("query", "key", "place", apart.alias("apart")).filter((F.array_min("apart") == radius) & (F.col("place") == first))
            met = met.select("query", "key", F.aggregate("apart", F.lit(0), lambda a, x: a + x).alias("distance"))
        met = written(met, "sign-met")
        found.append(met)
        sure = F.lit(2**31 - 1) if whole else F.lit(m * (radius + 1) - 1)
        best = reduce(DataFrame.unionByName, found).groupBy("query", "key").agg(F.min("distance").alias("distance"))
        enough = best.filter(F.col("distance") <= sure).groupBy("query").agg(F.count("*").alias("n")).filter(F.lit(True) if whole else F.col("n") >= k)
        if told is not None:
            told.append({"radius": radius, "words": comb(width, radius) * m * n_open, "met": met.count(), "queries": n_open})
        if whole:
            break
        open_ = written(open_.join(enough, "query", "left_anti"), "sign-open")
        n_open, radius = open_.count(), radius + 1
    if not found:
        return index.select(F.lit(0).cast(asks.schema["query"].dataType).alias("query"), "key", F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    best = reduce(DataFrame.unionByName, found).groupBy("query", "key").agg(F.min("distance").alias("distance"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key")))
    return ranked.filter(F.col("rank") <= k)


def prefiltered(index: DataFrame, rows: DataFrame, query: list[float], key: str, vector: str, n: int, k: int, rescue: Column | None = None) -> DataFrame:
    """key and exact score of the k best among the n nearest by sign bits and the rows that `rescue` holds for."""
    from tessel.operators.retrieve import search

    spark = rows.sparkSession
    ask = spark.range(1).select(F.col("id").alias("query"), V.sign_words(V.literal(query), WIDTH).alias("code"), F.lit(len(query)).alias("dims"))
    near = nearest(index, ask, n).select(F.col("key").alias(key))
    if rescue is not None:
        near = near.union(rows.filter(rescue).select(key)).distinct()
    return search(rows.join(near, key, "left_semi"), query, key, vector, k)

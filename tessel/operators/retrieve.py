"""Search: exact and prefiltered vector scans, hybrid scores, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions import vector as V


def restricted(rows: DataFrame, source: str, excluded: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Rows outside the excluded sources and, where a scope is given, inside it; both are tables with a column `source`."""
    if excluded is not None:
        rows = rows.join(excluded.select(F.col("source").alias(source)).distinct(), source, "left_anti")
    if scope is not None:
        rows = rows.join(scope.select(F.col("source").alias(source)).distinct(), source, "left_semi")
    return rows


def top(rows: DataFrame, k: int, score: str = "score", order: str = "ord") -> DataFrame:
    """The k best rows, ties by order."""
    return rows.orderBy(F.desc(score), F.asc(order)).limit(k)


def search(rows: DataFrame, query: list[float], key: str, vector: str, k: int, keys: Column | None = None, text: Column | None = None) -> DataFrame:
    """key and score of the k best rows: dot product, plus the weighted keyword score where keys are given. Rows of other dimensions are passed over."""
    score = V.dot(vector, V.literal(query))
    if keys is not None:
        score = score + T.SPARSE_WEIGHT * T.key_score(keys, text)
    return top(rows.filter(F.size(vector) == len(query)).select(key, F.round(score, 6).alias("score")), k, "score", key)


def scored(rows: DataFrame, queries: list[tuple[int, list[float]]], key: str, vector: str) -> DataFrame:
    """(query, key, score) for several query vectors: one scan, a row exploded per query."""
    each = F.array(*[F.struct(F.lit(q).alias("query"), F.round(V.dot(vector, V.literal(v)), 6).alias("score")) for q, v in queries])
    return rows.select(key, F.explode(each).alias("x")).select("x.query", key, "x.score")


def max_union(rows: DataFrame, queries: list[tuple[int, list[float]]], key: str, vector: str, pool: int) -> DataFrame:
    """The pool of best rows by their highest score over all queries; the maximum is taken within the row."""
    if not queries:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    parts = [F.round(V.dot(vector, V.literal(v)), 6) for _, v in queries]
    return top(rows.select(key, (F.greatest(*parts) if len(parts) > 1 else parts[0]).alias("score")), pool, "score", key)


def rrf(lists: DataFrame, key: str, k: int, depth: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query, key, score): the sum of 1 / (constant + rank) over the first depth of each list."""
    ranked = lists.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))).filter(F.col("r") <= depth)
    return top(ranked.groupBy(key).agg(F.round(F.sum(1.0 / (constant + F.col("r"))), 6).alias("score")), k, "score", key)


def hamming_nearest(rows: DataFrame, query: list[float], key: str, vector: str, n: int) -> DataFrame:
    """key and distance of the n rows whose sign bits differ least from the query's, ties by key."""
    return rows.select(key, V.hamming(V.sign_words(vector), V.sign_words(V.literal(query))).alias("distance")).orderBy("distance", key).limit(n)


def prefiltered(rows: DataFrame, query: list[float], key: str, vector: str, n: int, k: int, rescue: Column | None = None) -> DataFrame:
    """Exact scores of the n nearest by sign bits and of the rows that `rescue` holds for."""
    near = hamming_nearest(rows, query, key, vector, n).select(key)
    if rescue is not None:
        near = near.union(rows.filter(rescue).select(key)).distinct()
    return search(rows.join(F.broadcast(near) if rescue is None else near, key, "left_semi"), query, key, vector, k)


def bm25(docs: DataFrame, question: list[str], key: str, tokens: Column, k: int) -> DataFrame:
    """Term scores of distinct question tokens. Their counts are taken within each row, so no postings are made or moved; the driver gets one row: the
    table's size, its mean length and how many documents hold each token."""
    words = sorted(set(question))
    held = lambda t, w: F.size(F.filter(t, lambda x: x == w))
    counted = T.bound(tokens, lambda t: F.struct(F.size(t).alias("dl"), F.array(*[held(t, w) for w in words]).alias("tf")))
    rows = docs.select(key, counted.alias("c")).select(key, "c.dl", "c.tf")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(words))]).first()
    if not stats.n:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    for i in range(len(words)):
        idf, tf = F.log(1 + (F.lit(stats.n) - stats[f"df{i}"] + 0.5) / F.lit(stats[f"df{i}"] + 0.5)), F.col("tf")[i]
        score = score + idf * tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * F.col("dl") / F.lit(stats.avgdl)))
    met = rows.filter(F.exists("tf", lambda n: n > 0))
    return top(met.select(key, F.round(score, 6).alias("score")), k, "score", key)


def exact_boost(question: Column, text: Column, weight: float = 3.0) -> Column:
    """weight for every key of the question that the text holds: article labels and runs of three letters or digits, both folded."""
    q = T.norm_search(question)
    keys = F.concat(F.regexp_extract_all(q, F.lit("第[0-9]+条(?:の[0-9]+)?"), F.lit(0)), F.regexp_extract_all(F.regexp_replace(q, "第[0-9]+条(?:の[0-9]+)?", " "), F.lit("[0-9a-z]{3,}"), F.lit(0)))
    return T.bound(T.norm_search(text), lambda t: F.size(F.filter(keys, lambda k: F.contains(t, k))) * F.lit(weight))


def page_hit(questions: DataFrame, ranked: DataFrame, gold: DataFrame, key: str = "item_id", depth: int = 5) -> DataFrame:
    """page_hit: the share of questions with a row of the gold source within one page of the gold page among the first `depth`; ranked has source, page, rank, gold has gold, gold_page."""
    near = ranked.filter(F.col("rank") <= depth).join(gold, key).filter((F.col("source") == F.col("gold")) & (F.abs(F.col("page") - F.col("gold_page")) <= 1)).select(key).distinct()
    met = questions.join(near.withColumn("_hit", F.lit(1.0)), key, "left")
    return met.agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("page_hit"))


def recall(ranks: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Recall at each cut and mean reciprocal rank of a column `rank`, null where the answer was not found."""
    at = [F.avg(F.when(F.col("rank") <= c, 1.0).otherwise(0.0)).alias(f"recall_{c}") for c in cuts]
    return ranks.agg(F.count("*").alias("questions"), *at, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))

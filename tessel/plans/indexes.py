"""Queries over persisted indexes, links by pivots, and neighbours in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions import vector as V
from tessel.operators import index, links, rank, signs
from tessel.plans.base import query, table
from tessel.plans.documents import FOLD
from tessel.plans.vectors import SIGNS
from tessel.scratch import folder

WORDS = ["apache", "license", "version", "work", "license"]


def term_score(rows: str) -> str:
    """SQL of the 20 best of a table of (doc_id, text) by the term score."""
    return f"""WITH d AS ({rows}), t AS (SELECT doc_id, regexp_extract_all({FOLD}, '[0-9a-z]+') AS t FROM d), n AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM t),
    p AS (SELECT doc_id, len(t) AS dl, w, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS w FROM t) WHERE w IN ('apache', 'license', 'work', 'version') GROUP BY ALL),
    f AS (SELECT w, count(*) AS df FROM p GROUP BY w)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM p JOIN f USING (w), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@query(term_score("SELECT doc_id, text FROM documents"))
def bm25_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "index")
    index.build(table(spark, sf_dir, "documents"), "doc_id", T.tokens("text"), at)
    return index.search(spark, at, WORDS, 20, "doc_id")


CHANGED = "CASE WHEN doc_id % 7 = 0 THEN text || ' apache license apache' WHEN doc_id % 7 = 1 THEN 'work version ' || doc_id ELSE text END"


@query(term_score(f"SELECT doc_id, {CHANGED} AS text FROM documents WHERE doc_id % 7 <> 2"))
def bm25_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents but some, then updated by changed, new and removed ones."""
    docs, at, i = table(spark, sf_dir, "documents"), folder(spark, "index"), F.col("doc_id") % 7
    index.build(docs.filter(i != 3), "doc_id", T.tokens("text"), at)
    changed = docs.withColumn("text", F.when(i == 0, F.concat("text", F.lit(" apache license apache"))).otherwise(F.concat(F.lit("work version "), F.col("doc_id").cast("string"))))
    index.update(at, changed.filter(i < 2), "doc_id", T.tokens("text"), removed=docs.filter(i == 2))
    index.update(at, docs.filter(i == 3), "doc_id", T.tokens("text"))
    return index.search(spark, at, WORDS, 20, "doc_id")


@query(term_score(f"SELECT doc_id, {CHANGED} AS text FROM documents WHERE doc_id % 7 <> 2"))
def bm25_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after all segments were folded into one."""
    docs, at, i = table(spark, sf_dir, "documents"), folder(spark, "index"), F.col("doc_id") % 7
    index.build(docs, "doc_id", T.tokens("text"), at)
    changed = docs.withColumn("text", F.when(i == 0, F.concat("text", F.lit(" apache license apache"))).otherwise(F.concat(F.lit("work version "), F.col("doc_id").cast("string"))))
    index.update(at, changed.filter(i < 2), "doc_id", T.tokens("text"), removed=docs.filter(i == 2))
    index.compact(spark, at)
    return index.search(spark, at, WORDS, 20, "doc_id")


def sign_index(spark: SparkSession, rows: DataFrame) -> DataFrame:
    at = folder(spark, "signs")
    signs.build(rows, "vec_id", "embedding", at)
    return spark.read.parquet(at)


@query(f"SELECT e.vec_id, {SIGNS} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 50")
def hamming_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = signs.coded(e.filter("vec_id = 0"), "vec_id", "embedding").withColumnRenamed("key", "query")
    return signs.nearest(sign_index(spark, e), asked, 50).select(F.col("key").alias("vec_id"), "distance")


@query(
    f"""WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, e.vec_id AS vec_id, {SIGNS} AS distance FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id)::INTEGER AS rank FROM s) SELECT query, vec_id, distance, rank FROM r WHERE rank <= 10"""
)
def hamming_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = signs.coded(e.filter("vec_id % 50 = 0"), "vec_id", "embedding").withColumnRenamed("key", "query")
    return signs.nearest(sign_index(spark, e), asked, 10).select("query", F.col("key").alias("vec_id"), "distance", "rank")


DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    f"""WITH c AS (SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {SIGNS}, vec_id LIMIT 200),
    u AS (SELECT vec_id FROM c UNION SELECT vec_id FROM embeddings WHERE label = 3)
    SELECT e.vec_id, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id IN (SELECT vec_id FROM u) ORDER BY score DESC, vec_id LIMIT 10"""
)
def prefilter_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = list(e.filter("vec_id = 0").select("embedding").first()[0])
    return signs.prefiltered(sign_index(spark, e), e, first, "vec_id", "embedding", 200, 10, F.col("label") == 3)


CHAPTERS = """v AS (SELECT label * 1000 + vec_id % 23 AS chap, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT chap, i, avg(x) AS m FROM v GROUP BY chap, i),
    n AS (SELECT chap, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS norm FROM m GROUP BY chap), s AS (SELECT a.chap AS a, b.chap AS b, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 5) AS sim FROM n a, n b WHERE a.chap <> b.chap),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("chap", F.col("label") * 1000 + F.col("vec_id") % 23)
    return links.centroids(e, ["chap"], "embedding", None)


@query(f"WITH {CHAPTERS} SELECT a, b, sim FROM r WHERE rn <= 3")
def chapter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.nearest_by_pivots(chapters(spark, sf_dir), "chap", "centroid", 3, 5)


@query(f"WITH {CHAPTERS} SELECT a, b, sim FROM r WHERE rn <= 3 AND sim >= 0.4")
def chapter_links_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.nearest_by_pivots(chapters(spark, sf_dir), "chap", "centroid", 3, 5, least=40)


@query(
    """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s WHERE sim >= 0.4) SELECT a, b, sim FROM r WHERE rn <= 5"""
)
def vector_links_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("unit"))
    return links.nearest_by_pivots(e, "vec_id", "unit", 5, 6, least=40)


@query(
    """WITH w AS (SELECT *, max((doc_id % 97 = 5)::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM documents)
    SELECT doc_id, source FROM w WHERE near = 1 AND doc_id % 97 <> 5"""
)
def neighbours_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rank.neighbours_in_parts(d, F.col("doc_id") % 97 == 5, "source", ["doc_id"], 2, 64)

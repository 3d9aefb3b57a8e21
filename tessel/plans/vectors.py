"""Vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import vector as V
from tessel.operators import links, rank, retrieve
from tessel.plans.base import query, table

DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def vectors_of(e: DataFrame, ids: tuple[int, ...]) -> list[tuple[int, list[float]]]:
    """The query vectors: a row each, fetched by id."""
    found = {r.vec_id: [float(x) for x in r.embedding] for r in e.filter(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()}
    return [(i, found[i]) for i in ids if i in found]


@query(f"SELECT e.vec_id, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieve.search(e, vectors_of(e, (0,))[0][1], "vec_id", "embedding", 10)


@query(f"SELECT e.vec_id, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label NOT IN (SELECT label FROM embeddings WHERE vec_id IN (1, 2)) ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    excluded = e.filter("vec_id in (1, 2)").select(F.col("label").alias("source"))
    return retrieve.search(retrieve.restricted(e, "label", excluded=excluded), vectors_of(e, (0,))[0][1], "vec_id", "embedding", 10)


@query(f"SELECT e.vec_id, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (SELECT label FROM embeddings WHERE vec_id IN (1, 2, 3)) ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    scope = e.filter("vec_id in (1, 2, 3)").select(F.col("label").alias("source"))
    return retrieve.search(retrieve.restricted(e, "label", scope=scope), vectors_of(e, (0,))[0][1], "vec_id", "embedding", 10)


@query(f"SELECT e.vec_id, max(round({DOT}, 6)) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id IN (0, 1, 2)) q GROUP BY e.vec_id ORDER BY score DESC, vec_id LIMIT 40")
def vec_multi_max_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieve.max_union(e, vectors_of(e, (0, 1, 2)), "vec_id", "embedding", 40)


@query(
    f"""WITH s AS (SELECT q.vec_id AS query, e.vec_id, round({DOT}, 6) AS score FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (0, 1, 2)) q),
    r AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s)
    SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM r WHERE r <= 100 GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 20"""
)
def vec_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    lists = retrieve.scored(e, vectors_of(e, (0, 1, 2)), "vec_id", "embedding")
    return retrieve.rrf(lists, "vec_id", 20, 100)


SIGNS = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CASE WHEN (e.embedding[i] >= 0) <> (q.embedding[i] >= 0) THEN 1 ELSE 0 END))::INTEGER"


@query(f"SELECT e.vec_id, {SIGNS} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 50")
def vec_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieve.hamming_nearest(e, vectors_of(e, (0,))[0][1], "vec_id", "embedding", 50)


@query(
    f"""WITH c AS (SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {SIGNS}, vec_id LIMIT 200),
    u AS (SELECT vec_id FROM c UNION SELECT vec_id FROM embeddings WHERE label = 3)
    SELECT e.vec_id, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id IN (SELECT vec_id FROM u) ORDER BY score DESC, vec_id LIMIT 10"""
)
def vec_prefilter_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieve.prefiltered(e, vectors_of(e, (0,))[0][1], "vec_id", "embedding", 200, 10, F.col("label") == 3)


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"))


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.cosine("embedding", V.literal(vectors_of(e, (0,))[0][1])), 5).alias("cosine"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])), 5) AS first FROM embeddings")
def vec_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.truncated("embedding", 32)[0], 5).alias("first"))


@query("SELECT vec_id, count(*) FILTER (x < 0) AS negative, round(sum(x::DOUBLE), 5) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def vec_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.from_csv(V.to_csv("embedding", 9))
    back = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return back.select("vec_id", F.size(F.filter("v", lambda x: x < 0)).cast("long").alias("negative"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT len(embedding)::INTEGER AS dim, count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS rejected FROM embeddings GROUP BY 1")
def vec_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("dim"))
    return e.groupBy("dim").agg(F.count("*").alias("vectors"), F.count_if(F.col("dim") != 64).alias("rejected"))


CENTROIDS = """c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
    n AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS norm FROM c GROUP BY label)"""


@query(f"WITH {CENTROIDS} SELECT n.label, unnest(list_transform(n.v, lambda x: round(x / n.norm, 5))) AS value, generate_subscripts(n.v, 1)::INTEGER - 1 AS pos FROM n")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = links.centroids(table(spark, sf_dir, "embeddings"), ["label"], "embedding", 5)
    return c.select("label", F.posexplode("centroid").alias("pos", "value"))


@query(
    f"""WITH {CENTROIDS}, s AS (SELECT a.label AS a, b.label AS b, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 5) AS sim FROM n a, n b WHERE a.label <> b.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s) SELECT a, b, sim FROM r WHERE rn <= 3"""
)
def label_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = links.centroids(table(spark, sf_dir, "embeddings"), ["label"], "embedding", None)
    return links.nearest_centroids(c, "label", "centroid", 3, 5)


@query()
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def kmeans_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return links.majority(links.kmeans(e, "vec_id", "embedding").join(e.select("vec_id", F.col("label").alias("source")), "vec_id"), "source", "cluster")


@query(
    f"""WITH s AS (SELECT e.vec_id, e.label, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 40),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s)
    SELECT vec_id, label, score, row_number() OVER (ORDER BY (rn > 1)::INT, CASE WHEN rn = 1 THEN -score END, vec_id)::INTEGER AS place FROM r"""
)
def hits_diversity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    hits = retrieve.search(e, vectors_of(e, (0,))[0][1], "vec_id", "embedding", 40).join(e.select("vec_id", "label"), "vec_id")
    return rank.diversity_order(hits, "label", "score", "vec_id").select("vec_id", "label", "score", "place")


@query(
    f"""WITH s AS (SELECT e.vec_id, e.label, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    m AS (SELECT label, max(score) AS m FROM s GROUP BY label), t AS (SELECT list(m ORDER BY m DESC) AS b, count(*) AS sources FROM m)
    SELECT sources, CASE WHEN sources >= 2 AND b[1] > 0 THEN round_even((b[1] - b[2]) / b[1] * 100, 0)::BIGINT ELSE -1 END AS gap FROM t"""
)
def hits_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    s = e.select(F.lit(0).alias("g"), F.col("label").cast("string").alias("source"), F.round(V.dot("embedding", V.literal(vectors_of(e, (0,))[0][1])), 6).alias("score"))
    return rank.dispersion(s, ["g"]).select("sources", "gap")


@query(
    f"""WITH s AS (SELECT e.vec_id, round({DOT}, 6) AS score, row_number() OVER (ORDER BY round({DOT}, 6) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 24)
    SELECT vec_id, score, rank::INTEGER AS rank FROM s ORDER BY (vec_id % 3 = 0)::INT, rank LIMIT 12"""
)
def hits_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    hits = retrieve.search(e, vectors_of(e, (0,))[0][1], "vec_id", "embedding", 24).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return rank.demoted(hits, F.col("vec_id") % 3 == 0, 12)

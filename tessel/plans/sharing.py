"""Queries on sharing, synchronisation and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import decide as D
from tessel.functions import text as T
from tessel.operators import ingest, rank, sets
from tessel.plans.base import query, table


@query(
    """WITH m AS (SELECT 'doc' || doc_id AS n, n_chars + CASE WHEN doc_id % 10 = 1 THEN 5 ELSE 0 END AS size, doc_id % 10 AS r FROM documents WHERE doc_id % 10 <> 0),
    l AS (SELECT 'doc' || doc_id AS n, n_chars AS size FROM documents WHERE doc_id % 10 <> 9)
    SELECT coalesce(l.n, m.n) AS file_name, CASE WHEN m.n IS NULL THEN 'ingest' WHEN l.n IS NULL THEN 'missing' WHEN l.size <> m.size OR m.r IN (2, 3) OR m.r = 4 THEN 'replace' ELSE 'keep' END AS decision FROM l FULL JOIN m ON l.n = m.n"""
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_name"), "n_chars", (F.col("doc_id") % 10).alias("r"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    listed = d.filter("r <> 9").select("file_name", F.col("n_chars").alias("size"), at.alias("modified_at"))
    moved = F.when(F.col("r") == 2, at + F.expr("INTERVAL 10 SECONDS")).otherwise(at + F.expr("INTERVAL 1 SECOND"))
    status = F.when(F.col("r") == 3, "failed").when(F.col("r") == 4, "missing").otherwise("done")
    manifest = d.filter("r <> 0").select("file_name", (F.col("n_chars") + F.when(F.col("r") == 1, 5).otherwise(0)).alias("size"), moved.alias("modified_at"), status.alias("status"))
    return ingest.manifest_diff(listed, manifest)


@query(
    """SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS held, coalesce(b.n, 0) AS ledger, coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees
    FROM (SELECT source, count(*) AS n FROM documents WHERE lang <> 'es' GROUP BY source) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY source) b ON a.source = b.source"""
)
def ledger_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return sets.reconciled(d.filter("lang <> 'es'"), d.filter("lang <> 'fr'"), "source")


@query("WITH o AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Src:' || lang WHEN 1 THEN ' src:' || upper(lang) WHEN 2 THEN 'SRC:' || source WHEN 3 THEN 'src:' ELSE 'self' END AS o FROM documents), p AS (SELECT doc_id, substring(trim(o, ' '), 5) AS name FROM o WHERE lower(trim(o, ' ')) LIKE 'src:_%') SELECT min_by(name, doc_id) AS origin, count(*) AS n, min(doc_id) AS first FROM p GROUP BY lower(name)")
def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 5
    origin = F.when(i == 0, F.concat(F.lit("Src:"), "lang")).when(i == 1, F.concat(F.lit(" src:"), F.upper("lang"))).when(i == 2, F.concat(F.lit("SRC:"), "source")).when(i == 3, "src:").otherwise("self")
    return sets.counts_by_prefix(table(spark, sf_dir, "documents").select("doc_id", origin.alias("origin")), "origin", "src:", "doc_id")


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') AND lang <> 'en'")
def new_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("hash"))
    return sets.new_rows(d.filter("lang <> 'en'"), d.filter("lang = 'en'"), ["hash"]).select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def cascade_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("vec_id"))
    return sets.new_rows(table(spark, sf_dir, "embeddings").select("vec_id"), gone, ["vec_id"])


@query("SELECT source FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def sources_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter("lang = 'fr'").select("source").intersect(d.filter("lang = 'de'").select("source"))


@query("SELECT user_id, array_to_string(list_slice(l, 1, 3), ',') AS recent FROM (SELECT user_id, list(event_type ORDER BY last DESC, event_type) AS l FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL) GROUP BY user_id)")
def recent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return sets.most_recent(e, "user_id", "event_type", "last", 3).select("user_id", F.array_join("recent", ",").alias("recent"))


@query("SELECT page_id, lower(url) LIKE '%spam%' OR lower(url) LIKE '%casino%' AS named FROM pages")
def mentions_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", sets.mentions(F.col("url"), ["spam", "casino"]).alias("named"))


@query(
    """WITH s AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), c AS (SELECT *, len(regexp_extract_all(text, '[?？]')) AS marks, len(list_filter(regexp_split_to_array(text, '[。.!！?？\\n]'), lambda x: trim(x, ' ') <> '')) AS sentences FROM s)
    SELECT conv_id, turn, marks >= 2 OR sentences >= 2 AS compound, conv_id % 3 <> 0 AND (conv_id % 3 = 1 OR length(text) >= 25 OR marks >= 2 OR sentences >= 2) AS decompose FROM c"""
)
def question_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").filter("role = 'user'")
    mode = F.when(F.col("conv_id") % 3 == 0, "off").when(F.col("conv_id") % 3 == 1, "always").otherwise("auto")
    return q.select("conv_id", "turn", T.compound_signal("text").alias("compound"), D.decompose_gate(mode, F.col("text")).alias("decompose"))


@query("SELECT o_orderkey, list_aggregate(list_distinct(list_filter([o_orderkey % 5 + 1, o_custkey % 7 + 1, 99, o_orderkey % 3 + 1], lambda x: x <= 6)), 'sum')::BIGINT AS total FROM orders")
def explicit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    part = lambda c, m: (F.col(c) % m + 1).cast("string")
    response = F.concat_ws(",", part("o_orderkey", 5), part("o_custkey", 7), F.lit("99"), F.lit("x"), part("o_orderkey", 3))
    order = rank.explicit_order(response, F.lit(6))
    return o.select("o_orderkey", F.aggregate(order, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    """WITH s AS (SELECT doc_id AS id, source, n_chars::DOUBLE AS score FROM documents), h AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE source = 'src0' QUALIFY rank <= 6),
    low AS (SELECT min(score) AS low FROM h), b AS (SELECT s.id, s.source, s.score, 6 AS rank FROM s, low WHERE s.source <> 'src0' AND low > 0 AND s.score / low * 100 >= 70 ORDER BY s.score DESC, s.id LIMIT 1)
    SELECT id, source, score, rank::INTEGER AS rank FROM h WHERE rank NOT IN (SELECT rank FROM b) UNION ALL SELECT id, source, score, rank::INTEGER FROM b"""
)
def hits_diversity_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").cast("double").alias("score"))
    top = s.filter("source = 'src0'").orderBy(F.desc("score"), "id").limit(6)
    hits = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return rank.diversity_swap(hits, s, 70)


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000")
def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.filter("c_acctbal > 5000").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    """WITH m AS (SELECT q.conv_id, q.turn, m.conv_id AS memo, CASE WHEN q.key = m.key THEN 2 END AS level FROM (SELECT conv_id, turn, lower(regexp_replace(text, '[ 　\\t\\r\\n、。，．,.?？!！「」・]', '', 'g')) AS key FROM conversations WHERE role = 'user') q
    JOIN (SELECT conv_id, lower(regexp_replace(text, '[ 　\\t\\r\\n、。，．,.?？!！「」・]', '', 'g')) AS key FROM conversations WHERE role = 'user' AND turn = 0) m ON q.key = m.key)
    SELECT conv_id, turn, max(memo) AS memo, 2 AS level FROM m GROUP BY conv_id, turn"""
)
def memo_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text", T.question_key("text", None).alias("key"))
    memo = q.filter("turn = 0").groupBy("key").agg(F.max(F.struct("conv_id", F.col("text").alias("question"))).alias("m"))
    return q.join(memo, "key").select("conv_id", "turn", F.col("m.conv_id").alias("memo"), D.memo_level(F.col("text"), F.col("m.question")).alias("level"))


@query("SELECT doc_id, quality, toxic FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 AND quality = 1")
def accepted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 0 and quality = 1").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "quality", "toxic")

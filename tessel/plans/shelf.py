"""Queries over the shelf, with documents as chunks and embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import decide as D
from tessel.operators import expand, shelf
from tessel.plans.base import query, table
from tessel.plans.documents import PART
from tessel.plans.vectors import vectors_of

KEYS2 = "['license', 'apache']"


def knowledge_(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "source", F.lit(1).alias("page"), F.lit("").alias("summary"), F.lit("").alias("keywords"), F.col("text").alias("full_text"), F.lit(None).cast("string").alias("norm_text"), F.col("doc_id").alias("ord"))


def vectors_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


HYBRID = f"""k AS (SELECT doc_id, source, text, CASE WHEN raw > 0 THEN least(3.0, raw / (1 + ln(1 + length(c) / 900.0::DOUBLE))) ELSE 0 END AS ks FROM
    (SELECT *, {PART.format(keys=KEYS2)} AS raw FROM (SELECT doc_id, source, text, replace(translate(source || text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz '), ' ', '') AS c FROM documents)))"""


@query(
    f"""WITH {HYBRID} SELECT k.doc_id AS chunk_id, source, 1 AS page, substring(text, 1, 120) AS preview, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 0.06::DOUBLE * ks, 6) AS score
    FROM k JOIN embeddings e ON e.vec_id = k.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, chunk_id LIMIT 16"""
)
def shelf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors_of(table(spark, sf_dir, "embeddings"), (0,))[0][1]
    return shelf.search(vectors_(spark, sf_dir), knowledge_(spark, sf_dir), q, "license: apache", 16)


@query(
    f"""WITH {HYBRID}, s AS (SELECT k.doc_id AS chunk_id, source, 1 AS page, max(round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 0.06::DOUBLE * ks, 6)) AS score
    FROM k JOIN embeddings e ON e.vec_id = k.doc_id, (SELECT embedding FROM embeddings WHERE vec_id IN (0, 1)) q WHERE source <> 'src0' GROUP BY ALL) SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 40"""
)
def shelf_multi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = [("license: apache", v) for _, v in vectors_of(table(spark, sf_dir, "embeddings"), (0, 1))] + [("no vector", None)]
    excluded = spark.createDataFrame([("src0",)], "source string")
    return shelf.multi_search(vectors_(spark, sf_dir), knowledge_(spark, sf_dir), qs, 40, excluded=excluded)


@query(
    f"""WITH {HYBRID}, s AS (SELECT k.doc_id AS chunk_id, source, 1 AS page, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 0.06::DOUBLE * ks, 6) AS score
    FROM k JOIN embeddings e ON e.vec_id = k.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, chunk_id LIMIT 40),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS n FROM s), o AS (SELECT *, CASE n WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 9 THEN 2 END AS p FROM r)
    SELECT chunk_id, source, page, score, row_number() OVER (ORDER BY p NULLS LAST, n)::INTEGER AS rank FROM o QUALIFY rank <= 12"""
)
def shelf_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors_of(table(spark, sf_dir, "embeddings"), (0,))[0][1]
    return shelf.retrieved(vectors_(spark, sf_dir), knowledge_(spark, sf_dir), "license: apache", [("license: apache", q)], 12, order="5, 3, 5, x, 9, 77").select("chunk_id", "source", "page", "score", "rank")


@query(
    f"""WITH {HYBRID}, s AS (SELECT k.doc_id AS chunk_id, source, 1 AS page, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 0.06::DOUBLE * ks, 6) AS score
    FROM k JOIN embeddings e ON e.vec_id = k.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE source IN ('src1', 'src2') ORDER BY score DESC, chunk_id LIMIT 40),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s), h AS (SELECT * FROM r WHERE rank <= 2),
    o AS (SELECT r.* FROM r, (SELECT count(DISTINCT source) AS n, min(source) AS one, min(score) AS low FROM h) x WHERE x.n = 1 AND r.source <> x.one AND x.low > 0 AND r.score / x.low * 100 >= 10 ORDER BY r.score DESC, r.chunk_id LIMIT 1)
    SELECT chunk_id, source, page, score, rank FROM h WHERE rank < 2 OR NOT EXISTS (SELECT 1 FROM o) UNION ALL SELECT chunk_id, source, page, score, 2 FROM o"""
)
def shelf_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits from two sources, asked with a synonym of what the texts hold; where both are of one source the second gives way."""
    q = vectors_of(table(spark, sf_dir, "embeddings"), (0,))[0][1]
    pairs = spark.createDataFrame([("apache", ":license", 1)], "term string, canonical string, ord int")
    scope = spark.createDataFrame([("src1",), ("src2",)], "source string")
    hits = shelf.retrieved(vectors_(spark, sf_dir), knowledge_(spark, sf_dir), "apache", [("apache", q)], 2, synonyms=pairs, diversify=10, scope=scope)
    return hits.select("chunk_id", "source", "page", "score", "rank")


@query(f"WITH {HYBRID} SELECT doc_id AS chunk_id, source, round(0.06::DOUBLE * ks, 6) AS score FROM k WHERE ks > 0 ORDER BY score DESC, chunk_id LIMIT 12")
def shelf_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No query has a vector: keywords alone decide."""
    return shelf.retrieved(vectors_(spark, sf_dir), knowledge_(spark, sf_dir), "license: apache", [("license: apache", None)], 12).select("chunk_id", "source", "score")


@query(
    """WITH c AS (SELECT doc_id AS chunk_id, source, doc_id % 50 AS page, doc_id AS seq, row_number() OVER (PARTITION BY source ORDER BY doc_id % 50, doc_id) AS n FROM documents),
    h AS (SELECT * FROM c WHERE chunk_id % 97 = 5), x AS (SELECT DISTINCT c.chunk_id, c.source, c.page, c.seq FROM c JOIN h ON c.source = h.source AND abs(c.n - h.n) <= 2 WHERE c.chunk_id % 97 <> 5)
    SELECT chunk_id, source FROM x ORDER BY source, page, seq LIMIT 80"""
)
def hit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", (F.col("doc_id") % 50).alias("page"), F.col("doc_id").alias("seq"))
    return expand.neighbours(c, c.filter("chunk_id % 97 = 5"), 2).select("chunk_id", "source")


META = "m AS (SELECT doc_id AS chunk_id, source, '第' || (doc_id % 9) || '条' AS path, ['第' || (doc_id % 7) || '条', '第' || (doc_id % 9) || '条'] AS refs, doc_id AS ord FROM documents)"


def meta_(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda m: F.concat(F.lit("第"), (F.col("doc_id") % m).cast("string"), F.lit("条"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", label(9).alias("section_path"), F.array(label(7), label(9)).alias("refs"), F.col("doc_id").alias("ord"))


@query(
    f"""WITH {META}, h AS (SELECT * FROM m WHERE chunk_id IN (3, 40, 77)), l AS (SELECT DISTINCT r AS label FROM (SELECT path, unnest(refs) AS r FROM h) WHERE NOT contains(path, r))
    SELECT chunk_id, source, path AS section_path FROM m WHERE source IN (SELECT source FROM h) AND chunk_id NOT IN (3, 40, 77) AND EXISTS (SELECT 1 FROM l WHERE contains(m.path, l.label)) ORDER BY ord LIMIT 8"""
)
def hit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta_(spark, sf_dir)
    return expand.by_references(m, m.filter("chunk_id in (3, 40, 77)")).select("chunk_id", "source", "section_path")


@query(f"WITH {META}, h AS (SELECT 10 AS chunk_id, 1 AS rank UNION ALL SELECT 11, 2), a AS (SELECT chunk_id, row_number() OVER (ORDER BY ord) AS n FROM m WHERE contains(path, '第4条') ORDER BY ord LIMIT 2) SELECT chunk_id, (n - 2)::INTEGER AS rank FROM a UNION ALL SELECT chunk_id, rank FROM h")
def article_ensured(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.createDataFrame([(10, 1), (11, 2)], "chunk_id long, rank int")
    return expand.article_ensured(meta_(spark, sf_dir), hits, "第4条はどう定める")


@query(
    """WITH p AS (SELECT doc_id AS chunk_id, source, lang AS chap, doc_id AS ord FROM documents), h AS (SELECT *, row_number() OVER (ORDER BY chunk_id) AS rank FROM p WHERE chunk_id IN (1, 2, 3)),
    l AS (SELECT a.source AS src_a, a.chap AS chap_a, 'src' || ((substring(a.source, 4)::INT + 1) % 20) AS src_b, 'en' AS chap_b, 0.9::DOUBLE AS sim FROM (SELECT DISTINCT source, chap FROM p) a),
    s AS (SELECT * FROM h WHERE rank <= 2), t AS (SELECT src_b, chap_b, max(sim) AS sim FROM l WHERE (src_a, chap_a) IN (SELECT (source, chap) FROM s) AND src_b NOT IN (SELECT source FROM s) GROUP BY ALL ORDER BY sim DESC, src_b, chap_b LIMIT 2)
    SELECT chunk_id, source, chap, 0.0::DOUBLE AS score FROM p JOIN t ON p.source = t.src_b AND p.chap = t.chap_b WHERE chunk_id NOT IN (1, 2, 3) ORDER BY sim DESC, ord LIMIT 2"""
)
def linked_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("chap"), F.col("doc_id").alias("ord"))
    hits = p.filter("chunk_id in (1, 2, 3)").withColumn("rank", F.row_number().over(Window.orderBy("chunk_id")))
    links = p.select("source", "chap").distinct().select(F.col("source").alias("src_a"), F.col("chap").alias("chap_a"), F.expr("concat('src', (cast(substring(source, 4) as int) + 1) % 20)").alias("src_b"), F.lit("en").alias("chap_b"), F.lit(0.9).alias("sim"))
    return expand.linked(p, hits, links)


@query(
    """WITH c AS (SELECT source, lang AS chap, doc_id AS ord, n_chars AS len FROM documents WHERE (source, lang) IN (('src0', 'en'), ('src1', 'en'), ('src2', 'de'))),
    b AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY source, chap ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT source, chap, ord, greatest(least(len, 20000 - before), 0)::BIGINT AS taken FROM b WHERE greatest(least(len, 20000 - before), 0) > 0"""
)
def chapter_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("chap"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("len"))
    picks = spark.createDataFrame([("src0", "en", 1), ("src1", "en", 2), ("src2", "de", 3)], "source string, chap string, ord int")
    return expand.chapter_hits(c, picks, 60000, 5000).select("source", "chap", "ord", "taken")


@query()
def chapter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("Part "), F.floor(F.col("doc_id") / 40).cast("string"), F.lit(">x")).alias("section_path"), F.col("doc_id").alias("ord"))
    return expand.chapter_groups(d)


@query("SELECT source FROM (SELECT source, min(doc_id) AS r FROM documents WHERE source NOT LIKE 'src1%' GROUP BY source ORDER BY r LIMIT 4)")
def hit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("source not like 'src1%'").select("source", F.col("doc_id").alias("rank"))
    return expand.hit_sources(d).select("source")


@query("SELECT source, chunks, chapters FROM (SELECT source, count(*) AS chunks, count(*) FILTER (lang = 'en') AS meta, greatest(1, least(60, count(*) // 3))::INTEGER AS chapters FROM documents GROUP BY source) WHERE meta < chunks OR source <> 'src0'")
def legacy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = knowledge_(spark, sf_dir)
    meta = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return shelf.legacy_documents(k, meta, spark.createDataFrame([("src0",)], "source string")).select("source", "chunks", "chapters")


@query("WITH e AS (SELECT strftime(ts, 'sv:d:%Y%m%d') AS key FROM events WHERE event_type = 'purchase' UNION ALL SELECT strftime(ts, 'sv:m:%Y%m') FROM events WHERE event_type = 'purchase' UNION ALL SELECT strftime(ts, 'sv:y:%Y') FROM events WHERE event_type = 'purchase') SELECT key, count(*) * 15 AS minutes FROM e GROUP BY key")
def solved_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.solved(table(spark, sf_dir, "events").filter("event_type = 'purchase'"), "ts")


@query("WITH c AS (SELECT 'ask:' || user_id AS key, count(*) AS value FROM events WHERE event_type = 'view' GROUP BY 1), d AS (SELECT 'ask:' || user_id AS key, sum(event_id % 3)::BIGINT AS d FROM events WHERE event_type = 'error' GROUP BY 1) SELECT coalesce(c.key, d.key) AS key, coalesce(value, 0) + coalesce(d, 0) AS value FROM c FULL JOIN d ON c.key = d.key")
def counters_bumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.concat(F.lit("ask:"), F.col("user_id").cast("string")))
    return shelf.bumped(e.filter("event_type = 'view'").groupBy("key").agg(F.count("*").alias("value")), e.filter("event_type = 'error'").select("key", (F.col("event_id") % 3).alias("delta")))


@query("SELECT substring(key, 7) AS source FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'noise:' ELSE 'gexcl:' END || source AS key, doc_id % 3 AS value FROM documents) WHERE value >= 1 GROUP BY 1")
def noise_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    stats = d.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "noise:").otherwise("Gexcl:"), "source").alias("key"), (F.col("doc_id") % 3).cast("string").alias("value"))
    return shelf.noise_sources(stats)


@query("SELECT source FROM (SELECT DISTINCT source FROM documents WHERE contains(lower(source), 'c1')) ORDER BY source LIMIT 4 OFFSET 4")
def gallery_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.gallery(table(spark, sf_dir, "documents"), "C1", 1, 4)


@query(
    """WITH a AS (SELECT l AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE lang = 'en') GROUP BY 1), b AS (SELECT l AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE lang <> 'en') GROUP BY 1)
    SELECT md5(coalesce(a.line, b.line)) AS line, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS removed, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added FROM a FULL JOIN b ON a.line = b.line WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
)
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return shelf.line_diff(d.filter("lang = 'en'"), d.filter("lang <> 'en'")).withColumn("line", F.md5("line"))


def _case(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


@query(
    """SELECT event_id, greatest(0, CASE WHEN event_id % 200 <= 0 THEN 0 ELSE least(round_even(100.0::DOUBLE * (event_id % 200) / 150, 0), 100) END)::BIGINT AS used,
    CASE event_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 12 ELSE 6 END AS k, greatest((event_id % 5000) // greatest(event_id % 7, 1), 100)::BIGINT AS cap,
    CASE WHEN event_id % 11 > 4 THEN ((event_id % (event_id % 11)) * 4) % (event_id % 11) ELSE 0 END AS rotation,
    CASE WHEN event_id % 4 = 0 THEN 'ingest' WHEN event_id % 5 = 0 OR event_id % 6 = 0 THEN 'replace' WHEN event_id % 7 = 0 THEN 'replace' ELSE 'keep' END AS decision,
    CASE WHEN event_id % 3 <> 0 THEN 'go' WHEN event_id % 40 >= 30 THEN 'stale' ELSE 'wait' END AS lock FROM events"""
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    mode = F.when(i % 3 == 0, "thorough").when(i % 3 == 1, "deep").otherwise("quick")
    known = i % 4 != 0
    decision = D.resolved(D.diff_decision(known, i % 5 == 0, i % 6 == 0), known, F.when(i % 7 == 0, "failed").otherwise("done"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        D.usage_percent(i % 200, F.lit(150)).alias("used"),
        D.top_k(mode).alias("k"),
        D.per_chapter_cap(i % 5000, i % 7, F.lit(100)).cast("long").alias("cap"),
        D.rotation_start(i % 11, F.lit(4), i).alias("rotation"),
        decision.alias("decision"),
        D.lock_action(i % 3 == 0, i % 40, F.lit(30)).alias("lock"),
    )


@query("SELECT conv_id, turn, length(trim(text, ' ')) <= 10 AND (turn % 2 = 0 OR turn % 3 = 1) AS vague FROM conversations WHERE role = 'user'")
def vague_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    best = F.when(F.col("turn") % 2 == 0, 0.5).otherwise(0.9)
    gap = F.when(F.col("turn") % 3 == 1, 5).otherwise(40)
    return c.select("conv_id", "turn", D.too_vague(F.col("text"), best, gap).alias("vague"))


@query("SELECT source, count(*) AS rows FROM documents WHERE lower(source) NOT IN ('src3', 'src4') GROUP BY source UNION ALL SELECT 'channel:new', count(*) FROM documents WHERE source = 'src5'")
def channel_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    held = d.select("doc_id", F.when(F.col("source") == "src3", "channel:NEW").when(F.col("source") == "src4", "channel:old").otherwise(F.col("source")).alias("origin"))
    after = shelf.channel_synced(held, d.filter("source = 'src5'").select("doc_id", F.lit("").alias("origin")), "new", "1", "2", "old")
    return after.groupBy(F.col("origin").alias("source")).agg(F.count("*").alias("rows"))



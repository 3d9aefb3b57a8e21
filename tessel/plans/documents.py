"""Document queries: keyword scores, chunks, labels, lines, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import decide as D
from tessel.functions import text as T
from tessel.functions.python import small_batches
from tessel.functions.register import register
from tessel.operators import ingest, rank, retrieve
from tessel.plans.base import query, table
from tessel.scratch import folder

KEYS = ["license", "the", "that", "ing"]
KEYS_SQL = "['license', 'the', 'that', 'ing']"
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
FOLD = f"translate(text, '{WIDE}ABCDEFGHIJKLMNOPQRSTUVWXYZ　' || chr(9), '0123456789abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz  ')"
COMPACT = f"replace({FOLD}, ' ', '')"
PART = "list_sum(list_transform({keys}, lambda k: CASE WHEN contains(c, k) THEN pow(least(length(k), 8), 1.5) * (1 + ln((length(c) - length(replace(c, k, ''))) / length(k))) ELSE 0 END))"
SCORE = "CASE WHEN raw > 0 THEN least(3.0, raw / (1 + ln(1 + length(c) / 900.0::DOUBLE))) ELSE 0 END"
KEYED = f"k AS (SELECT *, {PART.format(keys=KEYS_SQL)} AS raw FROM (SELECT *, {COMPACT} AS c FROM documents))"
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def docs_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


@query(f"SELECT doc_id, md5({FOLD}) AS folded, md5({COMPACT}) AS compacted FROM documents")
def doc_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_(spark, sf_dir).select("doc_id", F.md5(T.norm_search("text")).alias("folded"), F.md5(T.compact("text")).alias("compacted"))


@query(f"WITH {KEYED} SELECT doc_id, round({SCORE}, 5) AS score FROM k ORDER BY score DESC, doc_id LIMIT 50")
def doc_key_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in KEYS])
    scored = docs_(spark, sf_dir).select("doc_id", T.compact("text").alias("c")).select("doc_id", F.round(T.key_score(keys, F.col("c")), 5).alias("score"))
    return retrieve.top(scored, 50, "score", "doc_id")


_KEPT: dict[tuple[str, str], str] = {}


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and compact text of the documents, folded once an application and kept."""
    held = (spark.sparkContext.applicationId, sf_dir)
    at = _KEPT.get(held)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if at is None or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        at = _KEPT[held] = folder(spark, "folded")
        docs_(spark, sf_dir).select("doc_id", T.compact("text").alias("c")).write.parquet(at)
    return spark.read.parquet(at)


@query(f"WITH {KEYED} SELECT doc_id, round({SCORE}, 5) AS score FROM k ORDER BY score DESC, doc_id LIMIT 50")
def doc_key_score_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword scan over kept folded texts."""
    return retrieve.top(folded(spark, sf_dir).select("doc_id", F.round(T.key_score_of(KEYS, F.col("c")), 5).alias("score")), 50, "score", "doc_id")


@query(f"WITH {KEYED} SELECT doc_id, round(1.0 / (1 + n_chars) + 0.06 * ({SCORE}), 6) AS score FROM k ORDER BY score DESC, doc_id LIMIT 20")
def doc_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in KEYS])
    d = docs_(spark, sf_dir).select("doc_id", "n_chars", T.compact("text").alias("c"))
    return retrieve.top(d.select("doc_id", F.round(F.lit(1.0) / (1 + F.col("n_chars")) + T.SPARSE_WEIGHT * T.key_score(keys, F.col("c")), 6).alias("score")), 20, "score", "doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all({FOLD}, '[0-9a-z]+') AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
    p AS (SELECT doc_id, len(t) AS dl, w, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS w FROM t) WHERE w IN ('apache', 'license', 'work', 'version') GROUP BY ALL),
    f AS (SELECT w, count(*) AS df FROM p GROUP BY w)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM p JOIN f USING (w), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""
)
def doc_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.bm25(docs_(spark, sf_dir), ["apache", "license", "version", "work", "license"], "doc_id", T.tokens("text"), 20)


@query(f"SELECT doc_id, len(list_filter({KEYS_SQL}, lambda k: contains({FOLD}, k)))::BIGINT AS hits, len(list_filter({KEYS_SQL}, lambda k: contains({COMPACT}, k))) / 4.0::DOUBLE AS coverage, len(list_filter({KEYS_SQL}, lambda k: contains({COMPACT}, k))) > 0 AS any_key FROM documents")
def doc_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in KEYS])
    d = docs_(spark, sf_dir).select("doc_id", "text", T.compact("text").alias("c"))
    return d.select("doc_id", T.exact_hits(keys, F.col("text")).alias("hits"), T.coverage(keys, F.col("c")).alias("coverage"), T.any_key(keys, F.col("c")).alias("any_key"))


@query(f"SELECT doc_id, len(regexp_extract_all({FOLD}, '[0-9a-z]+'))::INTEGER AS n_tokens, md5(array_to_string(regexp_extract_all({FOLD}, '[0-9a-z]+'), ',')) AS tokens FROM documents")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs_(spark, sf_dir).select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", ",")).alias("tokens"))


@query(
    """WITH q AS (SELECT item_id, replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ', '') AS s FROM benchmark),
    r AS (SELECT item_id, k, min(i) AS i FROM (SELECT item_id, unnest(regexp_extract_all(s, '[0-9a-z]{2,}')) AS k, generate_subscripts(regexp_extract_all(s, '[0-9a-z]{2,}'), 1) AS i FROM q) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(k) DESC, i) AS rn FROM r)
    SELECT item_id, string_agg(k, '|' ORDER BY rn) AS keys FROM o WHERE rn <= 8 GROUP BY item_id"""
)
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.distinct_keys("text"), "|").alias("keys"))
    return keys.filter("keys <> ''")


@query()
def doc_chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fixed_chunks(docs_(spark, sf_dir), "doc_id", "text", 700, 150)


@query()
def doc_chunks_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.structured_chunks(docs_(spark, sf_dir), "doc_id", "text", 700, 150, 1800)


NORM_HASH = "trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' ')"


@query(f"SELECT md5({NORM_HASH}) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = docs_(spark, sf_dir).select("doc_id", F.md5(T.norm_hash("text")).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query()
def doc_fnv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(docs_(spark, sf_dir)).select("doc_id", ingest.fnv1a64(T.norm_hash("text")).alias("fnv"))


@query(
    f"""WITH {LINES}, h AS (SELECT *, CASE WHEN contains(line, 'Licensed') THEN 1 ELSE 0 END AS hit FROM l),
    w AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h)
    SELECT doc_id, n::INTEGER AS n FROM w WHERE near = 1 AND hit = 0"""
)
def doc_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(docs_(spark, sf_dir))
    return rank.neighbours(l, F.contains(F.col("line"), F.lit("Licensed")), "doc_id", ["n"], 2).select("doc_id", "n")


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, n, length(line) AS len, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
    SELECT doc_id, n::INTEGER AS n, greatest(least(len, 2000 - before), 0)::BIGINT AS taken FROM b WHERE greatest(least(len, 2000 - before), 0) > 0"""
)
def doc_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(docs_(spark, sf_dir))
    return rank.within_budget(l, ["doc_id"], ["n"], F.length("line").cast("long"), 2000).select("doc_id", "n", "taken")


@query("SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs, greatest(1, least(60, count(*) // 3)) AS chapters FROM documents GROUP BY source")
def doc_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = docs_(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))
    return g.withColumn("chapters", F.greatest(F.lit(1).cast("long"), F.least(F.lit(60).cast("long"), F.floor(F.col("docs") / 3))))


@query("WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT source, doc_id, n_chars FROM r WHERE rn <= 3")
def doc_top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_per(docs_(spark, sf_dir).select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3)


CONFIDENCE = f"""WITH {KEYED}, s AS (SELECT source, doc_id, {SCORE} AS score, len(list_filter({KEYS_SQL}, lambda k: contains(c, k))) / 4.0::DOUBLE AS cov FROM k),
    a AS (SELECT source, max(cov) AS coverage, CASE WHEN sum(score) > 0 THEN max(score) / avg(score) ELSE 1.0 END AS flat FROM s GROUP BY source)"""


@query(CONFIDENCE + " SELECT source, coverage, round(flat, 5) AS flat, CASE WHEN coverage >= 1.0 AND flat >= 1.6 THEN 2 WHEN coverage >= 0.9 THEN 1 ELSE 0 END AS level FROM a")
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in KEYS])
    d = docs_(spark, sf_dir).select("source", T.compact("text").alias("c")).select("source", T.key_score(keys, F.col("c")).alias("score"), T.coverage(keys, F.col("c")).alias("cov"))
    a = d.groupBy("source").agg(F.max("cov").alias("coverage"), rank.flatness(F.col("score")).alias("flat"))
    return a.select("source", "coverage", F.round("flat", 5).alias("flat"), rank.confidence(F.col("coverage"), F.col("flat")).alias("level"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z0-9.]@[A-Za-z0-9.]') AND regexp_matches(text, '(?s)^[^@]*@.*[.]') THEN 'email'
    WHEN regexp_matches(text, '([0-9][- ‐]*){10}') THEN 'number' END AS kind FROM documents"""
)
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_(spark, sf_dir).select("doc_id", T.pii_kind("text").alias("kind"))


@query(
    """SELECT doc_id, len(f) >= 3 AND len(list_filter(f, lambda x: regexp_matches(x, '([.．・…‥]{2,}|[…‥])[ ]*[0-9０-９]+[ ]*$'))) * 2 >= len(f) AS toc
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS f FROM documents)"""
)
def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_(spark, sf_dir).select("doc_id", T.toc_page("text").alias("toc"))


@query(
    f"""WITH {LINES}, t AS (SELECT line, trim(line, ' ') AS t FROM l)
    SELECT CASE WHEN contains(line, chr(9)) OR contains(t, '   ') OR contains(line, '|') THEN 4 WHEN regexp_matches(t, '^# ') THEN 1 WHEN regexp_matches(t, '^【.*】') AND length(t) <= 60 THEN 1
    WHEN regexp_matches(t, '^##+ ') THEN 2 WHEN regexp_matches(t, '^[0-9]+[.]') AND length(t) < 50 THEN 2 WHEN regexp_matches(t, '^[■●◆]') AND length(t) < 40 THEN 2
    WHEN regexp_matches(t, '^(・|- |[(（][0-9０-９]|[①-⑳])') THEN 3 ELSE 0 END AS class, count(*) AS lines FROM t GROUP BY 1"""
)
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(docs_(spark, sf_dir)).groupBy(T.line_class("line").alias("class")).agg(F.count("*").alias("lines"))


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS chars, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS body FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", ingest.html_text("html").alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("body"))


@query("SELECT doc_id, 0.0::DOUBLE + round((length(h) - length(replace(h, '�', ''))) / greatest(length(regexp_replace(h, '[ \\t\\r\\n　]', '', 'g')), 1), 6) AS ratio FROM (SELECT doc_id, substring(text, 1, 20000) AS h FROM documents)")
def doc_replacement_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_(spark, sf_dir).select("doc_id", F.round(T.replacement_ratio("text"), 6).alias("ratio"))


@query(
    """SELECT doc_id, doc_id % 3 <> 1 AND doc_id % 200 >= 10 AND (doc_id % 9 <= (doc_id % 200) // 20 OR n_chars < 60 * (doc_id % 200)) AS thin FROM documents"""
)
def thin_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return docs_(spark, sf_dir).select("doc_id", D.thin_extract(F.when(i % 3 == 1, "docx").otherwise("pdf"), i % 200, i % 9, F.col("n_chars")).alias("thin"))


CSV = """SELECT doc_id, md5(CASE WHEN regexp_matches(t, '[,"\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END) AS field
    FROM (SELECT doc_id, CASE WHEN substring(s, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || s ELSE s END AS t FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '@' ELSE '' END || text AS s FROM documents))"""


@query(CSV)
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    starter = F.when(F.col("doc_id") % 4 == 0, "=").when(F.col("doc_id") % 4 == 1, "@").otherwise("")
    return docs_(spark, sf_dir).select("doc_id", F.md5(T.csv_safe(F.concat(starter, F.col("text")))).alias("field"))


@query(CSV)
def csv_fields_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return docs_(spark, sf_dir).selectExpr("doc_id", "md5(csv_safe(concat(CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '@' ELSE '' END, text))) AS field")


@query(
    """WITH q AS (SELECT item_id, text AS probe FROM benchmark), m AS (SELECT q.item_id, d.doc_id, d.n_chars FROM q JOIN documents d ON contains(d.text, q.probe)),
    r AS (SELECT item_id, min(doc_id) AS doc_id FROM m GROUP BY item_id), k AS (SELECT q.item_id, r.doc_id FROM q LEFT JOIN r USING (item_id))
    SELECT count(*) AS questions, count(doc_id) AS found, round(avg(CASE WHEN doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall FROM k"""
)
def benchmark_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), docs_(spark, sf_dir)
    found = ingest.containing(d, b, "doc_id", "text", "item_id", "text").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    k = b.select("item_id").join(found, "item_id", "left")
    return k.agg(F.count("*").alias("questions"), F.count("doc_id").alias("found"), F.round(F.avg(F.when(F.col("doc_id").isNull(), 0.0).otherwise(1.0)), 6).alias("recall"))


@query(
    """WITH m AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.n_chars, d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    k AS (SELECT b.item_id, min(CASE WHEN m.doc_id % 2 = 0 THEN m.rank END) AS rank FROM benchmark b LEFT JOIN m USING (item_id) GROUP BY b.item_id)
    SELECT count(*) AS questions, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS recall_1, avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS recall_3, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_5,
    avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS recall_10, avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE ELSE 0 END) AS recall_20, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM k"""
)
def benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), docs_(spark, sf_dir)
    m = ingest.containing(d, b, "doc_id", "text", "item_id", "text", ["n_chars"])
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")))
    best = b.select("item_id").join(ranked.groupBy("item_id").agg(F.min(F.when(F.col("doc_id") % 2 == 0, F.col("rank"))).alias("rank")), "item_id", "left")
    return retrieve.recall(best).withColumn("mrr", F.round("mrr", 6))


@query("SELECT doc_id, substring(text, 1, 120) AS preview, source, CASE WHEN lower(source) LIKE 'src1%' THEN 'pack' ELSE '' END AS kind FROM documents ORDER BY n_chars DESC, doc_id LIMIT 16")
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_(spark, sf_dir).orderBy(F.desc("n_chars"), "doc_id").limit(16)
    return d.select("doc_id", F.substring("text", 1, 120).alias("preview"), "source", T.origin_kind(F.when(F.lower("source").startswith("src1"), F.lit("Pack:x")).otherwise(F.col("source"))).alias("kind"))


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, n, (n - 1) // 3 + 1 AS page, line FROM l), t AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY n) AS t FROM p GROUP BY ALL)
    SELECT doc_id, count(*) AS pages, md5(string_agg('--- page ' || page || ' ---' || chr(10) || t, chr(10) ORDER BY page)) AS joined FROM t GROUP BY doc_id"""
)
def doc_paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lines(docs_(spark, sf_dir)).withColumn("page", F.expr("(n - 1) div 3 + 1"))
    t = p.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    j = ingest.join_pages(t, ["doc_id"])
    return j.select("doc_id", "pages", F.md5("text").alias("joined"))

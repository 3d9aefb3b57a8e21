"""Queries over the table operators: inboxes, manifests, packs, versions, memos, routes to an answer, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import python as P
from tessel.functions import text as T
from tessel.operators import answer, expand, ingest, queue, rank, retrieve, sets, shelf
from tessel.plans.base import query, table
from tessel.plans.rules import FNV, HEX
from tessel.scratch import folder
from tessel.sources import files, shared
from tessel.streaming import stream


FOLD = "translate({x}, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚABCDEFGHIJKLMNOPQRSTUVWXYZ　' || chr(9), '0123456789abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz  ')"


def documents_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def events_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    """WITH i AS (SELECT event_id % 700 AS nonce, CASE event_id % 3 WHEN 0 THEN 'ME' WHEN 1 THEN 'other' ELSE 'my name' END AS addressee, ts, event_id FROM events), m AS (SELECT * FROM i WHERE addressee <> 'other'),
    f AS (SELECT nonce, min(ts) AS received FROM m GROUP BY nonce) SELECT nonce, received FROM f WHERE nonce % 2 = 1"""
)
def thanks_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    inbox = events_(spark, sf_dir).select((i % 700).alias("nonce"), F.when(i % 3 == 0, "ME").when(i % 3 == 1, "other").otherwise("my name").alias("addressee"), F.col("ts").alias("at"))
    seen = spark.range(0, 700, 2).select(F.col("id").alias("nonce"))
    return shelf.thanks(inbox, ["me", "My Name"], seen).select("nonce", F.col("at").alias("received"))


@query(
    """WITH n AS (SELECT count(DISTINCT event_id % 700) AS n FROM events WHERE event_id % 3 <> 1 AND event_id % 700 % 2 = 1), s AS (SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type)
    SELECT key, value FROM s UNION ALL SELECT 'exp_total', 7 + 10 * n FROM n UNION ALL SELECT 'thanks_received_total', n FROM n"""
)
def points_of_thanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = events_(spark, sf_dir), F.col("event_id")
    inbox = e.select((i % 700).alias("nonce"), F.when(i % 3 == 0, "ME").when(i % 3 == 1, "other").otherwise("my name").alias("addressee"), F.col("ts").alias("at"))
    stats = e.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("value")).unionByName(spark.range(1).select(F.lit("exp_total").alias("key"), F.lit(7).cast("long").alias("value")))
    return shelf.thanked(inbox, ["me", "My Name"], spark.range(0, 700, 2).select(F.col("id").alias("nonce")), stats)


@query(
    """WITH u AS (SELECT user_id, count(*) AS n, (ARRAY['qa', 'gap', 'correction'])[1 + user_id % 3] AS kind, 'a' || (user_id % 4) || '-' || lpad(user_id::VARCHAR, 9, '0') AS nonce FROM events GROUP BY user_id),
    f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY nonce) AS r FROM u WHERE user_id % 4 <> 1 AND user_id % 5 <> 0) SELECT kind, nonce, n, 'Q' || user_id AS question FROM f WHERE r <= 20 AND user_id % 7 <> 0"""
)
def posts_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of users in three folders: own and seen ones left out, unfinished files passed over, the first twenty of each."""
    import pandas as pd

    from tessel.sources.shelf_source import opened

    at = folder(spark)
    u = events_(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    kind = F.element_at(F.array(F.lit("qa"), F.lit("gap"), F.lit("correction")), (1 + F.col("user_id") % 3).cast("int"))
    posts = u.select(kind.alias("kind"), text("a", F.col("user_id") % 4, "-", F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("nonce"), F.when(F.col("user_id") % 7 == 0, F.col("n").cast("string")).otherwise(F.concat_ws("\t", F.col("n").cast("string"), text("Q", F.col("user_id")))).alias("line"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        held, top = opened(at)
        for r in rows.itertuples():
            held.create_dir(f"{top}/{r.kind}", recursive=True)
            with held.open_output_stream(f"{top}/{r.kind}/{r.nonce}.txt") as out:
                out.write(r.line.encode())
        return pd.DataFrame({"n": [len(rows)]})

    posts.groupBy("kind").applyInPandas(write, "n long").collect()  # a row a folder
    seen = u.filter("user_id % 5 = 0").select(text("A", F.col("user_id") % 4, "-", F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("nonce"))
    rows = files.collected(spark, {k: f"{at}/{k}" for k in ("qa", "gap", "correction")}, ["n", "question"], ["A1", "nobody"], seen, 20)
    return rows.select("kind", "nonce", F.col("n").cast("long").alias("n"), "question")


@query("WITH f AS (SELECT event_id % 700 AS nonce, min(ts) AS received FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT nonce, received FROM f WHERE nonce % 2 = 1 ORDER BY received, nonce LIMIT 3")
def questions_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    inbox = events_(spark, sf_dir).select((i % 700).alias("nonce"), F.when(i % 3 == 0, "Me").otherwise("other").alias("addressee"), F.col("ts").alias("at"))
    return shelf.delivered(inbox, ["me"], spark.range(0, 700, 2).select(F.col("id").alias("nonce"))).select("nonce", F.col("at").alias("received"))


@query("SELECT event_id, ts AS created_at, 'q' || event_id AS question FROM events ORDER BY ts DESC, question LIMIT 20")
def gaps_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.gap_list(events_(spark, sf_dir).select("event_id", F.col("ts").alias("created_at"), text("q", F.col("event_id")).alias("question")))


@query("SELECT name, n FROM (SELECT 'f' || lpad(event_id::VARCHAR, 9, '0') AS name, event_id AS n FROM events) ORDER BY name DESC LIMIT 20")
def feedback_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events_(spark, sf_dir).select(text("f", F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("name"), F.col("event_id").alias("n"))
    return queue.feedback_list(f, "name")


MANIFEST = """m AS (SELECT doc_id, '/shelf/' || CASE WHEN doc_id % 5 = 0 THEN 'sub/' ELSE '' END || 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' ELSE '.zip' END AS file_path, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed_permanent' ELSE 'done' END AS status,
    n_chars AS chunk_count, CASE doc_id % 4 WHEN 0 THEN 1 + doc_id % 3 WHEN 1 THEN 3 ELSE 0 END AS streak, CASE WHEN doc_id % 7 = 0 THEN 'pack:x' ELSE 'self' END AS origin FROM documents)"""


def manifest_(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    path = text("/shelf/", F.when(i % 5 == 0, "sub/").otherwise(""), "f", i, F.when(i % 3 == 0, ".TXT").when(i % 3 == 1, ".md").otherwise(".zip"))
    status = F.when(i % 4 == 0, "failed").when(i % 4 == 1, "failed_permanent").otherwise("done")
    streak = F.when(i % 4 == 0, 1 + i % 3).when(i % 4 == 1, 3).otherwise(0)
    return documents_(spark, sf_dir).select("doc_id", path.alias("file_path"), status.alias("status"), F.col("n_chars").alias("chunk_count"), streak.cast("int").alias("streak"), F.when(i % 7 == 0, "pack:x").otherwise("self").alias("origin"))


@query(
    f"""WITH {MANIFEST}, c AS (SELECT file_path, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE 5 END AS n FROM m WHERE doc_id % 2 = 0)
    SELECT m.file_path, CASE WHEN c.status IS NULL THEN m.status WHEN c.status = 'failed' AND m.streak + 1 >= 3 THEN 'failed_permanent' ELSE c.status END AS status, CASE WHEN coalesce(c.n, -1) = -1 THEN m.chunk_count ELSE c.n END AS chunk_count,
    CASE WHEN c.status IS NULL THEN m.streak WHEN c.status = 'failed' THEN m.streak + 1 ELSE 0 END AS streak FROM m LEFT JOIN c ON m.file_path = c.file_path"""
)
def manifest_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, i = manifest_(spark, sf_dir), F.col("doc_id")
    changes = m.filter(i % 2 == 0).select("file_path", F.when(i % 3 == 0, "failed").otherwise("done").alias("status"), F.when(i % 11 == 0, -1).otherwise(5).cast("long").alias("chunk_count"))
    return shelf.manifest_upserted(m, changes)


@query(f"WITH {MANIFEST} SELECT doc_id, file_path FROM m WHERE origin = 'self' AND doc_id % 5 <> 0 AND doc_id % 3 <> 2")
def manifest_in_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.manifest_scope(manifest_(spark, sf_dir), "/SHELF", ("txt", "md")).select("doc_id", "file_path")


@query(f"WITH {MANIFEST} SELECT doc_id, CASE WHEN origin = 'self' AND doc_id % 5 = 0 THEN 'missing' WHEN doc_id = 1 THEN 'failed' ELSE status END AS status, CASE WHEN doc_id = 1 THEN 0 ELSE streak END AS streak FROM m")
def manifest_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.streak_reset(shelf.marked_missing(manifest_(spark, sf_dir), "/shelf/Sub/"), "/shelf/f1.md").select("doc_id", "status", "streak")


@query("SELECT DISTINCT source, unnest(['k' || (doc_id % 9), 'Part ' || (doc_id % 4), 'sec', lang]) AS term FROM documents")
def terms_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents_(spark, sf_dir), F.col("doc_id")
    knowledge = d.select("source", text(" k", i % 9, " ;x").alias("keywords"))
    meta = d.select("source", text("Part ", i % 4, " > sec").alias("section_path"))
    return shelf.synonym_terms(knowledge, meta, d.select("source", F.col("lang").alias("keywords")))


@query("SELECT 'narrow' AS asked, doc_id FROM documents UNION ALL SELECT 'wide', doc_id FROM documents WHERE source = 'src1'")
def widened_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope with one hit, the longest text's, gives way to the whole shelf; a wide one stays."""
    d = documents_(spark, sf_dir).select("doc_id", "source", "n_chars")
    one = d.orderBy(F.desc("n_chars"), "doc_id").limit(1)
    asked = lambda name, rows: rows.select(F.lit(name).alias("asked"), "doc_id")
    return asked("narrow", shelf.widened(one, d)).union(asked("wide", shelf.widened(d.filter("source = 'src1'"), d)))


@query(
    """WITH h AS (SELECT row_number() OVER (ORDER BY doc_id) AS rank, source, text FROM documents ORDER BY doc_id LIMIT 12), b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
    t AS (SELECT rank, source, substring(text, 1, greatest(20000 - before, 0)::INTEGER) AS t FROM b) SELECT md5(string_agg('[' || source || ' p.1]' || chr(10) || t, chr(10) || chr(10) ORDER BY rank)) AS context, md5('why?' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || source || ' p.1' || chr(10) || t, chr(10) ORDER BY rank)) AS prompt FROM t WHERE t <> ''"""
)
def context_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = documents_(spark, sf_dir).orderBy("doc_id").limit(12).select(F.row_number().over(Window.orderBy("doc_id")).alias("rank"), "source", F.lit(1).alias("page"), F.col("text").alias("full_text"))
    prompt = answer.rerank_prompt(hits, "why?", 20000).select(F.md5("prompt").alias("prompt"))
    return shelf.context(hits, 20000).select(F.md5("context").alias("context")).join(F.broadcast(prompt))


@query("SELECT 'c' || user_id AS channel, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'v1' END AS version, 'v' || (user_id % 2 + 1) AS remote FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 <> 0 AND user_id % 7 <> 0 AND (user_id % 3 = 0 OR user_id % 2 = 1)")
def channel_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events_(spark, sf_dir).select("user_id").distinct()
    i = F.col("user_id")
    local = u.select(text("c", i).alias("channel"), F.when(i % 3 != 0, "v1").alias("version"), (i % 5 != 0).alias("subscribed"))
    return files.pending_updates(local, u.select(text("c", i).alias("channel"), F.when(i % 7 == 0, "").otherwise(text("v", i % 2 + 1)).alias("version")))


@query(
    """WITH v AS (SELECT DISTINCT source AS channel, 'v-' || lang AS version, lang = 'en' AS current FROM documents) SELECT channel, version, CASE WHEN channel = 'src1' THEN version = 'v-de' ELSE current END AS current FROM v
    UNION ALL SELECT 'src1', 'v-new', false"""
)
def versions_of_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels with a version a language: one gets a new current version, then goes back to an older one."""
    d = documents_(spark, sf_dir).select(F.col("source").alias("channel"), text("/", F.col("source"), "/", F.col("lang")).alias("path"), text("v-", F.col("lang")).alias("version"), (F.col("lang") == "en").alias("current")).distinct()
    return shelf.rolled_back(shelf.published(spark, d, "src1", "/src1/new", "v-new"), "src1", "v-de").select("channel", "version", "current")


@query("WITH s AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'ask:' WHEN 1 THEN 'sv:' ELSE 'other:' END || user_id AS key, user_id FROM events) SELECT key, CASE WHEN key LIKE 'ask:%' OR key LIKE 'sv:%' THEN 'new' ELSE 'old' END AS value FROM s")
def stats_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    keys = events_(spark, sf_dir).select("user_id").distinct().select(text(F.when(u % 3 == 0, "ask:").when(u % 3 == 1, "sv:").otherwise("other:"), u).alias("key"))
    return shelf.migrated(keys.withColumn("value", F.lit("old")), keys.withColumn("value", F.lit("new")), ("ask:", "sv:"))


@query(
    f"""WITH q AS (SELECT event_id, user_id, ts, 'question' || (event_id % 50) AS key FROM events WHERE event_id % 4 <> 0 AND event_id % 4 <> 1), s AS (SELECT 'question' || n AS key, TIMESTAMP '2024-01-10' AS at FROM (SELECT unnest(range(0, 50, 2)) AS n)),
    u AS (SELECT DISTINCT user_id, {FNV.format(s="user_id::VARCHAR")} AS h FROM events)
    SELECT q.key, ts AS at, CASE WHEN user_id % 2 = 0 THEN '' ELSE {HEX.format(h="h")} END AS user FROM q JOIN u USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.key = q.key AND s.at > q.ts - INTERVAL 24 HOUR)"""
)
def gaps_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    q = F.when(i % 4 == 0, " ").when(i % 4 == 1, text("mail a@b.cc ", i)).otherwise(text("Question ", i % 50, "? "))
    rows = events_(spark, sf_dir).select(q.alias("question"), F.when(F.col("user_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string")).alias("user_id"), F.col("ts").alias("at"))
    sent = spark.range(0, 50, 2).select(text("question", F.col("id")).alias("key"), F.lit("2024-01-10").cast("timestamp").alias("at"))
    return shelf.gap_events(rows, sent).select("key", "at", "user")


@query(
    """WITH c AS (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' ')) ORDER BY 'b' || lpad(doc_id::VARCHAR, 9, '0')) AS n, md5(trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' ')) AS h FROM documents WHERE doc_id % 3 <> 0),
    s AS (SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' ')) AS h FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)
    SELECT 'self' AS origin, true AS embedded, doc_id FROM s UNION ALL SELECT 'pack:me', doc_id % 2 = 0, doc_id FROM c WHERE n = 1 AND h NOT IN (SELECT h FROM s)"""
)
def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack written, read back and imported into a shelf from which an older import leaves first."""
    d, i = documents_(spark, sf_dir), F.col("doc_id")
    key = text("b", F.lpad(i.cast("string"), 9, "0")).alias("chunk_id")
    own = d.filter(i % 3 == 0).select(key, "source", F.when(i % 2 == 0, "self").otherwise("pack:old").alias("origin"), F.lit(1).alias("page"), F.lit("").alias("summary"), F.lit("").alias("keywords"), F.col("text").alias("full_text"), F.array(F.lit(1.0)).alias("vector"), F.lit(True).alias("embedded"))
    clean = d.filter(i % 3 != 0)
    chunks = clean.select(key, "source", F.lit("self").alias("origin"), F.lit(1).alias("page"), F.lit("").alias("summary"), F.lit("").alias("keywords"), F.col("text").alias("full_text"))
    vectors = clean.filter(i % 2 == 0).select(key, F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    path = folder(spark)
    chunks.write.parquet(f"{path}/chunks")
    vectors.union(vectors).write.parquet(f"{path}/vectors")
    spark.createDataFrame([("pack_format_version", str(files.FORMAT_VERSION)), ("embed_dim", "2"), ("author", "me")], files.META).write.parquet(f"{path}/meta")
    meta, pack = files.read_pack(spark, path, 2)
    after = files.imported(own, pack, f"pack:{meta['author']}", ["PACK:old"])
    return after.select("origin", "embedded", F.substring("chunk_id", 2, 9).cast("long").alias("doc_id"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '''=' ELSE '' END || event_type || ', \"x\"' AS detail FROM events")
def analytics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    files.write_analytics(events_(spark, sf_dir).select("event_id", text(F.when(F.col("event_id") % 2 == 0, "=").otherwise(""), F.col("event_type"), ', "x"').alias("detail")), path)
    return spark.read.option("header", True).option("escape", '"').schema("event_id long, detail string").csv(path)


@query("SELECT * FROM (VALUES ('a', 'v1'), ('b', 'v2')) t(channel, version)")
def channels_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = folder(spark)
    for name, version in (("a", "v1"), ("b", "v2"), ("_own", "v9"), ("c", "v3")):
        shared.write_text(spark, f"{top}/{name}/version.txt", version + "\n")
    assert shared.read_text(spark, f"{top}/a/version.txt") == "v1\n"
    return shared.channels(spark, top, most=2)[0]


@query("SELECT DISTINCT ON (user_id) user_id, event_id FROM events WHERE event_id % 3 <> 0 ORDER BY user_id, ts DESC, event_id DESC")
def telemetry_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir).filter("event_id % 3 <> 0").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return queue.published(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")).select("user_id", "event_id")


@query("SELECT 'first' AS pass, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 5 <> 0) AS embedded, count(*) AS rows FROM documents UNION ALL SELECT 'again', 0, count(*) FROM documents UNION ALL SELECT 'stopped', count(*) FILTER (doc_id % 2 = 0), count(*) FROM documents")
def embedding_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of the queue in which some calls fail, all rows marked for another, and a pass whose service is down."""
    d = documents_(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise("x").alias("text"), (F.col("doc_id") % 2 == 0).alias("embedded"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0))).alias("vector"))

    def service(texts: list[str]) -> list:
        return [P.mock_embedding(t, 2) if t else None for t in texts]

    def down(texts: list[str]) -> list:
        raise OSError("no service")

    first = queue.embedded(d, "text", service)
    counted = lambda name, rows: rows.agg(F.count_if("embedded").alias("embedded"), F.count("*").alias("rows")).select(F.lit(name).alias("pass"), "embedded", "rows")
    return counted("first", first).union(counted("again", queue.marked_again(first))).union(counted("stopped", queue.embedded(d, "text", down)))


NORM = "trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' ')"


@query(
    f"""WITH d AS (SELECT doc_id, md5({NORM}) AS h FROM documents), s AS (SELECT h FROM d WHERE doc_id % 2 = 0), f AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE doc_id % 2 = 1 AND h NOT IN (SELECT h FROM s) GROUP BY h)
    SELECT 'first' AS run, doc_id AS chunk_id FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'first', doc_id FROM f UNION ALL SELECT 'again', doc_id FROM d WHERE doc_id % 2 = 0"""
)
def seed_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("full_text"))
    held, seed = d.filter("chunk_id % 2 = 0"), d.filter("chunk_id % 2 = 1")
    first, again = (queue.seeded(held, seed, done).select(F.lit(name).alias("run"), "chunk_id") for name, done in (("first", False), ("again", True)))
    return first.union(again)


@query("SELECT lang, count(*) || '|' || min(doc_id) || '|' || max(doc_id) AS stamp FROM documents GROUP BY lang")
def cache_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.stamp(documents_(spark, sf_dir), "doc_id", ["lang"])


@query("WITH p AS (SELECT 1 AS part, doc_id FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 6), q AS (SELECT 2 AS part, doc_id FROM documents WHERE doc_id % 2 = 0 ORDER BY n_chars DESC, doc_id LIMIT 6), a AS (SELECT * FROM p UNION ALL SELECT * FROM q) SELECT doc_id AS chunk_id, min(part)::INTEGER AS part FROM a GROUP BY doc_id")
def parts_of_a_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_(spark, sf_dir)

    def search(part: str, k: int) -> DataFrame:
        rows = d.filter("lang = 'en'" if part == "english" else "doc_id % 2 = 0")
        return rows.orderBy(F.desc("n_chars"), "doc_id").limit(k).select(F.col("doc_id").alias("chunk_id"), "source", F.lit(1).alias("page"), F.col("n_chars").cast("double").alias("score"))

    return answer.by_parts(["english", "even"], search, 12).select("chunk_id", "part")


@query(
    """WITH o AS (SELECT row_number() OVER (ORDER BY source, lang) AS n, source, lang AS chap FROM (SELECT DISTINCT source, lang FROM documents)), c AS (SELECT d.source, lang AS chap, doc_id AS ord, n_chars AS len FROM documents d JOIN o ON d.source = o.source AND d.lang = o.chap AND n IN (3, 1)),
    b AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY source, chap ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT source, chap, ord, greatest(least(len, 5000 - before), 0)::BIGINT AS taken FROM b WHERE greatest(least(len, 5000 - before), 0) > 0"""
)
def chapters_of_an_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_(spark, sf_dir)
    o = d.select("source", F.col("lang").alias("chap")).distinct().withColumn("n", F.row_number().over(Window.orderBy("source", "chap")))
    asked = spark.createDataFrame([("3, 1、x 3 9999",)], "picks string")
    chunks = d.select("source", F.col("lang").alias("chap"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("len"))
    return answer.by_outline(chunks, o, F.col("picks"), asked, 10000, 100).select("source", "chap", "ord", "taken")


@query("WITH g AS (SELECT source, lang AS chap, min(doc_id) AS first, count(*) AS chunks FROM documents GROUP BY ALL) SELECT source, chap, row_number() OVER (PARTITION BY source ORDER BY first)::INTEGER AS n, CASE WHEN chap = 'es' THEN '（要約失敗）' ELSE 'about ' || chap END AS summary, CASE WHEN chap = 'es' THEN '' ELSE 'k' END AS keywords FROM g")
def outline_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_(spark, sf_dir).withColumn("chap", F.col("lang"))
    groups = d.groupBy("source", "chap").agg(F.min("doc_id").alias("first"))
    chunks = d.select("source", "chap", F.col("doc_id").alias("ord"), text(F.col("chap"), " ", F.col("text")).alias("full_text"))

    def summary(body: Column) -> Column:
        chap = F.substring(body, 1, 2)
        return F.when(chap != "es", F.struct(text("about ", chap).alias("summary"), F.lit("k").alias("keywords")))

    return answer.outline(groups, chunks, summary, 500)


@query("SELECT event_id, array_to_string(list_slice(CASE event_id % 3 WHEN 0 THEN ['n' || (event_id % 4), 'a', 'b'] WHEN 1 THEN ['b', 'a'] ELSE ['a', 'b'] END, 1, 2), ',') AS cited, CASE WHEN event_id % 2 = 0 THEN 'a,b,c' ELSE 'a' END AS unsubscribed, event_id % 2 = 0 AS has FROM events")
def lists_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    new = F.when(i % 3 == 0, F.array(text("n", i % 4))).when(i % 3 == 1, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    held = F.array(F.lit("a"), F.lit("b"))
    listed = F.when(i % 2 == 0, sets.listed_with(held, F.lit("c"))).otherwise(sets.listed_without(held, F.lit("b")))
    return events_(spark, sf_dir).select("event_id", F.array_join(sets.merged_recent(held, new, 2), ",").alias("cited"), F.array_join(listed, ",").alias("unsubscribed"), F.array_contains(listed, "b").alias("has"))


@query(
    """WITH o AS (SELECT lower(source) AS k, source AS term, max(lang) AS canonical, min(doc_id) AS ord FROM documents WHERE doc_id % 2 = 0 GROUP BY source), w AS (SELECT 'SRC' || (doc_id % 30) AS term, 'x' || doc_id AS canonical, doc_id AS ord FROM documents WHERE doc_id % 3 = 0 AND doc_id % 30 < 12),
    n AS (SELECT term, min_by(canonical, ord) AS canonical, min(ord) AS ord FROM w GROUP BY term) SELECT term, canonical, ord FROM o WHERE k NOT IN (SELECT lower(term) FROM n) UNION ALL SELECT term, canonical, ord FROM n"""
)
def synonym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents_(spark, sf_dir), F.col("doc_id")
    old = d.filter(i % 2 == 0).groupBy(F.col("source").alias("term")).agg(F.max("lang").alias("canonical"), F.min(i).alias("ord"))
    new = d.filter((i % 3 == 0) & (i % 30 < 12)).select(text("SRC", i % 30).alias("term"), text("x", i).alias("canonical"), i.alias("ord"))
    return sets.merged_pairs(old, new)


@query("SELECT conv_id, turn, text || CASE WHEN contains(text, 'the') AND NOT contains(text, 'THE') THEN ' THE' WHEN contains(text, 'THE') AND NOT contains(text, 'the') THEN ' the' ELSE '' END || CASE WHEN contains(text, 'ing') AND NOT contains(text, 'in g') THEN ' in g' WHEN contains(text, 'in g') AND NOT contains(text, 'ing') THEN ' ing' ELSE '' END AS expanded FROM (SELECT min(conv_id) AS conv_id, min(turn) AS turn, text FROM conversations GROUP BY text)")
def queries_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("text").agg(F.min("conv_id").alias("conv_id"), F.min("turn").alias("turn"))
    pairs = spark.createDataFrame([("the", "THE", 1), ("ing", "in g", 2)], "term string, canonical string, ord int")
    return c.join(sets.synonyms(c.select("text"), pairs, "text"), "text").select("conv_id", "turn", "expanded")


@query("WITH h AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, doc_id AS id, source FROM documents QUALIFY rank <= 20), w AS (SELECT *, source IN ('src1', 'src2') AS wrong FROM h) SELECT id, row_number() OVER (ORDER BY wrong, CASE WHEN wrong THEN -rank ELSE rank END)::INTEGER AS place FROM w")
def wrong_hits_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_(spark, sf_dir).orderBy(F.desc("n_chars"), "doc_id").limit(20)
    hits = d.select(F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.col("doc_id").alias("id"), "source")
    return rank.wrong_last(hits, F.col("source").isin("src1", "src2")).select("id", "place")


@query(
    """WITH h AS (SELECT doc_id AS id, source, doc_id % 5 AS page, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE n_chars > 20000),
    m AS (SELECT -max(doc_id) - 1 AS id FROM documents WHERE doc_id % 7 = 3), a AS (SELECT id, 0 AS bad, 0 AS rank FROM m UNION ALL SELECT id, (source || ' p.' || page IN ('src3 p.1', 'src4 p.2', 'src5 p.0'))::INT, rank FROM h)
    SELECT id, row_number() OVER (ORDER BY bad, CASE WHEN bad = 1 THEN -rank ELSE rank END)::INTEGER AS place FROM a"""
)
def memo_leads_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents as hits, memos made of others: the last equal question leads, the sources it calls wrong go to the tail."""
    d, i = documents_(spark, sf_dir), F.col("doc_id")
    long = d.filter("n_chars > 20000").select(i.alias("id"), "source", F.lit(0.5).alias("score"), (i % 5).cast("int").alias("page"))
    hits = long.withColumn("rank", F.row_number().over(Window.orderBy("id")))  # the hits of one question
    memos = d.filter(i % 7 == 3).select((-i - 1).alias("id"), text("memo", i).alias("source"), F.lit("交通費 の 精算").alias("question"), F.lit("Src3 p.1|src4 p.2、SRC5 p.0").alias("wrong"), i.cast("int").alias("ord"))
    return expand.memo_injected(hits, memos, "交通費の精算", 1_000_000).select("id", F.col("place").cast("int").alias("place"))


@query("WITH t AS (SELECT user_id, event_type, ts, event_id FROM events), l AS (SELECT user_id, event_type, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM t), s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_ms(ts) - epoch_ms(before) > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l) SELECT user_id AS session, event_type AS chunk, row_number() OVER (PARTITION BY user_id, sid, event_type ORDER BY ts, event_id) > 1 AS seen_before FROM s")
def chunks_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.event_stream(spark, sf_dir, "events.parquet").select(F.col("user_id").alias("session"), F.col("event_type").alias("chunk"), "ts")
    return stream.drained(stream.used_chunks(e, "session", "ts", "chunk"))


@query("SELECT user_id, max(ts) AS ts, count(*) AS n FROM events GROUP BY user_id")
def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.event_stream(spark, sf_dir, "events.parquet")
    return stream.drained(e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("n")), "update", keys=["user_id"])


@query("SELECT doc_id, 3 * (CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'apache') THEN 1 ELSE 0 END)::DOUBLE AS boost, n_chars >= 0 AS known FROM documents")
def exact_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_(spark, sf_dir).select("doc_id", retrieve.exact_boost(F.lit("License Apache no"), F.col("text")).alias("boost"), (F.col("n_chars") >= 0).alias("known"))


@query(
    """WITH m AS (SELECT b.item_id, d.doc_id, d.source, d.doc_id % 40 AS page, row_number() OVER (PARTITION BY b.item_id ORDER BY d.n_chars, d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)), g AS (SELECT item_id, min_by(source, rank) AS gold, min_by(page, rank) + item_id % 3 AS gold_page FROM m GROUP BY item_id)
    SELECT avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS page_hit FROM (SELECT b.item_id, coalesce(bool_or(m.source = g.gold AND abs(m.page - g.gold_page) <= 1 AND m.rank <= 5), false) AS hit FROM benchmark b LEFT JOIN m USING (item_id) LEFT JOIN g USING (item_id) GROUP BY b.item_id)"""
)
def benchmark_page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), documents_(spark, sf_dir).withColumn("page", F.col("doc_id") % 40)
    m = ingest.containing(d, b, "doc_id", "text", "item_id", "text", ["n_chars", "source", "page"])
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")))
    gold = ranked.groupBy("item_id").agg(F.min_by("source", "rank").alias("gold"), (F.min_by("page", "rank") + F.first(F.col("item_id") % 3)).alias("gold_page"))
    return retrieve.page_hit(b.select("item_id"), ranked, gold)


UNIT = "ヶ月|か月|カ月|箇月|万円|億円|千円|パーセント|％|%|割|円|日|年|歳|件|名|回|倍|点|口"
CLAIMS = "CASE doc_id % 4 WHEN 0 THEN '2. ' || text || chr(10) || '3点、第3条と別表第12は45円 [B42] (コード: E9)' WHEN 1 THEN text || ' ' || doc_id || '% of 1,200 and ' || (doc_id % 1000) ELSE text END"


@query(
    f"""WITH d AS (SELECT doc_id, {CLAIMS} AS a, CASE WHEN doc_id % 9 = 0 THEN '' ELSE substring(text, 1, 1500) || ' 200 45' END AS b FROM documents),
    f AS (SELECT doc_id, {FOLD.format(x="regexp_replace(regexp_replace(regexp_replace(a, '\\[本棚:[^\\]]*\\]', ' ', 'g'), '\\[[A-Za-z]{{1,3}}[0-9]{{1,7}}(?: 付近)?\\]|[(][A-Za-z]{{1,3}}[0-9]{{1,7}}(?: 付近)?[)]', ' ', 'g'), '\\(コード[:：][^)]*\\)', ' ', 'g')")} AS a, {FOLD.format(x="b")} AS b FROM d),
    c AS (SELECT doc_id, b, regexp_extract_all(regexp_replace(a, '(^|[\r\n])([ (（]*)[0-9](?:％|%|割|円|日|年|歳|件|名|回|倍|点|口)([.．)）、，])', '\1\2 \3', 'g'), '第[0-9]+[条項章号]|(?:別表|様式)第?[0-9]+|[0-9]+(?:[,.][0-9]+)*(?:{UNIT})?') AS c FROM f),
    m AS (SELECT doc_id, b, list_filter(list_transform(list_zip(c, range(1, len(c) + 1)), lambda z: CASE WHEN list_position(c, z[1]) = z[2] THEN z[1] END), lambda x: x IS NOT NULL AND (regexp_matches(x, '[^0-9.]') OR length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3)) AS c FROM c)
    SELECT doc_id, CASE WHEN b = '' THEN '' ELSE array_to_string(list_filter(c, lambda x: NOT contains(b, x) AND NOT (length(regexp_replace(x, '[^0-9,.]', '', 'g')) >= 2 AND contains(b, regexp_replace(x, '[^0-9,.]', '', 'g'))))[1:4], '|') END AS missing FROM m"""
)
def ungrounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and labels that a text claims and its beginning, as evidence, lacks; some without evidence."""
    i = F.col("doc_id")
    claims = F.when(i % 4 == 0, F.concat(F.lit("2. "), "text", F.lit("\n3点、第3条と別表第12は45円 [B42] (コード: E9)"))).when(i % 4 == 1, F.concat("text", F.lit(" "), i.cast("string"), F.lit("% of 1,200 and "), (i % 1000).cast("string"))).otherwise(F.col("text"))
    evidence = F.when(i % 9 == 0, "").otherwise(F.concat(F.substring("text", 1, 1500), F.lit(" 200 45")))
    return documents_(spark, sf_dir).select("doc_id", F.array_join(T.ungrounded(claims, evidence), "|").alias("missing"))


@query(f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE replace({FOLD.format(x="'Sum ' || source || text")}, ' ', '') END) AS norm_text FROM documents")
def norm_texts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_(spark, sf_dir).select("doc_id", "source", F.lit("Sum ").alias("summary"), F.lit(None).cast("string").alias("keywords"), F.col("text").alias("full_text"), F.when(F.col("doc_id") % 2 == 0, "kept").alias("norm_text"))
    return shelf.norm_filled(d).select("doc_id", F.md5("norm_text").alias("norm_text"))


@query("SELECT user_id, percent, percent >= 80 AS ok FROM (SELECT DISTINCT user_id, user_id % 101 AS percent FROM events)")
def similar_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.operators import links

    u = events_(spark, sf_dir).select("user_id").distinct().withColumn("percent", F.col("user_id") % 101)
    return u.select("user_id", "percent", links.similar(F.col("percent") / 100.0, 80).alias("ok"))


@query("SELECT user_id, 'u' || user_id AS name, count(*) AS n FROM events GROUP BY user_id")
def inbox_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small TSV files, one record each, written and read back."""
    path = folder(spark)
    u = events_(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    u.select(F.concat_ws("\t", F.col("user_id").cast("string"), text("u", F.col("user_id")), F.col("n").cast("string")).alias("value")).repartitionByRange(40, "value").write.options(**files.SMALL).option("maxRecordsPerFile", 1).text(path)
    r = files.inbox_files(spark, path, ["user_id", "name", "n"])
    return r.select(F.col("user_id").cast("long").alias("user_id"), "name", F.col("n").cast("long").alias("n"))

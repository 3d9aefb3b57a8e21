"""Queries over what readers do with files and pages: page marks, garbled pages, control characters, folders, workbooks, packs, sessions of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import ingest
from tessel.plans.base import ORACLE, query, table
from tessel.plans.rules import FNV, HEX
from tessel.plans.stores import FILES, parsed, shelved
from tessel.scratch import folder
from tessel.sources import files, workbook
from tessel.streaming import stream


def documents_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


PAGES = """f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(12) || ' ' || chr(12) ELSE '' END || replace(text, '. ', chr(12)) || chr(12) AS t FROM documents),
    p AS (SELECT doc_id, unnest(string_split(t, chr(12))) AS text, generate_subscripts(string_split(t, chr(12)), 1) AS page FROM f),
    b AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM p WHERE trim(text) <> '' GROUP BY doc_id)"""


def pages_of(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    fed = F.concat(F.when(F.col("doc_id") % 3 == 0, "\f \f").otherwise(""), F.replace("text", F.lit(". "), F.lit("\f")), F.lit("\f"))
    return ingest.form_feed_pages(documents_(spark, sf_dir).withColumn("text", fed), "doc_id", "text", most)


@query(f"WITH {PAGES} SELECT doc_id, page::INTEGER AS page, md5(text) AS text, b > 8 AS truncated FROM p JOIN b USING (doc_id) WHERE page BETWEEN a AND least(b, 8)")
def pages_between_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir, 8).select("doc_id", "page", F.md5("text").alias("text"), "truncated")


@query(f"WITH {PAGES} SELECT doc_id, page::INTEGER AS page, md5(text) AS text FROM p JOIN b USING (doc_id) WHERE page BETWEEN a AND b")
def pages_joined_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put into one text with marks, and taken apart again."""
    whole = ingest.join_pages(pages_of(spark, sf_dir, 1_000_000), ["doc_id"])
    return whole.select("doc_id", F.explode(ingest.split_pages(F.col("text"))).alias("p")).select("doc_id", "p.page", F.md5("p.text").alias("text"))


GARBLED = """g AS (SELECT doc_id, unnest([1, 2]) AS page, unnest([CASE WHEN doc_id % 4 < 2 THEN repeat('Жα' || chr(1), 40) || text ELSE text END, CASE doc_id % 4 WHEN 0 THEN repeat('�б ', 300) || left(text, 300) ELSE 'plain ' || text END]) AS text FROM documents),
    r AS (SELECT *, length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{0370}-\\x{03ff}\\x{0400}-\\x{04ff}\\x{e000}-\\x{f8ff}\\x{fffd}]', '', 'g')) AS bad, length(regexp_replace(text, '[ \\t\\r\\n\\x{3000}]', '', 'g')) AS n FROM g),
    j AS (SELECT *, length(text) >= 50 AND CASE WHEN n > 0 THEN bad / n::DOUBLE ELSE 0 END > 0.2 AS garbled FROM r), a AS (SELECT doc_id, bool_and(garbled) AS every FROM j GROUP BY doc_id)"""


def garbled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 4
    first = F.when(i < 2, F.concat(F.repeat(F.lit("Жα\x01"), F.lit(40)), "text")).otherwise(F.col("text"))
    second = F.when(i == 0, F.concat(F.repeat(F.lit("�б "), F.lit(300)), F.left("text", F.lit(300)))).otherwise(F.concat(F.lit("plain "), "text"))
    return documents_(spark, sf_dir).select("doc_id", F.posexplode(F.array(first, second)).alias("page", "text")).withColumn("page", F.col("page") + 1)


@query(f"WITH {GARBLED} SELECT doc_id, page, round(CASE WHEN n > 0 THEN bad / n::DOUBLE ELSE 0 END, 6) AS ratio FROM r")
def garble_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_pages(spark, sf_dir).select("doc_id", "page", F.round(T.garble_ratio("text"), 6).alias("ratio"))


@query(f"WITH {GARBLED} SELECT doc_id, page, every AS all_garbled FROM j JOIN a USING (doc_id) WHERE NOT garbled OR every")
def garbled_pages_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.drop_garbled(garbled_pages(spark, sf_dir), "doc_id", "text").select("doc_id", "page", "all_garbled")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(regexp_replace('a' || chr(7) || chr(127) || '  b' || replace(text, 'e', chr(1)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), ' {2,}', ' ', 'g') ELSE text END) AS text FROM documents")
def controls_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a\x07\x7f  b"), F.replace("text", F.lit("e"), F.lit("\x01")))).otherwise(F.col("text"))
    return documents_(spark, sf_dir).select("doc_id", F.md5(T.strip_controls(dirty)).alias("text"))


def shelf_of(spark: SparkSession, sf_dir: str) -> str:
    at = folder(spark, "shelf")
    shelved(documents_(spark, sf_dir), at)
    return at


@query(
    f"""SELECT DISTINCT 'f' || (doc_id % {FILES}) || CASE doc_id % {FILES} % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.xlsx' ELSE '.csv' END AS file_name, CASE doc_id % {FILES} % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'xlsx' ELSE 'csv' END AS ext FROM documents
    UNION ALL SELECT 'broken.xlsx', 'xlsx' UNION ALL SELECT 'scan.pdf', 'pdf'"""
)
def files_of_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a folder's files, each once, as large ones go on in folders below."""
    return files.folder(spark, shelf_of(spark, sf_dir)).select("file_name", "ext").distinct()


@query(f"SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents WHERE doc_id % {FILES} % 4 <> 2")
def texts_of_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files in UTF-8 and UTF-16, decoded and split into lines."""
    lines = files.text_files(spark, shelf_of(spark, sf_dir)).select(F.explode(F.split(F.regexp_replace("text", "\n\\z", ""), "\n")).alias("line"))
    return parsed(lines.select("line", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("error"))).select("doc_id", F.md5("text").alias("text"))


@query(f"SELECT doc_id, md5(coalesce(text, '')) AS text, CASE WHEN (row_number() OVER (PARTITION BY doc_id % {FILES} ORDER BY doc_id)) % 2 = 1 THEN 'First' ELSE 'Second & last' END AS sheet FROM documents WHERE doc_id % {FILES} % 4 = 2")
def sheets_of_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "shelf")
    shelved(documents_(spark, sf_dir), at)
    rows = workbook.sheet_lines(spark, at).filter("error IS NULL").withColumn("kind", F.lit("workbook"))
    return parsed(rows, "sheet").select("doc_id", F.md5("text").alias("text"), "sheet")


PII = """CASE WHEN regexp_matches(text, '[A-Za-z0-9.]@[A-Za-z0-9.]') AND regexp_matches(text, '(?s)^[^@]*@.*[.]') THEN 'email' WHEN regexp_matches(text, '([0-9][- ‐]*){10}') THEN 'number' END"""


@query(f"SELECT doc_id, source, md5(text) AS text, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE -1 END::INTEGER AS dims, 'me' AS author FROM documents WHERE source IN ('src1', 'SRC1') AND {PII} IS NULL AND doc_id % 5 <> 0")
def pack_of_a_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of one source's own chunks: refused with personal data among them, written and read back without."""
    d, i = documents_(spark, sf_dir), F.col("doc_id")
    chunks = d.select(i.cast("string").alias("chunk_id"), "source", F.when(i % 5 == 0, "pack:x").otherwise("Self").alias("origin"), F.lit(1).alias("page"), F.lit("").alias("summary"), F.lit("").alias("keywords"), F.col("text").alias("full_text"))
    vectors = d.filter(i % 2 == 0).select(i.cast("string").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    at = folder(spark, "pack")
    marked = chunks.withColumn("full_text", F.concat("full_text", F.lit(" a@b.cc")))
    try:
        files.write_pack(at, marked, vectors, "me", 2, "SRC1", "self")
    except ValueError:
        files.write_pack(at, chunks.filter(T.pii_kind("full_text").isNull()), vectors, "me", 2, "SRC1", "self")
    meta, pack = files.read_pack(spark, at, 2)
    return pack.select(F.col("chunk_id").cast("long").alias("doc_id"), "source", F.md5("full_text").alias("text"), F.coalesce(F.size("vector"), F.lit(-1)).alias("dims"), F.lit(meta["author"]).alias("author"))


@query(
    """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.event_stream(spark, sf_dir, "events.parquet")
    return stream.drained(stream.sessions(e, "ts", "user_id", "6 hours 1 microsecond", "40 days"), "complete").select("user_id", "start", "n")


NORM = "trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' ')"
ORACLE["doc_fnv_ids"] = f"WITH h AS (SELECT doc_id, {FNV.format(s=NORM)} AS h FROM documents) SELECT doc_id, {HEX.format(h='h')} AS fnv FROM h"

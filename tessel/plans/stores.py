"""Queries over queues, versions, the shelf's files, values over time, and functions called from SQL text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import python as P
from tessel.functions.python import small_batches, trimmed
from tessel.functions.register import register
from tessel.operators import history, worklog
from tessel.plans.base import ORACLE, query, table
from tessel.plans.rules import FNV, HEX
from tessel.scratch import folder
from tessel.sources import shelf_source, versions, workbook

# Queues


def service(texts: list[str]) -> list[list[float] | None]:
    """A service that has no answer for some texts, and is away when it meets `down`."""
    if any("\x00down" in t for t in texts):
        raise worklog.Unavailable
    return [None if len(t) % 13 == 0 else [float(len(t)), 1.0] for t in texts]


@query(
    """SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 13 = 0 THEN NULL ELSE length(coalesce(text, ''))::DOUBLE END AS first FROM documents"""
)
def queue_taken_up_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue whose first pass dies in the middle of a batch; the passes after go on from the batches that are committed, each row done once."""
    at, d = folder(spark, "queue"), table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = worklog.add(d.filter("doc_id % 3 <> 0"), at, "doc_id", "text", size=200)
    worklog.run(spark, at, service, most=1)

    def dying(texts: list[str]) -> list[list[float] | None]:
        raise RuntimeError("killed")

    try:
        worklog.run(spark, at, dying)
    except Exception as e:  # noqa: BLE001  what a lost pass raises here
        if "killed" not in str(e):
            raise
    rows += worklog.add(d, at, "doc_id", "text", size=200)
    for _ in range(max(3, -(-rows // 100_000))):  # a pass ends after 1000 batches with failures
        worklog.resume(spark, at)
        worklog.run(spark, at, service, failures=1000)
    made = worklog.results(spark, at).select(F.col("key").cast("long").alias("doc_id"), F.col("vector")[0].alias("first"))
    left = worklog.pending(spark, at).select(F.col("key").cast("long").alias("doc_id"), F.lit(None).cast("double").alias("first"))
    return made.unionByName(left)


@query("WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM documents) SELECT batches::BIGINT AS batches, done::BIGINT AS done, failed::BIGINT AS failed FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0)) t(i, done, failed), (SELECT 2 AS batches) b")
def queue_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a queue of two batches, done in two passes of one."""
    at, d = folder(spark, "queue"), table(spark, sf_dir, "documents").select("doc_id", F.lit("x").alias("text"))
    worklog.add(d, at, "doc_id", "text", size=-(-d.select("doc_id").distinct().count() // 2))
    for _ in range(2):
        worklog.run(spark, at, lambda texts: [[1.0] for _ in texts], most=1)
    return worklog.history(spark, at).select(F.col("batches").cast("long"), F.col("done").cast("long"), F.col("failed").cast("long"))


# Versions


@query(
    """SELECT 1::BIGINT AS version, doc_id, source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 2, doc_id, source FROM documents
    UNION ALL SELECT 3, doc_id, upper(source) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 4, doc_id, source FROM documents WHERE doc_id % 3 <> 0"""
)
def versions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of a table: published, changed while another writer was faster, rolled back."""
    at, d = folder(spark, "versions"), table(spark, sf_dir, "documents").select("doc_id", "source")
    versions.publish(d.filter("doc_id % 3 <> 0"), at)
    turns = []

    def change(rows: DataFrame) -> DataFrame:
        if not turns:
            versions.publish(d, at)
        turns.append(1)
        return rows.filter("doc_id % 2 = 0").withColumn("source", F.upper("source"))

    versions.updated(spark, at, change)
    versions.rolled_back(spark, at, 1)
    each = [versions.read(spark, at, n).select(F.lit(n).cast("long").alias("version"), "doc_id", "source") for n in range(1, 5)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


# The shelf's files

FILES = 24
#: Characters of a file after which the rest goes into one of the same name in a folder below.
PIECE = 4_000_000


def shelved(d: DataFrame, at: str) -> None:
    """Documents as files of several kinds, `FILES` names of them: UTF-8, UTF-16 with its mark, workbooks of two sheets, one that is none, and a picture. Files grow in number with the documents, not in size, and rows are streamed into them."""
    kinds, most = ("txt", "MD", "xlsx", "csv"), PIECE

    def put(n: int, piece: int, lines: list[list[str]]) -> None:
        kind = kinds[n % 4]
        if kind == "xlsx":
            content = workbook.made({"First": lines[::2], "Second & last": lines[1::2]})
        else:
            content = "".join(f"{a}\t{b}\n" for a, b in lines).encode("utf-16" if kind == "csv" else "utf-8")
        held, top = shelf_source.opened(at)
        into = f"{top}/part {n % 3}" + (f"/{piece}" if piece else "")
        held.create_dir(into, recursive=True)
        with held.open_output_stream(f"{into}/f{n}.{kind}") as out:
            out.write(content)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, lines, size = None, 0, [], 0
        rows = (r for b in batches for i in range(0, len(b), 100) for r in zip(*(c.to_pylist() for c in b.slice(i, 100).columns), strict=True))
        for n, k, line in rows:
            if n != now or size >= most and len(lines) % 2 == 0:  # an even number, as sheets take turns
                if lines:
                    put(now, piece, lines)
                    yield pa.RecordBatch.from_pydict({"n": [len(lines)]})
                now, piece, lines, size = n, piece + 1 if n == now else 0, [], 0
            lines.append([str(k), line])
            size += len(line)
        if lines:
            put(now, piece, lines)
            yield pa.RecordBatch.from_pydict({"n": [len(lines)]})

    line = F.replace(F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    rows = d.select(F.pmod("doc_id", F.lit(FILES)).cast("int").alias("file"), "doc_id", line.alias("line"))
    small_batches(rows).repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(trimmed(write), "n long").agg(F.sum("n")).collect()
    held, top = shelf_source.opened(at)
    for name in ("broken.xlsx", "scan.pdf", "~$open.xlsx", "notes.bak"):
        with held.open_output_stream(f"{top}/{name}") as out:
            out.write(b"no workbook")


def parsed(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of lines that shelved() wrote, and more of their columns."""
    cells = F.regexp_replace(F.regexp_replace("line", r"^\[A[0-9]+\]", ""), r"\t\[B[0-9]+\]", "\t")
    parts = F.split(F.when(F.col("kind") == "workbook", cells).otherwise(F.col("line")), "\t")
    back = F.replace(F.replace(F.replace(F.replace(F.replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("\\\\"), F.lit("\x01")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\t"), F.lit("\t")), F.lit("\x01"), F.lit("\\"))
    return rows.filter("error IS NULL").select(F.get(parts, F.lit(0)).cast("long").alias("doc_id"), back.alias("text"), *more)


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def shelf_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "shelf")
    shelved(table(spark, sf_dir, "documents"), at)
    shelf_source.register(spark)
    return parsed(spark.read.format("shelf").option("path", at).load()).select("doc_id", F.md5("text").alias("text"))


@query(
    """SELECT 'workbook' AS kind, 'xlsx' AS ext, count(*) AS rows, 0::BIGINT AS failed FROM documents WHERE doc_id % 24 % 4 = 2
    UNION ALL SELECT 'workbook', 'xlsx', 0, 1 UNION ALL SELECT 'other', 'pdf', 0, 1 UNION ALL SELECT 'text', 'md', count(*), 0 FROM documents WHERE doc_id % 24 % 4 = 1"""
)
def shelf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder holds by kind, failures included; options choose files before they are opened."""
    at = folder(spark, "shelf")
    shelved(table(spark, sf_dir, "documents"), at)
    shelf_source.register(spark)
    rows = spark.read.format("shelf").option("path", at).option("ext", "xlsx, pdf").load()
    some = rows.unionByName(spark.read.format("shelf").option("path", at).load().filter("ext = 'md'"))
    return some.groupBy("kind", "ext", F.col("error").isNotNull().alias("bad")).agg(F.count_if(F.col("error").isNull()).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failed")).drop("bad")


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents WHERE doc_id % 24 % 3 <> 1")
def shelf_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream over two of the three folders."""
    from tessel.streaming import stream

    at = folder(spark, "shelf")
    shelved(table(spark, sf_dir, "documents"), at)
    shelf_source.register(spark)
    rows = spark.readStream.format("shelf").option("path", f"{at}/part 0,{at}/part 2").load()
    return parsed(stream.drained(rows)).select("doc_id", F.md5("text").alias("text"))


# Values over time


@query(
    """WITH s AS (SELECT user_id, ts, max(event_id) AS setting FROM events WHERE event_type = 'signup' GROUP BY user_id, ts), l AS (SELECT * FROM events WHERE event_type <> 'signup')
    SELECT l.event_id, s.setting FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.ts"""
)
def settings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    settings = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("setting"))
    return history.as_of(e.filter("event_type <> 'signup'").select("event_id", "user_id", "ts"), settings, "user_id", "ts", ["setting"], size=500).select("event_id", "setting")


@query(
    """WITH s AS (SELECT 1 AS one, ts, max(event_id) AS setting FROM events WHERE event_type = 'error' GROUP BY ts), l AS (SELECT 1 AS one, * FROM events)
    SELECT l.event_id, s.setting FROM l ASOF LEFT JOIN s ON l.one = s.one AND l.ts > s.ts"""
)
def settings_before_in_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error before each event, over all users: one key holds every row, and is cut by time."""
    e = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    errors = e.filter("event_type = 'error'").select("one", "ts", F.col("event_id").alias("setting"))
    return history.as_of(e.select("event_id", "one", "ts"), errors, "one", "ts", ["setting"], strict=True, size=700).select("event_id", "setting")


@query(
    """WITH d AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type) SELECT event_type, n, users, true AS distinct_near, true AS median_near, true AS tail_near FROM d"""
)
def sketches_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sketches merged to months: exact numbers beside whether the estimates lie within their bounds (3 % of users, 2 % in rank)."""
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    days = history.sketched(e, ["event_type", F.to_date("ts").alias("day")], F.col("user_id"), F.col("value"))
    months = history.merged(days.withColumn("month", F.trunc("day", "month")), ["event_type", "month"])
    est = history.estimated(history.merged(months, ["event_type"]), ["event_type"])
    rank = e.join(est, "event_type").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.first("distinct").alias("guess"),
        *[f(F.when(c, 1).otherwise(0)).alias(x) for q in ("q50", "q90") for x, f, c in ((f"{q}_below", F.avg, F.col("value") < F.col(q)), (f"{q}_upto", F.avg, F.col("value") <= F.col(q)))],
    )
    near = lambda q, at: (F.col(f"{q}_below") <= at + 0.02) & (F.col(f"{q}_upto") >= at - 0.02)
    return rank.select("event_type", "n", "users", (F.abs(F.col("guess") - F.col("users")) <= F.greatest(F.lit(1), 0.03 * F.col("users"))).alias("distinct_near"), near("q50", 0.5).alias("median_near"), near("q90", 0.9).alias("tail_near"))


# Functions called from SQL text

FOLDED = "translate(text, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚABCDEFGHIJKLMNOPQRSTUVWXYZ　' || chr(9), '0123456789abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz  ')"


@query(
    f"""SELECT doc_id, md5({FOLDED}) AS folded, md5(replace({FOLDED}, ' ', '')) AS compacted, md5(trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' ')) AS hashed,
    ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS the, round(pow(least(n_chars % 12, 8), 1.5), 6) AS weight, floor(sqrt(n_chars / 100.0::DOUBLE))::BIGINT + 1 AS level,
    CASE doc_id % 3 WHEN 0 THEN '''=' || source ELSE source END AS safe, CASE doc_id % 3 WHEN 1 THEN '"' || source || ',"' ELSE CASE doc_id % 3 WHEN 0 THEN '''=' || source ELSE source END END AS field FROM documents"""
)
def text_functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql(
        """SELECT doc_id, md5(norm_search(text)) AS folded, md5(compact(text)) AS compacted, md5(norm_hash(text)) AS hashed, occurrences(text, 'the') AS the,
        round(key_weight(CAST(n_chars % 12 AS INT)), 6) AS weight, exp_level(n_chars) AS level,
        formula_safe(CASE doc_id % 3 WHEN 0 THEN '=' || source ELSE source END) AS safe, csv_safe(CASE doc_id % 3 WHEN 0 THEN '=' || source WHEN 1 THEN source || ',' ELSE source END) AS field FROM _documents"""
    )


@query(
    """SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot, bit_count(xor(e.vec_id, 12345))::INTEGER + bit_count(e.label)::INTEGER AS hamming
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""
)
def vector_functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("_embeddings")
    return spark.sql("SELECT e.vec_id, round(dot(e.embedding, q.embedding), 6) AS dot, hamming(array(e.vec_id, CAST(e.label AS BIGINT)), array(12345L, 0L)) AS hamming FROM _embeddings e, (SELECT embedding FROM _embeddings WHERE vec_id = 0) q")


NAMED = "source || '-' || lang || '-' || doc_id"


@query(f"SELECT doc_id, {HEX.format(h='h')} AS fnv FROM (SELECT doc_id, {FNV.format(s=NAMED)} AS h FROM documents)")
def names_hashed_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT doc_id, fnv1a64(concat(source, '-', lang, '-', doc_id)) AS fnv FROM _documents")


@query("SELECT DISTINCT source, 4 AS dims, 1.0::DOUBLE AS norm, true AS same FROM documents")
def mock_vectors_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of names: unit length, and the same as the plain function gives."""
    register(spark)
    table(spark, sf_dir, "documents").select("source").distinct().createOrReplaceTempView("_sources")
    rows = spark.sql("SELECT source, mock_embedding(source, 4) AS v FROM _sources")
    plain = F.udf(lambda s: P.mock_embedding(s, 4), "array<double>")
    return rows.select("source", F.size("v").alias("dims"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"), (F.col("v") == plain("source")).alias("same"))


CHUNKED = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
    c(doc_id, t, n, seq, start, stop) AS (
        SELECT doc_id, t, n, 0, 0, CASE WHEN 700 >= n THEN n ELSE coalesce(699 + nullif(length(regexp_extract(substring(t, 700, least(n, 875) - 699), '^[^.!?。！？\n]*[.!?。！？\n]')), 0), 700) END FROM d WHERE n > 0
        UNION ALL
        SELECT doc_id, t, n, seq + 1, s, CASE WHEN s + 700 >= n THEN n ELSE coalesce(s + 699 + nullif(length(regexp_extract(substring(t, (s + 700)::BIGINT, (least(n, s + 875) - s - 699)::BIGINT), '^[^.!?。！？\n]*[.!?。！？\n]')), 0), s + 700) END
        FROM (SELECT *, greatest(start + 1, stop - 150) AS s FROM c WHERE stop < n))"""

ORACLE["doc_chunks_fixed"] = f"{CHUNKED} SELECT doc_id, seq::INTEGER AS seq, start::BIGINT AS start, stop::BIGINT AS \"end\", substring(t, (start + 1)::BIGINT, (stop - start)::BIGINT) AS text FROM c"


@query(f"{CHUNKED} SELECT doc_id, seq::INTEGER AS seq, start::INTEGER AS start, stop::INTEGER AS stop, md5(substring(t, (start + 1)::BIGINT, (stop - start)::BIGINT)) AS text FROM c")
def chunks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT d.doc_id, c.seq, c.start, c.stop, md5(c.text) AS text FROM _documents d, LATERAL chunk_text(d.text, 700, 150) c")


@query(
    """WITH c AS (SELECT label, i, sum(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
    n AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS norm FROM c GROUP BY label), k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, k.n, round(n.v[1] / n.norm, 5) AS first, round(n.v[64] / n.norm, 5) AS last FROM n JOIN k USING (label)"""
)
def unit_means_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit means of vectors in SQL text: a table function sums parts of a group, an aggregate adds the parts up."""
    register(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("_embeddings")
    return spark.sql(
        """WITH p AS (SELECT * FROM vector_sums(TABLE(SELECT label, vec_id % 4 AS part, embedding FROM _embeddings) PARTITION BY (label, part), 'label', 'embedding')),
        u AS (SELECT label, vector_sum(concat(array(CAST(n AS DOUBLE)), total)) AS s FROM p GROUP BY label), v AS (SELECT label, CAST(s[0] AS BIGINT) AS n, unit(slice(s, 2, size(s))) AS v FROM u)
        SELECT label, n, round(v[0], 5) AS first, round(v[63], 5) AS last FROM v"""
    )

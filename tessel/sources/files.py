"""Sources and sinks: text folders with a choice of charset, spreadsheets' rows, packs, analytics files, manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions import text as X
from tessel.operators import sets

#: Extensions that a folder scan takes.
EXTENSIONS = ("txt", "md", "csv", "pdf", "doc", "docx", "xls", "xlsx", "xlsm", "png", "jpg", "jpeg", "html")
PLAIN = ("txt", "md", "csv", "html")
FORMAT_VERSION = 1
REPLACED = 0.02

#: Options for writing many files of a few bytes. A local folder gets no checksum files, whose writing and rights cost as much as the file's own; tasks move their own files to their
#: place, so the driver does not rename all of them one by one.
SMALL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.algorithm.version": "2"}

CHUNKS = T.StructType([T.StructField(n, t) for n, t in (("chunk_id", T.StringType()), ("source", T.StringType()), ("origin", T.StringType()), ("page", T.IntegerType()), ("summary", T.StringType()), ("keywords", T.StringType()), ("full_text", T.StringType()))])
VECTORS = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def folder(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, ext, modified_at, size of supported files; temporary ones are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.select("path", X.file_name("path").alias("file_name"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))
    f = f.withColumn("ext", F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)))
    return f.filter(F.col("ext").isin(*EXTENSIONS) & ~F.col("file_name").startswith("~$"))


def shift_jis(content: Column) -> Column:
    """Text of Shift-JIS bytes; an Arrow function, as the engine's own decoder doesn't know the charset."""

    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: x.decode("cp932", "replace"), na_action="ignore")

    return decode(content)


def decoded(content: Column) -> Column:
    """Text of bytes: by their mark, else UTF-8, unless that leaves many replacement characters and Shift-JIS fewer. Only bytes that this may help go through Python."""
    head = F.hex(F.substring(content, 1, 3))
    lossy = F.make_valid_utf8(content.cast("string"))
    marked = (head == "EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF")
    japanese = shift_jis(F.when(~marked & (X.replacement_ratio(lossy) > REPLACED), content))
    return (
        F.when(head == "EFBBBF", F.make_valid_utf8(F.substring(content, 4, 2_000_000_000).cast("string")))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(X.replacement_ratio(lossy) <= REPLACED, lossy)
        .when(X.replacement_ratio(japanese) < X.replacement_ratio(lossy), japanese)
        .otherwise(lossy)
    )


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, text of plain-text files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.withColumn("file_name", X.file_name("path")).filter(F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).isin(*PLAIN))
    return f.select("path", "file_name", decoded(F.col("content")).alias("text"))


def encrypted(content: Column) -> Column:
    """'plain' for zip-based office files, 'encrypted' for compound ones, else 'unknown'."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B"), "plain").when(head.startswith("D0CF11E0"), "encrypted").otherwise("unknown")


def sheet_row(cells: Column, row: Column) -> Column:
    """A spreadsheet row as TAB-joined cells, filled ones after their address; empty ones at the end are dropped; null for an empty row."""
    letter = lambda i: F.when(i < 26, F.char(i + 65)).otherwise(F.concat(F.char(F.floor(i / 26) + 64), F.char(i % 26 + 65)))
    named = F.transform(cells, lambda c, i: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("["), letter(i), row.cast("string"), F.lit("]"), c)).otherwise(F.lit("")))
    joined = F.regexp_replace(F.array_join(named, "\t"), "\t+$", "")
    return F.when(joined != "", joined)


def write_pack(path: str, chunks: DataFrame, vectors: DataFrame, author: str, dim: int, source: str | None = None, origin: str | None = None) -> None:
    """A pack: three tables in a folder. Chunks are chosen by source and origin in any case; a pack with personal data is refused."""
    if source is not None:
        chunks = chunks.filter(F.lower("source") == source.lower())
    if origin is not None:
        chunks = chunks.filter(F.lower("origin") == origin.lower())
    if not chunks.filter(X.pii_kind("full_text").isNotNull()).isEmpty():
        raise ValueError("the chunks hold personal data")
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi").write.mode("overwrite").parquet(f"{path}/vectors")
    meta = [("pack_format_version", str(FORMAT_VERSION)), ("embed_dim", str(dim)), ("author", author)]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_pack(spark: SparkSession, path: str, dim: int) -> tuple[dict[str, str], DataFrame]:
    """Its meta rows, and its chunks with vectors (the first of a repeated id); another format or dimension is refused."""
    meta = {r.key: r.value for r in spark.read.schema(META).parquet(f"{path}/meta").collect()}
    if meta.get("pack_format_version") != str(FORMAT_VERSION):
        raise ValueError("another pack format")
    if meta.get("embed_dim") != str(dim):
        raise ValueError("another vector dimension")
    vectors = spark.read.schema(VECTORS).parquet(f"{path}/vectors").select("chunk_id", "vector", F.struct("_metadata.file_path", "_metadata.row_index").alias("_at")).groupBy("chunk_id").agg(F.min_by("vector", "_at").alias("vector"))
    return meta, spark.read.schema(CHUNKS).parquet(f"{path}/chunks").join(vectors, "chunk_id", "left")


def imported(shelf: DataFrame, pack: DataFrame, origin: str, purge: list[str] | None = None) -> DataFrame:
    """The shelf with a pack's chunks of new content, under an origin; rows of purged origins leave first. Of chunks that repeat a content the one with the smallest chunk_id comes in."""
    kept = shelf.filter(~F.lower("origin").isin([p.lower() for p in purge])) if purge else shelf
    key = F.md5(X.norm_hash("full_text"))
    fresh = pack.withColumn("_h", key).join(kept.select(key.alias("_h")).distinct(), "_h", "left_anti")
    fresh = sets.deduplicated(fresh, ["_h"], ["chunk_id", "page"])
    fresh = fresh.withColumn("origin", F.lit(origin)).withColumn("embedded", F.col("vector").isNotNull())
    return kept.unionByName(fresh.select(*kept.columns))


def write_analytics(rows: DataFrame, path: str) -> None:
    """CSV with a header; text fields are made safe for spreadsheets, and every file begins with a byte-order mark, without which these misread UTF-8."""
    safe = [(F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) if t == "string" else F.col(c)).alias(c) for c, t in rows.dtypes]
    first = rows.columns[0]
    rows.select(*safe).withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def inbox_files(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """One-record TSV files as rows; records with too few fields are passed over."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.split(F.trim("value"), "\t").alias("f"))
    return t.filter(F.size("f") >= len(fields)).select(*[F.col("f")[i].alias(n) for i, n in enumerate(fields)])


def collected(spark: SparkSession, folders: dict[str, str], fields: list[str], me: list[str], seen: DataFrame, most: int = 60) -> DataFrame:
    """New posts of others in several folders (kind: path): kind, nonce, fields. A post is a file `<author>-<nonce>.txt` with one TAB-separated record.

    Own posts and those whose nonce is among `seen` (nonce), in any case, take no part; of the others a folder gives the first `most` by name, so what was seen
    long ago never keeps new ones out. Records with too few fields are passed over: a file that is still being written comes with the next pass. What came in has
    to be added to `seen` by the caller.
    """
    known = seen.select(F.lower("nonce").alias("_k")).distinct()
    out = None
    for kind, path in folders.items():
        t = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("nonce"), F.split(F.trim("value"), "\t").alias("f"))
        mine = F.lit(False)
        for m in me:
            mine = mine | F.lower("nonce").startswith(m.lower() + "-")
        new = t.filter(~mine).join(known, F.lower("nonce") == F.col("_k"), "left_anti").orderBy("nonce").limit(most)
        rows = new.filter(F.size("f") >= len(fields)).select(F.lit(kind).alias("kind"), "nonce", *[F.col("f")[i].alias(n) for i, n in enumerate(fields)])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no folders")
    return out


def pending_updates(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Subscribed channels whose remote version is known and another than the local one."""
    r = remote.select("channel", F.col("version").alias("remote"))
    return local.filter("subscribed").join(r, "channel").filter((F.col("remote") != "") & ~F.col("remote").eqNullSafe(F.col("version"))).select("channel", "version", "remote")

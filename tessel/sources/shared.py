"""Files in a shared folder: read and written with retries, and the catalogue of channels. Paths go through the file system that Spark has for them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIES, PAUSE = 3, 0.2


def retried(work: Callable[[], object], tries: int = TRIES, pause: float = PAUSE) -> object:
    """What work gives, tried again after a pause that doubles; the last failure is raised."""
    for i in range(tries):
        try:
            return work()
        except Exception:  # noqa: BLE001  whatever a share raises while others hold the file
            if i == tries - 1:
                raise
            time.sleep(pause * 2**i)
    raise ValueError("no tries")


def write_text(spark: SparkSession, path: str, text: str, tries: int = TRIES) -> None:
    """Writes a small text as one file, in UTF-8: beside its place first, then renamed over what is there in one step, so readers see all of it or the old one, and never nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")

    def work() -> None:
        fs = target.getFileSystem(conf)
        out = fs.create(aside, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(target), over)

    retried(work, tries)


def read_text(spark: SparkSession, path: str, tries: int = TRIES) -> str:
    """A small text file whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)

    def work() -> str:
        stream = source.getFileSystem(conf).open(source)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    return retried(work, tries)


def channels(spark: SparkSession, folder: str, marker: str = "version.txt", most: int = 40) -> tuple[DataFrame, int]:
    """channel and version of the sub-folders that hold a version file and whose name doesn't start with _, the first `most` by name, and how many were left out."""
    f = spark.read.option("wholetext", True).option("pathGlobFilter", marker).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", "\\s+$", "")).alias("version"))
    named = f.select(F.element_at(F.split("path", "/"), -2).alias("channel"), F.element_at(F.split("path", "/"), -3).alias("_parent"), "version")
    here = named.filter((F.col("_parent") == folder.rstrip("/").rsplit("/", 1)[-1]) & ~F.col("channel").startswith("_")).drop("_parent")
    n = here.count()
    return here.orderBy("channel").limit(most), max(0, n - most)

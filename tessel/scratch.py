"""Tables between steps: written to the folder that driver and executors share, read again, deleted when the driver's Python ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_opened: set[str] = set()


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a new local folder, which only a local session can use."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if top is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            top = held.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            own = tempfile.mkdtemp(prefix="tessel-scratch-")
            atexit.register(shutil.rmtree, own, True)
            sc.setCheckpointDir(own)
            top = sc._jsc.sc().getCheckpointDir().get()
    return top.rstrip("/")


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new place for a table or a folder of files, deleted by release() or at the end."""
    at = f"{shared(spark)}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _opened.add(at)
    return at


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table: cuts the lineage, and survives lost executors."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Deletes what folder() has named so far."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in sorted(_opened):
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
    _opened.clear()


def _release_at_exit() -> None:
    spark = SparkSession._instantiatedSession
    if spark is not None and _opened and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)


atexit.register(_release_at_exit)

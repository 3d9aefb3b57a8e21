"""What several operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_opened: set[str] = set()
#: Rows in an Arrow batch to or from Python: documents are long, so batches of the usual 10,000 rows would hold tens of megabytes each, twice in Python and once outside the heap.
ROWS = "1000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new local one, which only a local session can use."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            own = tempfile.mkdtemp(prefix="tessel-")
            atexit.register(shutil.rmtree, own, True)
            sc.setCheckpointDir(own)
            base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application has written with written()."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for top in sorted(_opened):
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)
        _opened.discard(top)


def _release_at_exit() -> None:
    spark = SparkSession._instantiatedSession
    if spark is not None and _opened and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)


atexit.register(_release_at_exit)


def ready(df: DataFrame) -> DataFrame:
    """df; Python functions made from now on find this package on workers that share the driver's folders, and get small batches unless the session sets their size."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/tessel-{spark.sparkContext.applicationId}"
    _opened.add(top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, after which the worker gives the memory it no longer needs back to the machine: workers outlive tasks, and what they keep counts against the executor."""

    def all_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return all_rows


def free(name: str, df: DataFrame) -> str:
    """A name like the given one that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

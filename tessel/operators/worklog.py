"""Resumable work: rows are cut into batches, committed under their numbers, so a pass that dies goes on where it stopped.

A queue is a folder: `todo` holds the rows with their batch, `batch-<number>-<attempt>` what an attempt made, and the log (tessel.sources.versions) which
attempt of a batch counts. An attempt is one Spark job and one commit over a group of batches: as many as may fail at first, twice as many after each group
without failure, GROUP at most, so the number of jobs does not grow with that of batches. A batch is committed once: of two passes that work at the same time the second sees a Conflict, and its result is
thrown away. Rows that the service left without an answer are no part of a committed result; a later pass takes them up as a batch of their own.

Failures: the service raises Unavailable; any other exception is a fault of the code and ends the pass with nothing committed. The count of failed
batches in a row is in the log, so it holds for the whole queue and over passes; at FAILURES the pass stops, and an explicit
resume() lets it go on. Within a batch calls hold CALL texts each, and go on after a failed one until FAILURES of a task fail in a row.

Defined cases: null texts are embedded as empty; rows with a null key are left out, of rows that repeat a key one is done; adding keys that are there already does
nothing; an empty queue has no batches; batches are dealt by a hash of the key, about `size` rows each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessel.sources.versions import Conflict, Log

CALL, FAILURES, SIZE, GROUP = 128, 3, 100_000, 1024

Embed = Callable[[list[str]], list[list[float] | None]]


class Unavailable(Exception):
    """The service can't answer now."""


def _state(log: Log) -> dict:
    at = log.current()
    return log.payload(at) if at else {"batches": {}, "parts": [], "failed": 0}


def add(rows: DataFrame, path: str, key: str, text: str, size: int = SIZE) -> int:
    """Puts rows into the queue that are not in it yet; returns how many."""
    spark = rows.sparkSession
    log = Log(spark, path)
    new = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    state = _state(log)
    if state["parts"]:
        new = new.join(_todo(spark, path, state).select("key"), "key", "left_anti")
    part, n = f"todo-{uuid.uuid4().hex}", new.count()
    if not n:
        return 0
    first, many = len(state["batches"]), -(-n // size)
    new.select("key", "text", (F.lit(first) + F.pmod(F.xxhash64("key"), F.lit(many))).cast("int").alias("batch")).write.parquet(f"{path}/{part}")
    log.committed(lambda p: _with(p, parts=[*(p or {}).get("parts", []), part], batches={**(p or {}).get("batches", {}), **{str(first + i): None for i in range(many)}}))
    return n


def _with(payload: dict | None, **changes: object) -> dict:
    return {"batches": {}, "parts": [], "failed": 0} | (payload or {}) | changes


def _todo(spark: SparkSession, path: str, state: dict) -> DataFrame:
    return spark.read.schema(TODO).parquet(*[f"{path}/{p}" for p in state["parts"]])


TODO = t.StructType([t.StructField("key", t.StringType()), t.StructField("text", t.StringType()), t.StructField("batch", t.IntegerType())])
OUT = t.StructType([t.StructField("key", t.StringType()), t.StructField("vector", t.ArrayType(t.DoubleType()))])
MADE = t.StructType([*OUT, t.StructField("batch", t.IntegerType())])


def _called(rows: DataFrame, embed: Embed, call: int, failures: int) -> DataFrame:
    """key, vector (null where the service failed) and batch."""

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for b in batches:
            texts, vectors = b.column(1).to_pylist(), []
            for i in range(0, len(texts), call):
                part = texts[i : i + call]
                made: list = [None] * len(part)
                if failed < failures:
                    try:
                        made, failed = list(embed(part)), 0
                    except Unavailable:
                        failed += 1
                vectors += made
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64())), b.column(2)], names=["key", "vector", "batch"])

    return rows.select("key", "text", "batch").mapInArrow(passed, MADE)


def run(spark: SparkSession, path: str, embed: Embed, call: int = CALL, failures: int = FAILURES, most: int | None = None) -> dict:
    """One pass over the batches that are open, `most` of them at most; returns what it did."""
    log = Log(spark, path)
    done = {"committed": 0, "failed": 0, "lost": 0}
    left = sorted((int(b) for b, made in _state(log)["batches"].items() if made is None))
    many = 0
    while left:
        state = _state(log)
        room = failures - state["failed"]
        if most is not None:
            room = min(room, most - done["committed"] - done["failed"])
        if room <= 0:
            break
        many = min(max(many, failures - state["failed"]), GROUP, len(left), len(left) if most is None else most - done["committed"] - done["failed"])
        group, left = [n for n in left[:many] if state["batches"].get(str(n)) is None], left[many:]
        if not group:
            continue
        attempt = f"batch-{group[0]}-{uuid.uuid4().hex}"
        todo = _todo(spark, path, state).filter(F.col("batch").isin(group))
        _called(todo, embed, call, failures).write.parquet(f"{path}/{attempt}")
        made = spark.read.schema(MADE).parquet(f"{path}/{attempt}")
        counts = {r.batch: r for r in made.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("vector").isNull()).alias("missing")).collect()}  # a row a batch of the group
        some = [n for n in group if n in counts and 0 < counts[n].missing < counts[n].n]
        again = None
        if some:
            again = f"todo-{uuid.uuid4().hex}"
            missing = made.filter(F.col("vector").isNull() & F.col("batch").isin(some)).select("key")
            todo.filter(F.col("batch").isin(some)).join(missing, "key", "left_semi").write.parquet(f"{path}/{again}-made")

        def change(p: dict | None, group: list[int] = group, attempt: str = attempt, counts: dict = counts, some: list[int] = some, again: str | None = again) -> dict:
            batches, parts, failed = dict(p["batches"]), p["parts"], p["failed"]
            free = [n for n in group if batches.get(str(n)) is None]
            if not free:
                raise Conflict(f"batches {group} are committed")
            renamed: dict[int, int] = {}
            for n in free:
                lacks = counts[n].missing if n in counts else 0
                if failed < failures:
                    failed = failed + 1 if lacks else 0
                if lacks and lacks == counts[n].n:
                    continue  # nothing made: the batch stays open
                batches[str(n)] = attempt
                if lacks:
                    renamed[n] = max(map(int, batches)) + 1
                    batches[str(renamed[n])] = None
            if renamed:
                part = f"{again}-{uuid.uuid4().hex}"
                numbers = spark.createDataFrame(sorted(renamed.items()), "batch int, again int")
                rows = spark.read.schema(TODO).parquet(f"{path}/{again}-made").join(F.broadcast(numbers), "batch")
                rows.select("key", "text", F.col("again").alias("batch")).write.parquet(f"{path}/{part}")
                parts = [*parts, part]
            taken.append(free)
            return _with(p, batches=batches, parts=parts, failed=failed)

        taken: list[list[int]] = []
        try:
            log.committed(change)
            mine = taken[-1]
        except Conflict:
            mine = []
        bad = sum(n in counts and counts[n].missing > 0 for n in mine)
        done["failed"] += bad
        done["committed"] += len(mine) - bad
        done["lost"] += len(group) - len(mine)
        many = many if bad else 2 * many
    return done


def resume(spark: SparkSession, path: str) -> None:
    """Forgets the failures, so that passes call the service again."""
    Log(spark, path).committed(lambda p: _with(p, failed=0))


def results(spark: SparkSession, path: str) -> DataFrame:
    """key and vector of all committed work."""
    made = [(m, int(n)) for n, m in _state(Log(spark, path))["batches"].items() if m]
    if not made:
        return spark.createDataFrame([], OUT)
    counted = F.broadcast(spark.createDataFrame(made, "attempt string, counted int"))
    rows = spark.read.schema(MADE).parquet(*sorted({f"{path}/{m}" for m, _ in made})).withColumn("at", F.regexp_extract("_metadata.file_path", "/(batch-[^/]*)/[^/]*$", 1))
    # an attempt's rows count for the batches that were committed with it; attempts of one batch have no column of its number
    rows = rows.join(counted, (F.col("at") == F.col("attempt")) & (F.col("batch").isNull() | (F.col("batch") == F.col("counted"))), "left_semi")
    return rows.filter("vector IS NOT NULL").select("key", "vector")


def pending(spark: SparkSession, path: str) -> DataFrame:
    """key and text of what is not done."""
    state = _state(Log(spark, path))
    if not state["parts"]:
        return spark.createDataFrame([], "key string, text string")
    return _todo(spark, path, state).select("key", "text").join(results(spark, path).select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """A row per commit of the queue: number, batches in all, batches done, failures in a row."""
    log = Log(spark, path)
    rows = [(n, len(p["batches"]), sum(m is not None for m in p["batches"].values()), p["failed"]) for n in log.numbers() for p in [log.payload(n)]]
    return spark.createDataFrame(rows, "number int, batches int, done int, failed int")

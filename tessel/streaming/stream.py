"""Streams: event-time windows, deduplicated inboxes, latest records, session state.

Every function takes a streaming DataFrame and returns one, so the caller chooses sink and trigger; drained() runs one
over all that is there now and gives the result as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel import scratch


def event_stream(spark: SparkSession, folder: str, name: str, ts: str = "ts") -> DataFrame:
    """The Parquet file `name` of a folder as a stream, its time column as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 16).parquet(folder)
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, ts: str, keys: list[str], size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and keys; late rows count until the watermark has passed their window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def inbox(messages: DataFrame, nonce: str, ts: str, keep: str) -> DataFrame:
    """Messages whose nonce was not seen within `keep`, blanks and case aside."""
    key = F.lower(F.trim(nonce))
    return messages.withWatermark(ts, keep).withColumn("_nonce", key).filter(F.col("_nonce") != "").dropDuplicatesWithinWatermark(["_nonce"]).drop("_nonce")


def latest(records: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """The last record of each key, for complete or update mode."""
    return records.groupBy(key).agg(F.max(F.struct(ts, *columns)).alias("b")).select(key, f"b.{ts}", *[f"b.{c}" for c in columns])


#: Groups of keys whose state is one row. A call costs milliseconds whatever it does, so calls grow with batches, not with keys.
BUCKETS = 1024


def suppressed(events: DataFrame, keys: list[str], ts: str, order: str, hours: int) -> DataFrame:
    """Events, in append mode, without one of the same keys strictly within the hours before; state holds the last time per key in a row per bucket of keys, and ends a day after."""
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    out = ", ".join(f"{k} {types[k]}" for k in [*keys, order]) + f", {ts} timestamp"
    limit = pd.Timedelta(hours=hours)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.DataFrame() if state.hasTimedOut else pd.concat(list(frames)).sort_values([ts, order])
        keep = []
        for k, t, us in zip(rows["_key"], rows[ts], (rows[ts].to_numpy("datetime64[us]").astype("int64")).tolist(), strict=True) if len(rows) else ():
            last = held.get(k)
            keep.append(last is None or not pd.Timestamp(last, unit="us") > t - limit)
            held[k] = us if last is None or us > last else last
        now = state.getCurrentWatermarkMs()
        end = lambda us: us // 1000 + hours * 3_600_000 + 1
        held = {k: us for k, us in held.items() if end(us) > now}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(end(min(held.values())), now + 1))
        else:
            state.remove()
        if len(rows):
            yield rows[keep][[*keys, order, ts]]

    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    each = events.withWatermark(ts, f"{hours} hours").select(*dict.fromkeys([*keys, order, ts]), key.alias("_key"))
    return each.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int")).groupBy("_bucket").applyInPandasWithState(step, out, "keys array<string>, last array<long>", "append", "EventTimeTimeout")


def used_chunks(turns: DataFrame, session: str, ts: str, chunk: str, minutes: int = 30) -> DataFrame:
    """session, chunk, seen_before: whether a chunk was used earlier in a session; a session's memory ends after `minutes` of silence."""
    types = {f.name: f.dataType.simpleString() for f in turns.schema}
    out = f"{session} {types[session]}, {chunk} {types[chunk]}, seen_before boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        last, used = state.get if state.exists else (0, [])
        seen, flags = set(used), []
        rows = pd.concat(list(frames)).sort_values(ts)
        for t, c in zip(rows[ts], rows[chunk], strict=True):
            ms = int(t.value // 1_000_000)
            if last and ms - last > minutes * 60_000:
                seen = set()
            flags.append(str(c) in seen)
            seen.add(str(c))
            last = ms
        state.update((last, sorted(seen)))
        state.setTimeoutTimestamp(max(last + minutes * 60_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[[session, chunk]].assign(seen_before=flags)

    return turns.withWatermark(ts, f"{minutes} minutes").groupBy(session).applyInPandasWithState(step, out, "last long, used array<string>", "append", "EventTimeTimeout")


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """All of a stream's present input, run to its end. Append mode writes files, complete mode gives the last batch, update mode the last row of each of the keys."""
    spark = stream.sparkSession
    if mode == "update" and not keys:
        raise ValueError("update mode needs keys to merge its batches by")
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}" if folder else scratch.folder(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    elif mode == "complete":
        w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    else:
        w.foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/out/part={i}")).start().awaitTermination()
        rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])).option("recursiveFileLookup", True).parquet(f"{at}/out")
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in stream.columns]), "_batch").alias("_r")).select("_r.*")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")

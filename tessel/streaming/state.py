"""State by buckets of keys, with timeouts by event time.

What is remembered of nonces, open runs and the chunks of open sessions is a row per bucket of keys; it travels with the bucket's new rows, where a processor would ask for each
value of each key through a socket. Needs the RocksDB state store, which `session_for_state` sets. A bucket wakes when the watermark has passed its first end, so what a batch
gives depends on event times only, not on when it runs.

Defined cases: rows with a null key or time are left out; within a batch rows of a key are taken by time, then by the tie column; a row as late as
the watermark is dropped by Spark before it gets here; empty batches give nothing; other columns pass through where a function says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of keys whose state is one row. A call costs milliseconds whatever it does, so calls grow with batches, not with keys.
BUCKETS = 4096
#: The same for nonces of a key, which have nothing to do with each other: small rows.
NONCES = 65_536
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session like the given one, its settings included, whose streams keep their state in RocksDB. A batch opens and commits a store for each shuffle partition, so their number must be the one that was set."""
    s = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if s.conf.isModifiable(name):
            s.conf.set(name, value)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return s


def _times(rows: pd.DataFrame, ts: str) -> list[int]:
    """Milliseconds."""
    return (rows[ts].to_numpy("datetime64[ns]").astype(np.int64) // 1_000_000).tolist()


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    frames = list(rows)
    return pd.concat(frames).sort_values(by, kind="stable") if frames else pd.DataFrame()


def _bucket(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _until(state: Any, end: int) -> None:
    """Wakes a bucket as soon as the watermark has passed `end`."""
    state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))


def used_chunks(turns: DataFrame, session: str, chunk: str, ts: str, minutes: int = 30, delay: str = "30 minutes") -> DataFrame:
    """session, chunk, ts, seen_before: whether a chunk was used earlier in a session whose pauses are no longer than `minutes`."""
    kinds, span = dict(turns.dtypes), minutes * 60_000
    rows = turns.filter(F.col(session).isNotNull() & F.col(ts).isNotNull() & F.col(chunk).isNotNull()).select(session, chunk, ts).withWatermark(ts, delay)
    out = f"{session} {kinds[session]}, {chunk} {kinds[chunk]}, {ts} timestamp, seen_before boolean"

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = {k: (last, set(used)) for k, last, used in zip(*state.get, strict=True)} if state.exists else {}
        frame = pd.DataFrame() if state.hasTimedOut else _sorted(frames, [ts, chunk])
        flags = []
        for k, at, c in zip(frame[session].tolist(), _times(frame, ts), map(str, frame[chunk]), strict=True) if len(frame) else ():
            last, used = held.get(k, (at, set()))
            if at - last > span:
                used = set()
            flags.append(c in used)
            used.add(c)
            held[k] = max(last, at), used
        now = state.getCurrentWatermarkMs()
        open_ = [(k, last, sorted(used)) for k, (last, used) in held.items() if last + span + 1 > now]
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            _until(state, min(last for _, last, _ in open_) + span)
        else:
            state.remove()
        if len(frame):
            yield frame[[session, chunk, ts]].assign(seen_before=flags)

    return rows.withColumn("_bucket", _bucket(BUCKETS, session)).groupBy("_bucket").applyInPandasWithState(step, out, f"keys array<{kinds[session]}>, last array<long>, used array<array<string>>", "append", "EventTimeTimeout")


def lapsed(rows: DataFrame, key: str, ts: str, minutes: int = 30, delay: str = "30 minutes") -> DataFrame:
    """key, opened, closed, n: runs of a key's rows with pauses of no more than `minutes`, given when a run has lapsed by event time; the last ones stay open until later rows push the watermark past them."""
    kinds, span = dict(rows.dtypes), minutes * 60_000
    each = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts).withWatermark(ts, delay)

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            held += [(k, at, at, 1) for frame in frames for k, at in zip(frame[key].tolist(), _times(frame, ts), strict=True)]
        runs: list[list] = []
        for k, opened, closed, n in sorted(held):
            if runs and k == runs[-1][0] and opened - runs[-1][2] <= span:
                runs[-1][2:] = [max(runs[-1][2], closed), runs[-1][3] + n]
            else:
                runs.append([k, opened, closed, n])
        now = state.getCurrentWatermarkMs()
        done, open_ = [r for r in runs if r[2] + span + 1 <= now], [r for r in runs if r[2] + span + 1 > now]
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            _until(state, min(r[2] for r in open_) + span)
        else:
            state.remove()
        if done:
            at = lambda i: pd.to_datetime([r[i] for r in done], unit="ms")
            yield pd.DataFrame({key: [r[0] for r in done], "opened": at(1), "closed": at(2), "n": [r[3] for r in done]})

    return each.withColumn("_bucket", _bucket(BUCKETS, key)).groupBy("_bucket").applyInPandasWithState(step, f"{key} {kinds[key]}, opened timestamp, closed timestamp, n long", f"keys array<{kinds[key]}>, opened array<long>, closed array<long>, n array<long>", "append", "EventTimeTimeout")


def remembered(messages: DataFrame, key: str, nonce: str, ts: str, minutes: int, delay: str = "30 minutes") -> DataFrame:
    """messages (key, nonce, ts) with repeats of a key's nonce, in any case and with any spaces around, within the span left out; empty nonces are. State holds when a nonce was last let through, and ends with the span."""
    kinds, span = dict(messages.dtypes), minutes * 60_000
    rows = messages.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(nonce).isNotNull()).select(key, nonce, ts).withWatermark(ts, delay)

    @F.pandas_udf("string")
    def plain(n: pd.Series) -> pd.Series:
        return n.map(lambda x: str(x).strip().lower())

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = {(k, n): at for k, n, at in zip(*state.get, strict=True)} if state.exists else {}
        parts = [] if state.hasTimedOut else list(frames)
        frame = (parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)) if parts else pd.DataFrame()
        keep = []
        if len(frame):
            ns = frame[ts].to_numpy("datetime64[ns]").astype(np.int64).tolist()
            for at, _, k, n, i in sorted(zip(ns, frame[nonce].tolist(), frame[key].tolist(), frame["_nonce"].tolist(), range(len(ns)), strict=True)):
                before = held.get((k, n))
                if n != "" and (before is None or at // 1_000_000 - before > span):
                    keep.append(i)
                    held[k, n] = at // 1_000_000
        now = state.getCurrentWatermarkMs()
        open_ = [(k, n, at) for (k, n), at in held.items() if at + span + 1 > now]
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            _until(state, min(at for _, _, at in open_) + span)
        else:
            state.remove()
        if keep:
            yield frame[[key, nonce, ts]].take(keep)

    each = rows.withColumn("_nonce", plain(nonce)).withColumn("_bucket", _bucket(NONCES, key, "_nonce"))
    return each.groupBy("_bucket").applyInPandasWithState(step, f"{key} {kinds[key]}, {nonce} {kinds[nonce]}, {ts} timestamp", f"keys array<{kinds[key]}>, nonces array<string>, at array<long>", "append", "EventTimeTimeout")


def replies(questions: DataFrame, answers: DataFrame, key: str, asked: str, replied: str, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Two streams joined by key and time: each question with its answers up to `minutes` later, and questions without any once that time has passed. Both sides' state ends by their watermarks."""
    kept = lambda df, ts: df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    q, a = kept(questions, asked).alias("q"), kept(answers, replied).alias("a")
    within = (F.col(f"q.{key}") == F.col(f"a.{key}")) & (F.col(f"a.{replied}") >= F.col(f"q.{asked}")) & (F.col(f"a.{replied}") <= F.col(f"q.{asked}") + F.expr(f"INTERVAL {minutes} MINUTES"))
    rest = [c for c in answers.columns if c != key]
    return q.join(a, within, "leftOuter").select("q.*", *[F.col(f"a.{c}") for c in rest])

"""Work that goes on over several runs: the embedding queue, the bundled seed, published telemetry, typed settings, cache stamps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import sets

BATCH, FAILURES = 128, 3


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float] | None]], batch: int = BATCH, failures: int = FAILURES) -> DataFrame:
    """rows (with columns embedded and vector) after one pass of the queue: rows not embedded yet get a vector each.

    Every task hands `batch` texts at a time to embed; a call that raises leaves its rows pending, and after `failures` of them in
    a row the task stops calling, so its other rows wait for the next pass. Rows that are embedded pass through.
    """
    names = rows.columns
    at, into, flag = names.index(text), names.index("vector"), names.index("embedded")
    waiting = ~F.coalesce(F.col("embedded").cast("boolean"), F.lit(False))

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for b in batches:
            texts, vectors = b.column(at).to_pylist(), []
            for i in range(0, len(texts), batch):
                part = [t or "" for t in texts[i : i + batch]]
                made: list = [None] * len(part)
                if failed < failures:
                    try:
                        made, failed = list(embed(part)), 0
                    except Exception:  # noqa: BLE001  any failure of the service leaves the rows pending
                        failed += 1
                vectors += made
            columns = list(b.columns)
            columns[into] = pa.array(vectors, b.schema.field(into).type)
            columns[flag] = pa.array([v is not None for v in vectors], b.schema.field(flag).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return rows.filter(~waiting).unionByName(rows.filter(waiting).mapInArrow(passed, rows.schema))


def marked_again(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """rows to be embedded anew: all of them, or those of a condition."""
    here = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return rows.withColumn("embedded", F.when(here, False).otherwise(F.col("embedded")))


def seeded(shelf: DataFrame, seed: DataFrame, done: bool) -> DataFrame:
    """The shelf with the bundled seed's chunks of new content, once: a shelf that took it before stays as it is."""
    if done:
        return shelf
    key = F.md5(T.norm_hash("full_text"))
    fresh = sets.deduplicated(sets.new_rows(seed.withColumn("_h", key), shelf.select(key.alias("_h")), ["_h"]), ["_h"], ["chunk_id"]).drop("_h")
    return shelf.unionByName(fresh.select(*shelf.columns))


def published(files: DataFrame, record: DataFrame, key: str = "user_id", at: str = "at") -> DataFrame:
    """Telemetry of all users, a row each: the record of a user replaces what they had, unless that is newer."""
    rows = files.withColumn("_new", F.lit(0)).unionByName(record.withColumn("_new", F.lit(1)))
    latest = rows.groupBy(F.lower(key).alias("_k")).agg(F.max(F.struct(F.col(at).alias("_at"), "_new", F.struct(*[F.col(c) for c in files.columns]).alias("_r"))).alias("_b"))
    return latest.select("_b._r.*")


def feedback_list(files: DataFrame, name: str, most: int = 20) -> DataFrame:
    """The newest feedback: the last `most` files by name."""
    return files.orderBy(F.desc(name)).limit(most)


def setting(value: Column, default: int | float | bool | str) -> Column:
    """A setting's text as the type of its default: numbers that can't be read, or whole ones beyond 32 bits, give the default, halves go to the even one, switches are on for true, on, yes and numbers but 0."""
    t = F.lower(F.trim(value))
    if isinstance(default, bool):
        n = t.try_cast("double")
        return F.when(n.isNotNull(), F.bround(n, 0) != 0).when(t.isin("true", "on", "yes"), True).when(t.isin("false", "off", "no"), False).otherwise(default)
    if isinstance(default, int):
        n = t.try_cast("double")
        return F.when(n.between(-(2.0**31), 2.0**31 - 1), F.bround(n, 0).cast("long")).otherwise(F.lit(default).cast("long"))
    if isinstance(default, float):
        return F.coalesce(t.try_cast("double"), F.lit(default))
    return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)


def settings_put(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """settings (key, value) with changes; a key is the same in any case, and keeps the spelling it had. Of changes to one key the last by `at` counts."""
    last = changes.filter(F.trim("key") != "").groupBy(F.lower(F.trim("key")).alias("_k")).agg(F.max_by(F.struct("key", "value"), "at").alias("_n"))
    met = settings.select(F.lower(F.trim("key")).alias("_k"), "key", "value").join(last, "_k", "full_outer")
    return met.select(F.coalesce("key", F.trim("_n.key")).alias("key"), F.when(F.col("_n").isNotNull(), F.col("_n.value")).otherwise(F.col("value")).alias("value"))


def stamp(rows: DataFrame, key: str, per: list[str] | None = None) -> DataFrame:
    """What tells whether a cache of rows is stale: their number, first and last key in one text; empty without rows. With `per`, a stamp for each group."""
    made = F.when(F.count("*") > 0, F.concat_ws("|", F.count("*").cast("string"), F.min(key).cast("string"), F.max(key).cast("string"))).otherwise("").alias("stamp")
    return rows.groupBy(*per).agg(made) if per else rows.agg(made)


def stale(built: Column, built_stamp: Column, built_generation: Column, now_stamp: Column, now_generation: Column) -> Column:
    """Whether a cache must be built anew: never built, no stamp now, or another stamp or generation."""
    return ~built | (now_stamp == "") | (built_stamp != now_stamp) | (built_generation != now_generation)

"""Stateful streams replayed batch by batch, late rows included: the same rows as SQL over what was in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.plans.base import query, table
from tessel.scratch import folder
from tessel.streaming import state, stream

BATCHES = 5


def arrival(late: bool) -> Column:
    """The batch in which a row arrives: six days each; some rows come two batches late."""
    of = F.least(F.floor((F.dayofmonth("ts") - 1) / 6).cast("int"), F.lit(BATCHES - 1))
    return F.least(of + F.when(F.col("event_id") % 40 == 7, 2).otherwise(0), F.lit(BATCHES - 1)) if late else of


def replayed(rows: DataFrame, batch: Column, session: SparkSession) -> DataFrame:
    """rows as a stream of one file a batch."""
    at = folder(rows.sparkSession, "replay")
    for b in range(BATCHES):
        rows.filter(batch == b).repartition(1).write.mode("append").parquet(f"{at}/batch-{b}")
    return session.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(at)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


#: The watermark by which a batch's late rows are told is that of what had arrived two batches before; of two streams the slower one's counts.
ARRIVED = """a AS (SELECT *, least((day(ts) - 1) // 6, 4) + CASE WHEN event_id % 40 = 7 THEN 2 ELSE 0 END AS b0 FROM events WHERE {rows}), e AS (SELECT *, least(b0, 4) AS b FROM a),
    m AS (SELECT x.b, min(y.m) AS m FROM (SELECT DISTINCT b FROM e) x JOIN (SELECT p.b, q.side, max(q.ts) AS m FROM (SELECT DISTINCT b FROM e) p JOIN (SELECT *, {side} AS side FROM e) q ON q.b <= p.b GROUP BY ALL) y ON x.b = y.b GROUP BY x.b),
    t AS (SELECT e.*, (SELECT max(m.m) FROM m WHERE m.b < e.b - 1) AS high FROM e),
    k AS (SELECT * FROM t WHERE high IS NULL OR ts > date_trunc('millisecond', high) - INTERVAL {delay}), w AS (SELECT date_trunc('millisecond', max(m)) - INTERVAL {delay} AS last FROM m)"""


@query(
    """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events),
    r AS (SELECT *, sum(CASE WHEN epoch_ms(ts) - epoch_ms(before) > 10800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS run FROM l)
    SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, run, event_type ORDER BY ts) > 1 AS seen_before FROM r"""
)
def state_used_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replayed(events(spark, sf_dir), arrival(False), state.session_for_state(spark))
    return stream.drained(state.used_chunks(s, "user_id", "event_type", "ts", 180))


@query(
    f"""WITH {ARRIVED.format(delay="'3 days'", rows="true", side="1")}, l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM k),
    r AS (SELECT *, sum(CASE WHEN epoch_ms(ts) - epoch_ms(before) > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l),
    g AS (SELECT user_id, run, date_trunc('millisecond', min(ts)) AS opened, date_trunc('millisecond', max(ts)) AS closed, count(*) AS n FROM r GROUP BY user_id, run)
    SELECT user_id, opened, closed, n FROM g, w WHERE epoch_ms(closed) + 21600001 <= epoch_ms(last)"""
)
def state_sessions_with_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replayed(events(spark, sf_dir), arrival(True), state.session_for_state(spark))
    return stream.drained(state.lapsed(s, "user_id", "ts", 360, "3 days"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_type AS nonce, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events),
    c AS (SELECT user_id, nonce, ts, n, ts AS last, true AS kept FROM o WHERE n = 1
        UNION ALL SELECT o.user_id, o.nonce, o.ts, o.n, CASE WHEN epoch_ms(o.ts) - epoch_ms(c.last) > 86400000 THEN o.ts ELSE c.last END, epoch_ms(o.ts) - epoch_ms(c.last) > 86400000 FROM c JOIN o ON o.user_id = c.user_id AND o.nonce = c.nonce AND o.n = c.n + 1)
    SELECT user_id, nonce, ts FROM c WHERE kept"""
)
def state_nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("event_type", "nonce")
    s = replayed(e, arrival(False), state.session_for_state(spark))
    return stream.drained(state.remembered(s, "user_id", "nonce", "ts", 1440))


@query(
    f"""WITH {ARRIVED.format(delay="'2 days'", rows="event_type IN ('view', 'purchase')", side="event_type")}, q AS (SELECT * FROM k WHERE event_type = 'view'), r AS (SELECT * FROM k WHERE event_type = 'purchase'),
    j AS (SELECT q.event_id, q.user_id, q.ts AS asked, r.event_id AS reply, r.ts AS replied FROM q LEFT JOIN r ON q.user_id = r.user_id AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 240 MINUTE)
    SELECT event_id, user_id, asked, reply, replied FROM j, w WHERE reply IS NOT NULL OR asked + INTERVAL 240 MINUTE < last"""
)
def stream_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user with the purchases in the four hours after, as a join of two streams; views without any once that time has passed."""
    e, session = events(spark, sf_dir), state.session_for_state(spark)
    s = replayed(e, arrival(True), session)
    asked = s.filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("asked"))
    replied = s.filter("event_type = 'purchase'").select(F.col("event_id").alias("reply"), "user_id", F.col("ts").alias("replied"))
    return stream.drained(state.replies(asked, replied, "user_id", "asked", "replied", 240, "2 days")).select("event_id", "user_id", "asked", "reply", "replied")

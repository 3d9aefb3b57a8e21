"""Usage queries over the event log and the chat log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import usage
from tessel.plans.base import query, table


def events_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


WEEK = "date_trunc('week', ts)"


@query(
    f"""WITH w AS (SELECT event_type AS event, {WEEK} AS week, count(*) AS n FROM events GROUP BY ALL),
    p AS (SELECT event, week, n, lag(n) OVER (PARTITION BY event ORDER BY week) AS before FROM w)
    SELECT event, week::DATE AS week, n, before, CASE WHEN coalesce(before, 0) = 0 THEN NULL ELSE round_even((n - before) * 100.0::DOUBLE / before, 0)::BIGINT END AS delta FROM p"""
)
def usage_by_event_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events_(spark, sf_dir).groupBy(F.col("event_type").alias("event"), F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"))
    return usage.change(w, "event", "week").select("event", F.col("week").cast("date").alias("week"), "n", "before", "delta")


@query("SELECT event_type AS event, count(*) FILTER (date_trunc('month', ts) = DATE '2024-01-01') AS this_month, count(*) FILTER (date_trunc('month', ts) = DATE '2023-12-01') AS last_month FROM events GROUP BY 1")
def usage_this_and_last_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.this_and_last_month(events_(spark, sf_dir), "event_type", "ts", "2024-01-15").withColumnRenamed("event_type", "event")


@query("SELECT year(ts)::INTEGER AS y, month(ts)::INTEGER AS m, day(ts)::INTEGER AS d, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (year(ts), month(ts), day(ts))")
def usage_rollup_day_month_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir).select(F.year("ts").alias("y"), F.month("ts").alias("m"), F.day("ts").alias("d"), "value")
    return e.rollup("y", "m", "d").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_type, user_id % 10 AS team, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 10)")
def usage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir).select("event_type", (F.col("user_id") % 10).alias("team"))
    return e.cube("event_type", "team").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'view') AS asks, count(*) FILTER (event_type = 'purchase') AS solved, count(*) FILTER (event_type = 'purchase') * 15 AS minutes, round_even(count(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / count(*) FILTER (event_type = 'view'), 0)::BIGINT AS rate, count(DISTINCT user_id % 7) AS departments FROM events")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(events_(spark, sf_dir), "user_id", "event_type", asks=["view"], solved=["purchase"], department=F.col("user_id") % 7)


EXP = "CASE event_type WHEN 'view' THEN 5 WHEN 'signup' THEN 20 WHEN 'click' THEN 10 WHEN 'purchase' THEN 30 ELSE 5 END"


@query(f"WITH e AS (SELECT user_id, sum({EXP})::BIGINT AS exp FROM events GROUP BY user_id) SELECT user_id, exp, floor(sqrt(exp / 100.0::DOUBLE))::BIGINT + 1 AS level, round(least(greatest((exp - pow(floor(sqrt(exp / 100.0::DOUBLE)), 2) * 100) / (pow(floor(sqrt(exp / 100.0::DOUBLE)) + 1, 2) * 100 - pow(floor(sqrt(exp / 100.0::DOUBLE)), 2) * 100), 0), 1), 6) AS progress FROM e")
def exp_level_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.levels(events_(spark, sf_dir), "user_id", "event_type", {"view": 5, "signup": 20, "click": 10, "purchase": 30}, 5)


@query(
    """WITH e AS (SELECT user_id, ['name', 'ingest', 'source', 'pack_out', 'pack_in', 'solved', 'streak_day', 'correction', 'shared', 'gap_filled', 'thanks', 'thorough'][event_id % 12 + 1] AS kind FROM events),
    c AS (SELECT user_id, kind, count(*) AS n FROM e GROUP BY ALL),
    r(badge, kind, least) AS (VALUES ('welcome', 'name', 1), ('first_ingest', 'ingest', 1), ('shelf10', 'source', 10), ('shelf30', 'source', 30), ('first_pack_out', 'pack_out', 1), ('first_pack_in', 'pack_in', 1), ('solve10', 'solved', 10), ('solve50', 'solved', 50),
        ('streak7', 'streak_day', 7), ('fb10', 'correction', 10), ('fb50', 'correction', 50), ('qa_share10', 'shared', 10), ('gapfill', 'gap_filled', 1), ('thanks5', 'thanks', 5), ('streak30', 'streak_day', 30), ('thorough10', 'thorough', 10))
    SELECT user_id, badge FROM c JOIN r ON c.kind = r.kind AND n >= least"""
)
def badges_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = list(dict.fromkeys(k for _, k, _ in usage.BADGES))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return usage.badges(events_(spark, sf_dir).select("user_id", kind.alias("kind")), "user_id", "kind", usage.BADGES)


BUSINESS = """d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE isodow(ts) <= 5 AND ts::DATE NOT IN (DATE '2024-01-01', DATE '2024-01-08')),
    cal AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-03-31', INTERVAL 1 DAY))::DATE AS day) WHERE isodow(day) <= 5 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-08'))"""


@query(f"WITH {BUSINESS}, g AS (SELECT user_id, day, i - row_number() OVER (PARTITION BY user_id ORDER BY day) AS grp FROM d JOIN cal USING (day)), s AS (SELECT user_id, grp, count(*) AS n, max(day) AS last FROM g GROUP BY ALL) SELECT user_id, max(n) AS longest, max_by(n, last) AS current FROM s GROUP BY user_id")
def user_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.streaks(events_(spark, sf_dir), "user_id", "ts", ["2024-01-01", "2024-01-08"], "2023-12-01", "2024-03-31")


@query("WITH v AS (SELECT DISTINCT user_id AS reporter, 'src' || (event_id % 2000) AS source FROM events WHERE event_type = 'error'), c AS (SELECT source, count(*) AS votes, string_agg(reporter::VARCHAR, ',' ORDER BY reporter) AS reporters FROM v GROUP BY source) SELECT source, votes, reporters FROM c WHERE votes >= 2 OR source IN ('src1', 'src2')")
def noise_excluded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir).filter("event_type = 'error'")
    votes = e.select(F.col("user_id").alias("reporter"), F.concat(F.lit("src"), (F.col("event_id") % 2000).cast("string")).alias("source"))
    return usage.excluded_sources(votes, 2, ["src1", "src2"])


@query(
    """WITH q AS (SELECT conv_id, turn, lower(substring(regexp_replace(text, '[ 　\\t\\r\\n、。，．,.?？!！「」・]', '', 'g'), 1, 40)) AS key FROM conversations WHERE role = 'user'),
    c AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM q) SELECT conv_id, turn, key, n FROM c"""
)
def question_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.question_key("text").alias("key"))
    return q.join(q.groupBy("key").agg(F.count("*").alias("n")), "key").select("conv_id", "turn", "key", "n")


@query(
    """WITH q AS (SELECT lower(substring(regexp_replace(text, '[ 　\\t\\r\\n、。，．,.?？!！「」・]', '', 'g'), 1, 40)) AS key, conv_id, turn FROM conversations WHERE role = 'user')
    SELECT key, count(*) AS n, min(conv_id * 1000 + turn) AS first FROM q GROUP BY key ORDER BY n DESC, first LIMIT 50"""
)
def pending_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select(T.question_key("text").alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return q.groupBy("key").agg(F.count("*").alias("n"), F.min("o").alias("first")).orderBy(F.desc("n"), "first").limit(50)


@query("WITH l AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM l WHERE before IS NULL OR NOT before > ts - INTERVAL 24 HOUR")
def gap_dup_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.suppressed(events_(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 24).select("event_id", "user_id", "event_type")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def inbox_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("b")).select("user_id", "b.event_type", "b.ts")


RETAINED = """SELECT '{kind}' AS log, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER () AS total FROM events WHERE event_type = '{kind}') WHERE total <= {most} + {most} // 10 OR n <= {most}"""
LOGS = (("view", 2000), ("error", 150), ("signup", 1000000))


@query(" UNION ALL ".join(RETAINED.format(kind=k, most=n) for k, n in LOGS))
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = [usage.kept_log(events_(spark, sf_dir).filter(F.col("event_type") == k).select(F.lit(k).alias("log"), "event_id", "ts"), [F.desc("ts"), F.desc("event_id")], n) for k, n in LOGS]
    return logs[0].union(logs[1]).union(logs[2]).select("log", "event_id")


@query(
    """WITH w AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS now, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before FROM events WHERE event_type = 'purchase' GROUP BY user_id),
    p AS (SELECT *, CASE WHEN before > 0 THEN round_even((now - before) * 100.0::DOUBLE / before, 0)::BIGINT END AS pct FROM w)
    SELECT user_id, CASE WHEN before > 0 AND pct >= 0 THEN '▲' || pct || '%' WHEN before > 0 THEN '▼' || abs(pct) || '%' WHEN now > 0 THEN '新記録' ELSE '—' END AS label FROM p"""
)
def saved_time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    w = events_(spark, sf_dir).filter("event_type = 'purchase'").groupBy("user_id").agg(F.count_if(late).alias("now"), F.count_if(~late).alias("before"))
    return w.select("user_id", usage.delta_label(F.col("now"), F.col("before")).alias("label"))


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def turn_pairs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return c.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").drop("rn")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events_(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("WITH o AS (SELECT unnest([0, 1, 2]) AS o) SELECT time_bucket(INTERVAL 1 HOUR, ts) - o * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, o GROUP BY 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_(spark, sf_dir).groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events_(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


@query("WITH c AS (SELECT unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day), s AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id = 7 GROUP BY 1) SELECT c.day, CASE WHEN coalesce(n, 0) = 0 THEN '-' ELSE (n * 15)::VARCHAR END AS minutes FROM c LEFT JOIN s USING (day)")
def history_seven_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir).filter("event_type = 'purchase' and user_id = 7")
    return usage.history(e, "ts", "2024-01-30", 7, 15)


@query("SELECT user_id, count(*) * 15 AS minutes FROM events WHERE event_type = 'purchase' AND ts >= DATE '2024-01-22' - INTERVAL 7 DAY AND ts < DATE '2024-01-22' GROUP BY user_id")
def weekly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.week_before(events_(spark, sf_dir).filter("event_type = 'purchase'"), "user_id", "ts", "2024-01-25", 15)


@query(
    """WITH r AS (SELECT user_id, (ts - (event_id % 4) * INTERVAL 10 DAY - (event_id % 3) * INTERVAL 400 DAY)::DATE AS day FROM events WHERE event_type = 'purchase')
    SELECT 'D' || (user_id % 7) AS dept, 15 * count(*) FILTER (day = DATE '2024-01-20') AS day_min, 15 * count(*) FILTER (strftime(day, '%Y%m') = '202401') AS month_min, 15 * count(*) FILTER (strftime(day, '%Y') = '2024') AS year_min FROM r GROUP BY 1"""
)
def board_by_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir).filter("event_type = 'purchase'").select(F.concat(F.lit("D"), (F.col("user_id") % 7).cast("string")).alias("dept"), F.expr("ts - make_interval(0, 0, 0, cast(event_id % 4 * 10 + event_id % 3 * 400 as int))").alias("ts"), F.lit(15).cast("long").alias("minutes"))
    return usage.board(e, "dept", "ts", "minutes", "2024-01-20")


@query("SELECT user_id, round(avg(value), 10) AS mean, approx_quantile(value, 0.5) IS NOT NULL AS known, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def distinct_and_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg("value"), 10).alias("mean"), F.percentile_approx("value", 0.5).isNotNull().alias("known"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: (a + x) / 2), 4) AS blended FROM events GROUP BY user_id")
def blended_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = events_(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return usage.blended(timed, "user_id", "at", "value").select("user_id", F.round("blended", 4).alias("blended"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS event, CASE WHEN event_type = 'purchase' THEN 15 ELSE 0 END AS saved_min,
    CASE event_type WHEN 'view' THEN 5 WHEN 'signup' THEN 20 ELSE 0 END AS exp_activity, 'src' || (event_id % 20) AS source, CASE WHEN event_id % 20 < 10 THEN event_id % 20 END AS cluster_id FROM events"""
)
def analytics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir)
    clusters = spark.range(10).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), F.col("id").alias("cluster_id"))
    log = e.withColumn("detail", F.concat(F.lit("source=src"), (F.col("event_id") % 20).cast("string"), F.lit(" chunks=3")))
    return usage.export(log, clusters, {"purchase": 15}, {"view": 5, "signup": 20})


@query("SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'gap' ELSE 'qa' END AS kind, event_id % 3 = 0 AS consumed FROM events WHERE NOT (event_id % 3 = 0 AND event_type = 'error' AND ts < TIMESTAMP '2024-01-10') AND NOT (event_id % 3 = 0 AND event_id <= (SELECT max(event_id) FROM events WHERE event_id % 3 = 0) - 1500)")
def inbox_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_(spark, sf_dir).select("event_id", "event_type", "ts", F.when(F.col("event_type") == "error", "gap").otherwise("qa").alias("kind"), (F.col("event_id") % 3 == 0).alias("consumed"))
    return usage.trimmed(e, "event_id", "ts", "2024-01-10", 500).select("event_id", "event_type", "kind", "consumed")

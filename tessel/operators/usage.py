"""Usage analytics: counts, changes, levels, badges, streaks, votes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Badges, the counter that each goes by, and from how many on.
BADGES = [
    ("welcome", "name", 1), ("first_ingest", "ingest", 1), ("shelf10", "source", 10), ("shelf30", "source", 30), ("first_pack_out", "pack_out", 1), ("first_pack_in", "pack_in", 1),
    ("solve10", "solved", 10), ("solve50", "solved", 50), ("streak7", "streak_day", 7), ("fb10", "correction", 10), ("fb50", "correction", 50), ("qa_share10", "shared", 10),
    ("gapfill", "gap_filled", 1), ("thanks5", "thanks", 5), ("streak30", "streak_day", 30), ("thorough10", "thorough", 10),
]


def change(counts: DataFrame, group: str, period: str, n: str = "n") -> DataFrame:
    """counts with the period before and the change in percent, rounded half to even; null where there was nothing before (see delta_label)."""
    before = F.lag(n).over(Window.partitionBy(group).orderBy(period))
    delta = F.when(F.coalesce(F.col("before"), F.lit(0)) == 0, None).otherwise(F.bround((F.col(n) - F.col("before")) * 100.0 / F.col("before"), 0).cast("long"))
    return counts.withColumn("before", before).withColumn("delta", delta)


def delta_label(now: Column, before: Column) -> Column:
    """▲ or ▼ with the change in percent, 新記録 where there was nothing before, a dash where there is nothing at all."""
    percent = F.bround((now - before) * 100.0 / before, 0).cast("long")
    known = F.when(percent >= 0, F.concat(F.lit("▲"), percent.cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("▼"), F.abs(percent).cast("string"), F.lit("%")))
    return F.when(before > 0, known).when(now > 0, "新記録").otherwise("—")


def kept_log(log: DataFrame, order: list[Column], most: int) -> DataFrame:
    """A log's newest `most` rows, cut only once it holds a tenth more than that; 0 or less never cuts."""
    if most <= 0 or log.count() <= most + most // 10:
        return log
    return log.orderBy(*order).limit(most)


def this_and_last_month(events: DataFrame, event: str, ts: str, today: str) -> DataFrame:
    month, now = F.trunc(ts, "MM"), F.trunc(F.lit(today).cast("date"), "MM")
    return events.groupBy(event).agg(F.count_if(month == now).alias("this_month"), F.count_if(month == F.add_months(now, -1)).alias("last_month"))


def summary(events: DataFrame, user: str, event: str, asks: list[str], solved: list[str], department: Column, minutes: int = 15) -> DataFrame:
    a, s = F.count_if(F.col(event).isin(asks)), F.count_if(F.col(event).isin(solved))
    return events.agg(
        F.countDistinct(user).alias("users"),
        a.alias("asks"),
        s.alias("solved"),
        (s * minutes).alias("minutes"),
        F.when(a > 0, F.bround(s * 100.0 / a, 0).cast("long")).otherwise(F.lit(0).cast("long")).alias("rate"),
        F.countDistinct(department).alias("departments"),
    )


def levels(events: DataFrame, user: str, event: str, exp: dict[str, int], other: int, divisor: int = 100) -> DataFrame:
    """exp, level = floor(sqrt(exp / divisor)) + 1 and the progress within the level, 0 to 1."""
    points = F.lit(other)
    for name, value in exp.items():
        points = F.when(F.col(event) == name, value).otherwise(points)
    e = events.groupBy(user).agg(F.sum(points).cast("long").alias("exp"))
    done = F.floor(F.sqrt(F.col("exp") / F.lit(float(divisor))))
    low, high = F.pow(done, 2) * divisor, F.pow(done + 1, 2) * divisor
    return e.select(user, "exp", (done + 1).alias("level"), F.round(F.least(F.greatest((F.col("exp") - low) / (high - low), F.lit(0.0)), F.lit(1.0)), 6).alias("progress"))


def badges(events: DataFrame, user: str, event: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """A row per user and badge whose threshold the user's count of the event reaches."""
    names = sorted({e for _, e, _ in rules})
    c = events.groupBy(user).agg(*[F.count_if(F.col(event) == n).alias(f"_{n}") for n in names])
    earned = F.array(*[F.when(F.col(f"_{e}") >= at, F.lit(b)) for b, e, at in rules])
    return c.select(user, F.explode(F.filter(earned, lambda x: x.isNotNull())).alias("badge"))


def business_days(spark, first: str, last: str, holidays: list[str]) -> DataFrame:  # noqa: ANN001
    """day and index of every business day between two dates."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    days = days.filter(~F.dayofweek("day").isin(1, 7) & ~F.col("day").cast("string").isin(holidays))
    return days.withColumn("i", F.row_number().over(Window.orderBy("day")))  # a calendar, not data


def streaks(events: DataFrame, user: str, ts: str, holidays: list[str], first: str, last: str) -> DataFrame:
    """Longest and latest run of consecutive business days of each user; other days neither count nor break."""
    cal = business_days(events.sparkSession, first, last, holidays)
    days = events.select(user, F.to_date(ts).alias("day")).distinct().join(F.broadcast(cal), "day")
    runs = days.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy(user).orderBy("day"))).groupBy(user, "g").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy(user).agg(F.max("n").alias("longest"), F.max_by("n", "last").alias("current"))


def excluded_sources(votes: DataFrame, threshold: int, confirmed: list[str]) -> DataFrame:
    """Sources with enough reporters, and confirmed ones: one vote for each (reporter, source)."""
    v = votes.select("reporter", "source").distinct().groupBy("source").agg(F.count("*").alias("votes"), F.array_join(F.array_sort(F.collect_set("reporter")).cast("array<string>"), ",").alias("reporters"))
    return v.filter((F.col("votes") >= threshold) | F.col("source").isin(confirmed)).select("source", "votes", "reporters")


def suppressed(events: DataFrame, keys: list[str], ts: str, order: str, hours: int) -> DataFrame:
    """Events without one of the same keys strictly within the hours before."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, order))
    return events.withColumn("_b", before).filter(F.col("_b").isNull() | ~(F.col("_b") > F.col(ts) - F.expr(f"INTERVAL {hours} HOURS"))).drop("_b")


def history(events: DataFrame, ts: str, today: str, days: int, minutes: int) -> DataFrame:
    """Minutes of the last days, today first; a dash where there were none."""
    cal = events.sparkSession.range(days).select(F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")).alias("day"))
    n = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return cal.join(n, "day", "left").select("day", F.when(F.coalesce("n", F.lit(0)) == 0, "-").otherwise((F.col("n") * minutes).cast("string")).alias("minutes"))


def week_before(events: DataFrame, user: str, ts: str, today: str, minutes: int) -> DataFrame:
    """Minutes in the seven days before this week's Monday; users without any are left out."""
    monday = F.date_trunc("week", F.lit(today).cast("date"))
    return events.filter((F.col(ts) >= monday - F.expr("INTERVAL 7 DAYS")) & (F.col(ts) < monday)).groupBy(user).agg((F.count("*") * minutes).alias("minutes"))


def board(rows: DataFrame, dept: str, ts: str, minutes: str, today: str) -> DataFrame:
    """Minutes of today, this month and this year, by department; each sums only rows of the current day, month or year."""
    d, now = F.to_date(ts), F.lit(today).cast("date")
    part = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col(minutes))), F.lit(0).cast("long")).alias(name)
    return rows.groupBy(dept).agg(part(d == now, "day_min"), part(F.trunc(d, "MM") == F.trunc(now, "MM"), "month_min"), part(F.trunc(d, "YYYY") == F.trunc(now, "YYYY"), "year_min"))


def blended(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Smoothed value of each key: the first as it is, then the mean of the old and the new.

    The newest value weighs a half, the one before a quarter and so on, the first as much as the second; so this is a sum, and no key's values are gathered.
    """
    w = Window.partitionBy(key)
    placed = rows.select(key, F.col(value).alias("_x"), F.row_number().over(w.orderBy(F.desc(order), F.desc(value))).alias("_r"), F.count("*").over(w).alias("_n"))
    return placed.groupBy(key).agg(F.sum(F.col("_x") * F.pow(F.lit(0.5), F.least(F.col("_r"), F.col("_n") - 1))).alias("blended"))


def source_of(detail: Column) -> Column:
    """The source named in a log line: source=… up to ' chunks=' or a space, or src=… up to the end."""
    return F.coalesce(*[F.nullif(F.regexp_extract(detail, p, 1), F.lit("")) for p in ("source=(.*?) chunks=", "source=([^ ]+)", "src=(.*)$")])


def export(log: DataFrame, clusters: DataFrame, minutes: dict[str, int], exp: dict[str, int]) -> DataFrame:
    """Rows of the analytics file: day, event, minutes, points, source and its cluster."""
    pick = lambda values: F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in values.items()], F.lit(0))
    rows = log.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("event"), pick(minutes).alias("saved_min"), pick(exp).alias("exp_activity"), source_of(F.col("detail")).alias("source"))
    return rows.join(clusters, "source", "left").select("event_id", "day", "event", "saved_min", "exp_activity", "source", "cluster_id")


def trimmed(inbox: DataFrame, order: str, ts: str, cutoff: str, most: int) -> DataFrame:
    """Without consumed gaps older than the cutoff, and without all but the newest `most` consumed rows."""
    aged = F.col("consumed") & (F.col("kind") == "gap") & (F.col(ts) < F.lit(cutoff).cast("timestamp"))
    newest = inbox.filter("consumed").orderBy(F.desc(order)).limit(most).agg(F.min(order).alias("_from"))
    return inbox.join(F.broadcast(newest)).filter(~aged & (~F.col("consumed") | (F.col(order) >= F.col("_from")))).drop("_from")

"""Order of hits: diversity, demotion, explicit lists, confidence; neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.scratch import written

PART = 65_536
#: Hits of one question that are ordered together, in one task: more than any prompt or page takes.
HITS = 10_000


def diversity_order(hits: DataFrame, source: str = "source", score: str = "score", order: str = "ord") -> DataFrame:
    """hits with `place`: the best of each source first, by score, then the rest in their order; of more than HITS the best by score."""
    hits = hits.orderBy(F.desc(score), order).limit(HITS)
    w = Window.partitionBy(F.lower(source)).orderBy(F.desc(score), order)
    first = hits.withColumn("_rn", F.row_number().over(w)).withColumn("_later", (F.col("_rn") > 1).cast("int"))
    place = F.row_number().over(Window.orderBy("_later", F.when(F.col("_rn") == 1, -F.col(score)), order))
    return first.withColumn("place", place).drop("_rn", "_later")


def diversity_swap(hits: DataFrame, pool: DataFrame, ratio: int = 70) -> DataFrame:
    """hits (id, source, score, rank): where all are of one source, the last gives way to the best pool row of another, if that scores at least ratio percent of the lowest."""
    state = hits.agg(F.countDistinct(F.lower("source")).alias("n"), F.count("*").alias("hits"), F.min(F.lower("source")).alias("one"), F.min("score").alias("low"), F.max("rank").alias("last"))
    best = pool.join(F.broadcast(state)).filter((F.lower("source") != F.col("one")) & (F.col("n") == 1) & (F.col("hits") >= 2) & (F.col("low") > 0) & (F.col("score") / F.col("low") * 100 >= ratio))
    best = best.orderBy(F.desc("score"), "id").limit(1).select("id", "source", "score", F.col("last").alias("rank"))
    kept = hits.join(F.broadcast(best.select(F.col("rank"))), "rank", "left_anti").select("id", "source", "score", "rank")
    return kept.unionByName(best)


def demoted(hits: DataFrame, used: Column, keep: int, rank: str = "rank") -> DataFrame:
    """Unused hits first, then used ones, each in their order; the first `keep`."""
    return hits.withColumn("_used", used.cast("int")).orderBy("_used", rank).limit(keep).drop("_used")


def wrong_last(hits: DataFrame, wrong: Column, rank: str = "rank") -> DataFrame:
    """hits with `place`: wrong ones after the others, the first of them last; of more than HITS the first by rank."""
    hits = hits.orderBy(rank).limit(HITS)
    w = Window.orderBy(wrong.cast("int"), F.when(wrong, -F.col(rank)).otherwise(F.col(rank)))
    return hits.withColumn("place", F.row_number().over(w))


def explicit_order(response: Column, most: Column) -> Column:
    """The valid distinct numbers of a comma list, in order, each between 1 and `most`."""
    numbers = F.transform(F.split(response, "[,、 ]+"), lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= most)))


def top_per(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def within_budget(rows: DataFrame, group: list[str], order: list, length: Column, cap: int) -> DataFrame:
    """rows with `taken`: how many characters of each fit into the group's budget, in order; rows that get none are dropped."""
    before = F.coalesce(F.sum(length).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("taken", F.greatest(F.least(length, F.lit(cap) - before), F.lit(0)).cast("long")).filter(F.col("taken") > 0)


def dispersion(scores: DataFrame, group: list[str], source: str = "source", score: str = "score") -> DataFrame:
    """Relative gap, in percent rounded half to even, of the two best sources of each group; -1 with fewer."""
    per = scores.groupBy(*group, F.lower(source).alias("_s")).agg(F.max(score).alias("_m"))
    two = per.groupBy(*group).agg(F.slice(F.sort_array(F.collect_list("_m"), False), 1, 2).alias("_b"), F.count("*").alias("sources"))
    gap = F.bround((F.col("_b")[0] - F.try_element_at("_b", F.lit(2))) / F.col("_b")[0] * 100, 0).cast("long")
    return two.select(*group, "sources", F.when((F.col("sources") >= 2) & (F.col("_b")[0] > 0), gap).otherwise(F.lit(-1).cast("long")).alias("gap"))


def flatness(score: Column) -> Column:
    """Best score over mean score; 1 where the sum is not positive."""
    return F.when(F.sum(score) > 0, F.max(score) / F.avg(score)).otherwise(F.lit(1.0))


def confidence(coverage: Column, flat: Column, green: float = 1.0, steep: float = 1.6, amber: float = 0.9) -> Column:
    return F.when((coverage >= green) & (flat >= steep), 2).when(coverage >= amber, 1).otherwise(0)


def neighbours(rows: DataFrame, hit: Column, source: str, order: list, radius: int) -> DataFrame:
    """Rows within `radius` places of a hit in the same source, hits left out."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(-radius, radius)
    return rows.withColumn("_hit", hit.cast("int")).withColumn("_near", F.max("_hit").over(w)).filter((F.col("_near") == 1) & (F.col("_hit") == 0)).drop("_hit", "_near")


def in_parts(rows: DataFrame, order: list, radius: int, size: int = PART) -> DataFrame:
    """rows with `_pos` (dense place in the order of all), `_part` and `_own`: parts of `size` rows of that order, with copies of the `radius` rows beyond either border.

    The order is one of ranges, so a group of any size lies in as many parts as it fills, and a window of `radius` rows within a part sees what a
    window over everything would. The driver holds a number per task. Ties in the order fall as they come.
    """
    size = max(size, radius, 1)
    marked = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    task = F.shiftright("_at", 33).alias("_task")
    before, offsets = 0, []
    for r in marked.groupBy(task).agg(F.count("*").alias("n")).orderBy("_task").collect():
        offsets += [F.lit(r["_task"]), F.lit(before)]
        before += r.n
    first = F.try_element_at(F.create_map(*offsets), F.shiftright("_at", 33)) if offsets else F.lit(0)
    placed = marked.withColumn("_pos", first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    home, at = F.floor(F.col("_pos") / size), F.col("_pos") % size
    to = F.array_compact(F.array(home, F.when((at < radius) & (home > 0), home - 1), F.when(at >= size - radius, home + 1)))
    return placed.withColumn("_part", F.explode(to)).withColumn("_own", F.col("_part") == home)


def neighbours_in_parts(rows: DataFrame, hit: Column, source: str, order: list, radius: int, size: int = PART) -> DataFrame:
    """What neighbours() gives, however large a source is: windows run within parts of the order of (source, order)."""
    parts = in_parts(rows.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int")), [source, *order], radius, size)
    w = Window.partitionBy("_part", source).orderBy("_pos").rowsBetween(-radius, radius)
    near = parts.withColumn("_near", F.max("_hit").over(w))
    return near.filter(F.col("_own") & (F.col("_near") == 1) & (F.col("_hit") == 0)).select(*rows.columns)

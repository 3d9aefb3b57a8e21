"""Values over time: what was valid at a moment, and sketches that merge from days to longer spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.rank import PART, in_parts


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, columns: list[str], strict: bool = False, size: int = PART) -> DataFrame:
    """left with the columns of the last right row of its key at or before (strict: before) its time; null where there is none.

    Both sides are put in one order of (key, time) and cut into parts of `size` rows; a part carries the last right row forward, and gets the
    one that was valid at its start from the parts before, of which only the last right row of a key that goes on is kept. So a
    key that holds most rows is as many tasks as it fills.

    Defined cases: rows with a null key or time get nulls; right rows of equal key and time count by their columns, the greatest last; repeated left rows stay;
    right columns must not be among left's.
    """
    values = F.struct(*columns)
    kind = right.select(values.alias("v")).schema["v"].dataType
    mine = F.struct(*left.columns)
    ok = F.col(key).isNotNull() & F.col(at).isNotNull()
    order = F.lit(0 if strict else 1)
    l = left.filter(ok).select(F.col(key).alias("_k"), F.col(at).alias("_t"), order.alias("_side"), F.lit(None).cast(kind).alias("_v"), mine.alias("_l"))
    r = right.filter(ok).select(F.col(key).cast(l.schema["_k"].dataType).alias("_k"), F.col(at).cast(l.schema["_t"].dataType).alias("_t"), (1 - order).alias("_side"), values.alias("_v"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"))
    parts = in_parts(l.unionByName(r), ["_k", "_t", "_side", "_v"], 0, size)
    within = Window.partitionBy("_part", "_k").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    here = parts.withColumn("_v", F.last("_v", ignorenulls=True).over(within))
    ends = parts.groupBy("_k", "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_pos"))).alias("_end"))
    several = ends.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1").select("_k")
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(several, "_k", "left_semi").withColumn("_start", F.last("_end", ignorenulls=True).over(before)).select("_k", "_part", "_start")
    joined = here.filter(F.col("_l").isNotNull()).join(carried, ["_k", "_part"], "left").withColumn("_v", F.coalesce("_v", "_start"))
    out = joined.select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in columns])
    rest = left.filter(~F.coalesce(ok, F.lit(False))).select("*", *[F.lit(None).cast(kind[c].dataType).alias(c) for c in columns])
    return out.unionByName(rest)


def sketched(rows: DataFrame, keys: list[Column | str], distinct: Column, value: Column, accuracy: int = 14, k: int = 200) -> DataFrame:
    """keys with a sketch of distinct values (`who`) and of quantiles (`spread`), and the number of rows: small, whatever the rows, and mergeable."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(distinct, F.lit(accuracy)).alias("who"), F.kll_sketch_agg_double(value.cast("double"), F.lit(k)).alias("spread"), F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[Column | str], k: int = 200) -> DataFrame:
    """Sketches of shorter spans as those of longer ones: rows are never read again."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("spread", F.lit(k)).alias("spread"), F.sum("n").alias("n"))


def estimated(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """keys, rows, estimated distinct values, and estimated quantiles q50, q90, .."""
    cuts = [F.kll_sketch_get_quantile_double("spread", F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("who").alias("distinct"), *cuts)

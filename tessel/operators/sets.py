"""Set operations: differences, unions with order, reconciliation, prefix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def deduplicated(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the rows of changes in place of those with the same keys."""
    return new_rows(rows, changes, keys).unionByName(changes)


def reconciled(held: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Counts of either side by key, and whether they agree."""
    a, b = held.groupBy(key).agg(F.count("*").alias("a")), ledger.groupBy(key).agg(F.count("*").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return a.join(b, key, "full_outer").select(key, zero("a").alias("held"), zero("b").alias("ledger"), (zero("a") == zero("b")).alias("agrees"))


def counts_by_prefix(rows: DataFrame, column: str, prefix: str, order: str) -> DataFrame:
    """column, n, first: counts of what follows a prefix, both compared in any case, as it is first spelt, with its place in that order; nothing after the prefix counts for nothing."""
    trimmed = F.trim(column)
    named = rows.filter(F.lower(trimmed).startswith(prefix.lower()) & (F.length(trimmed) > len(prefix))).select(F.substring(trimmed, len(prefix) + 1, 1 << 30).alias("_name"), F.col(order).alias("_o"))
    return named.groupBy(F.lower("_name").alias("_key")).agg(F.min_by("_name", "_o").alias(column), F.count("*").alias("n"), F.min("_o").alias("first")).drop("_key")


def most_recent(rows: DataFrame, key: str, value: str, at: str, n: int) -> DataFrame:
    """key and its n most recent distinct values, newest first, equal ones by value; a key's other values are dropped before they meet."""
    last = rows.groupBy(key, value).agg(F.max(at).alias("_at"))
    first = last.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at"), value))).filter(F.col("_rn") <= n)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias("v")))), lambda x: x["v"]).alias("recent"))


def merged_recent(old: Column, new: Column, n: int) -> Column:
    """New entries first, then old ones, each once, the first n."""
    return F.slice(F.array_distinct(F.concat(new, old)), 1, n)


def listed_with(names: Column, name: Column) -> Column:
    """A list of names with one more, once."""
    return F.array_union(names, F.array(name))


def listed_without(names: Column, name: Column) -> Column:
    return F.array_except(names, F.array(name))


def mentions(text: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.contains(F.lower(text), F.lit(name.lower()))
    return out


def synonyms(queries: DataFrame, pairs: DataFrame, query: str = "query", most: int = 3) -> DataFrame:
    """queries with up to `most` counterparts of the terms they hold, in either direction, appended; pairs (term, canonical) are a short list."""
    both = pairs.select(F.col("term").alias("_a"), F.col("canonical").alias("_b"), "ord").union(pairs.select("canonical", "term", "ord"))
    met = queries.join(F.broadcast(both), F.contains(F.col(query), F.col("_a")) & ~F.contains(F.col(query), F.col("_b")), "left")
    extra = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("ord", "_b")))), lambda x: x["_b"])), 1, most)
    return met.groupBy(query).agg(extra.alias("_x")).select(query, F.concat_ws(" ", F.array(query), "_x").alias("expanded"))


def merged_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old pairs whose term is not among the new ones, then the new; one for each lower-cased term."""
    key = F.lower("term")
    kept = old.withColumn("_k", key).join(new.select(key.alias("_k")).distinct(), "_k", "left_anti")
    return deduplicated(kept.unionByName(new.withColumn("_k", key)), ["_k"], ["ord"]).drop("_k")

"""Expansion of hits: neighbours, references, articles, linked chapters, budgets, memos; chapter groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessel.functions import decide as D
from tessel.functions import text as T
from tessel.operators.rank import HITS, PART, neighbours_in_parts

NEIGHBOURS, REFS, REF_CANDIDATES, LINKED, SEEDS = 80, 8, 120, 2, 2


def neighbours(chunks: DataFrame, hits: DataFrame, radius: int, most: int = NEIGHBOURS, size: int = PART) -> DataFrame:
    """Chunks (chunk_id, source, page, seq) within `radius` places of a hit in its source, in that order, hits left out.

    Only sources with hits are read; places are taken in parts of the sorted chunks, so a source of any size is many tasks and no pair of chunks is formed.
    """
    near = chunks.join(hits.select("source").distinct(), "source", "left_semi").join(hits.select("chunk_id", F.lit(True).alias("_is_hit")), "chunk_id", "left")
    found = neighbours_in_parts(near, F.col("_is_hit"), "source", ["page", "seq"], radius, size)
    return found.orderBy("source", "page", "seq").limit(most).drop("_is_hit")


def by_references(meta: DataFrame, hits: DataFrame, most: int = REFS, candidates: int = REF_CANDIDATES) -> DataFrame:
    """Chunks whose section path holds a label that a hit refers to outside its own path, in the hits' sources; meta has chunk_id, source, section_path, refs (array), ord. Labels are 24 a hit at most, so what is broadcast is as small as the hits."""
    own = meta.join(hits.select("chunk_id"), "chunk_id", "left_semi")
    labels = own.select(F.explode(F.filter("refs", lambda r: ~F.contains(F.col("section_path"), r))).alias("label")).distinct()
    rows = meta.join(hits.select("source").distinct(), "source", "left_semi").join(hits.select("chunk_id"), "chunk_id", "left_anti")
    met = rows.join(F.broadcast(labels), F.contains(F.col("section_path"), F.col("label")), "left_semi")
    return met.orderBy("ord").limit(candidates).orderBy("ord").limit(most)


def article_ensured(meta: DataFrame, hits: DataFrame, question: str, most: int = 2) -> DataFrame:
    """hits (chunk_id, rank) with up to `most` chunks of the articles that the question names before them, unless one of these is a hit already."""
    spark = meta.sparkSession
    labels = spark.range(1).select(F.explode(T.ref_labels(F.lit(question))).alias("label"))
    labelled = meta.join(F.broadcast(labels), F.contains(F.col("section_path"), F.col("label")), "left_semi").select("chunk_id", "ord")
    known = labelled.join(hits.select("chunk_id"), "chunk_id", "left_semi").limit(1).agg(F.count("*").alias("_known"))
    first = labelled.orderBy("ord").limit(most).join(F.broadcast(known)).filter("_known = 0")
    added = first.select("chunk_id", (F.row_number().over(Window.orderBy("ord")) - most).alias("rank"))
    return added.unionByName(hits.select("chunk_id", "rank"))


def linked(pool: DataFrame, hits: DataFrame, links: DataFrame, most: int = LINKED, seeds: int = SEEDS, least: int = 80) -> DataFrame:
    """Pool chunks (chunk_id, source, chap, ord) of chapters linked to the first hits' (with rank), in other sources, with score 0."""
    first = hits.orderBy("rank").limit(seeds)
    targets = links.filter(F.col("sim") * 100 + 1e-7 >= least).join(first.select(F.col("source").alias("src_a"), F.col("chap").alias("chap_a")).distinct(), ["src_a", "chap_a"])
    targets = targets.join(first.select(F.lower("source").alias("_s")).distinct(), F.lower("src_b") == F.col("_s"), "left_anti")
    chosen = targets.groupBy(F.col("src_b").alias("source"), F.col("chap_b").alias("chap")).agg(F.max("sim").alias("sim")).orderBy(F.desc("sim"), "source", "chap").limit(most)
    found = pool.join(F.broadcast(chosen), ["source", "chap"]).join(hits.select("chunk_id"), "chunk_id", "left_anti")
    return found.orderBy(F.desc("sim"), "ord").limit(most).select("chunk_id", "source", "chap", F.lit(0.0).alias("score"))


def chapter_hits(chunks: DataFrame, picks: DataFrame, total: int, least: int) -> DataFrame:
    """Chunks of the picked chapters (source, chap, ord of the pick) with how many characters of each fit the chapter's share of the total."""
    n = picks.agg(F.count("*").alias("_n"))
    rows = chunks.join(F.broadcast(picks.select("source", "chap", F.col("ord").alias("pick"))), ["source", "chap"]).join(F.broadcast(n))
    cap = D.per_chapter_cap(F.lit(total), F.col("_n"), F.lit(least))
    before = F.coalesce(F.sum("len").over(Window.partitionBy("source", "chap").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("taken", F.greatest(F.least(F.col("len"), cap - before), F.lit(0)).cast("long")).filter("taken > 0").drop("_n")


def memo_injected(hits: DataFrame, memos: DataFrame, question: str, k: int) -> DataFrame:
    """hits (id, source, score, rank) after a matching memo (id, source, question, wrong, ord), if any: it leads, an equal question also sends the sources it calls wrong to the tail; k rows."""
    level = D.memo_level(F.lit(question), F.col("question"))
    best = memos.select("id", "source", "wrong", level.alias("level"), "ord").filter("level > 0").orderBy(F.desc("level"), F.desc("ord")).limit(1)
    row = best.select("id", "source", F.when(F.col("level") == 2, 1.0).otherwise(0.9).alias("score"), F.lit(0).alias("rank"), "wrong", "level")
    rest = hits.orderBy("rank").limit(HITS).join(F.broadcast(row.select(F.lower("source").alias("_s"), F.col("wrong").alias("_w"), F.col("level").alias("_l"))), how="left")
    rest = rest.filter(F.col("_s").isNull() | (F.lower("source") != F.col("_s")))
    bad = F.coalesce((F.col("_l") == 2) & D.wrong_source(F.col("_w"), F.col("source"), F.col("page")) & (F.col("rank") >= 1), F.lit(False))
    kept = rest.select("id", "source", "score", "rank", bad.alias("_bad")).unionByName(row.select("id", "source", "score", "rank", F.lit(False).alias("_bad")))
    order = F.row_number().over(Window.orderBy(F.col("_bad").cast("int"), F.when(F.col("_bad"), -F.col("rank")).otherwise(F.col("rank"))))
    return kept.withColumn("place", order).filter(F.col("place") <= k).drop("_bad", "rank")


def hit_sources(hits: DataFrame, most: int = 4) -> DataFrame:
    """Distinct sources of hits in the order they come, memos left out."""
    return hits.filter(~D.memo_source(F.col("source"))).groupBy("source").agg(F.min("rank").alias("rank")).orderBy("rank").limit(most)


def chapter_groups(chunks: DataFrame, least: int = 3, most: int = 60) -> DataFrame:
    """source, group, keys, chunks: chapters in first-seen order, neighbours merged until a group has `least` chunks; coarser where more than `most` groups are left.

    The merge goes from chapter to chapter, so it is a scan of a source's chapters, not of chunks: a few numbers are carried from row to row, for both ways of merging, and no list is built before the groups are known.
    """
    chap, own = T.chapter_key("section_path"), Window.partitionBy("source")
    counted = chunks.groupBy("source", F.lower(chap).alias("_k")).agg(F.min(F.struct("ord", chap.alias("c"))).alias("_f"), F.count("*").alias("n"))
    rows = counted.select("source", F.col("_f.ord").alias("ord"), F.col("_f.c").alias("key"), "n").repartition("source").withColumn("_total", F.sum("n").over(own))
    rows = rows.withColumn("_coarse", F.greatest(F.ceil(F.col("_total") / most), F.lit(least + 1))).drop("_total").sortWithinPartitions("source", "ord", "key", "n")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, began = None, False
        for b in batches:
            fine, coarse = [], []
            for source, n, enough in zip(b["source"].to_pylist(), b["n"].to_pylist(), b["_coarse"].to_pylist(), strict=True):
                if not began or source != at:
                    at, began, f, c, held_f, held_c = source, True, -1, -1, least, enough
                if held_f >= least:
                    f, held_f = f + 1, 0
                if held_c >= enough:
                    c, held_c = c + 1, 0
                held_f, held_c = held_f + n, held_c + n
                fine.append(f)
                coarse.append(c)
            yield pa.RecordBatch.from_arrays([*(b[x] for x in ("source", "ord", "key", "n")), pa.array(fine, pa.int32()), pa.array(coarse, pa.int32())], ["source", "ord", "key", "n", "_fine", "_group"])

    kept = rows.select("source", "ord", "key", "n")
    out = StructType([*kept.schema.fields, StructField("_fine", IntegerType()), StructField("_group", IntegerType())])
    both = rows.mapInArrow(merged, out).withColumn("_last", F.max("_fine").over(own))
    group = F.when(F.col("_last") < most, F.col("_fine")).otherwise(F.col("_group"))
    lists = both.groupBy("source", group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("ord", "key", F.col("n").alias("m")))).alias("_l"), F.sum("n").alias("chunks"))
    return lists.select("source", "group", F.array_join(F.transform("_l", lambda x: x["key"]), "｜").alias("keys"), "chunks")

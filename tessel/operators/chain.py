"""The ingest run: from pages to every table of the shelf that a new source changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import answer, links, queue, shelf


@dataclass
class Ingested:
    """What one run adds or changes: chunks to append, their meta and vectors, the manifest as it is then, outline rows and links between chapters."""

    chunks: DataFrame
    meta: DataFrame
    vectors: DataFrame
    manifest: DataFrame
    outline: DataFrame
    links: DataFrame


def ingest(pages: DataFrame, held: DataFrame, manifest: DataFrame, origin: str, embed: Callable[[list[str]], list[list[float] | None]], summary: Callable[[Column], Column], chapter_chars: int = 4000, nearest: int = 3, least: int = 80) -> Ingested:
    """Cuts pages (source, text) into chunks of new content, gives each its path and references, embeds them, counts them in the manifest (file_path is the source), summarises
    chapters and links those that are alike. Steps are tables over the one before, so a caller that writes them can go on after any; an embedding that fails
    leaves its rows pending and its source partial."""
    chunks = shelf.ingested(pages, held, origin)
    meta = chunks.select("chunk_id", "source", "section_path", "refs")
    waiting = chunks.select("chunk_id", "source", "section_path", F.col("full_text"), F.lit(False).alias("embedded"), F.lit(None).cast("array<double>").alias("vector"))
    vectors = queue.embedded(waiting, "full_text", embed)
    n = pages.select("source").distinct().join(vectors.groupBy("source").agg(F.count("*").alias("n"), F.min("embedded").alias("whole")), "source", "left")
    status = F.when(F.coalesce("whole", F.lit(True)), "done").otherwise("partial")
    changes = n.select(F.col("source").alias("file_path"), status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"))
    chap = F.coalesce(F.nullif(T.chapter_key("section_path"), F.lit("")), F.lit("-"))
    placed = chunks.withColumn("chap", chap).withColumn("ord", F.struct("page", "seq"))
    groups = placed.groupBy("source", "chap").agg(F.min("ord").alias("first"))
    outline = answer.outline(groups, placed.select("source", "chap", "ord", "full_text"), summary, chapter_chars)
    centres = links.centroids(vectors.filter("embedded").withColumn("key", F.concat_ws(">", "source", chap)), ["key"], "vector")
    near = links.nearest_centroids(centres, "key", "centroid", nearest, least=least)
    return Ingested(chunks, meta, vectors.select("chunk_id", "vector", "embedded"), shelf.manifest_upserted(manifest, changes), outline, near)

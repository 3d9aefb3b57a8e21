"""The shelf as tables: search over knowledge and vectors, multi-stage retrieval, ingest, manifest, channels, inboxes, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import decide as D
from tessel.functions import text as T
from tessel.functions import vector as V
from tessel.operators import ingest, rank, retrieve, sets


def search(vectors: DataFrame, knowledge: DataFrame, query: list[float], question: str, k: int, excluded: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """chunk_id, source, page, preview, score: the hybrid search. The first row of a repeated id counts; vectors of another dimension, without a chunk or out of scope are passed over."""
    rows = sets.deduplicated(knowledge, ["chunk_id"], ["ord"])
    rows = retrieve.restricted(rows, "source", excluded, scope)
    keys = T.distinct_keys(F.lit(question))
    doc = F.coalesce("norm_text", T.match_text("summary", "keywords", "source", "full_text"))
    met = vectors.filter(F.size("vector") == len(query)).join(rows, "chunk_id")
    score = F.round(V.dot("vector", V.literal(query)) + T.SPARSE_WEIGHT * T.key_score(keys, doc), 6)
    hits = retrieve.top(met.select("chunk_id", "source", "page", "full_text", "ord", score.alias("score")), k)
    return hits.select("chunk_id", "source", "page", F.substring("full_text", 1, 120).alias("preview"), "score")


def multi_search(vectors: DataFrame, knowledge: DataFrame, queries: list[tuple[str, list[float] | None]], pool: int, **limits: DataFrame) -> DataFrame:
    """The pool of chunks by their best score over several (question, vector) pairs; pairs without a vector are skipped, and all of it is one pass."""
    known = [(q, v) for q, v in queries if q and v]
    rows = retrieve.restricted(sets.deduplicated(knowledge, ["chunk_id"], ["ord"]), "source", limits.get("excluded"), limits.get("scope"))
    doc = F.coalesce("norm_text", T.match_text("summary", "keywords", "source", "full_text"))
    met = vectors.join(rows, "chunk_id").withColumn("_doc", doc)
    parts = [F.when(F.size("vector") == len(v), F.round(V.dot("vector", V.literal(v)) + T.SPARSE_WEIGHT * T.key_score(T.distinct_keys(F.lit(q)), F.col("_doc")), 6)) for q, v in known]
    if not parts:
        return met.select("chunk_id", "source", "page", F.lit(0.0).alias("score")).limit(0)
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return retrieve.top(met.select("chunk_id", "source", "page", "ord", best.alias("score")).filter("score is not null"), pool).drop("ord")


def retrieved(vectors: DataFrame, knowledge: DataFrame, question: str, queries: list[tuple[str, list[float] | None]], k: int, pool: int = 40, order: str | None = None, steps: list[Callable[[DataFrame], DataFrame]] | None = None, synonyms: DataFrame | None = None, diversify: int | None = None, **limits: DataFrame) -> DataFrame:
    """Multi-stage retrieval: pool, an explicit order from a model's answer if there is one, the k first, then the given steps over (chunk_id, source, page, score, rank).

    With synonyms (term, canonical, ord) a query gets up to three counterparts of the terms it holds. Where no query has a vector of the shelf's length, or the pool stays empty, it is the
    question's keywords alone that score. With `diversify`, hits that are all of one source give their last place to the best of the pool from another, if that scores at least so many percent of it.
    """
    spark = vectors.sparkSession
    if synonyms is not None and queries:
        asked = sets.synonyms(spark.createDataFrame([(q,) for q in {q for q, _ in queries} | {question}], "query string"), synonyms)
        wider = {r.query: r.expanded for r in asked.collect()}  # a row per query
        queries, question = [(wider.get(q, q), v) for q, v in queries], wider.get(question, question)
    found = multi_search(vectors, knowledge, queries, pool, **limits)
    if found.isEmpty():
        found = by_keywords(knowledge, question, pool, **limits)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    if order:
        wanted = ranked.sparkSession.range(1).select(F.posexplode(F.transform(F.filter(F.transform(F.split(F.lit(order), "[,、 ]+"), lambda x: F.trim(x).try_cast("int")), lambda n: n.isNotNull()), lambda n: n)).alias("_p", "rank"))
        wanted = wanted.groupBy("rank").agg(F.min("_p").alias("_p"))
        ranked = ranked.join(F.broadcast(wanted), "rank", "left")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_p").asc_nulls_last(), "rank"))).drop("_p")
    hits = ranked.filter(F.col("rank") <= k)
    if diversify is not None:
        pages = ranked.select(F.col("chunk_id").alias("id"), "page")
        swapped = rank.diversity_swap(hits.select(F.col("chunk_id").alias("id"), "source", "score", "rank"), ranked.select(F.col("chunk_id").alias("id"), "source", "score", "rank"), diversify)
        hits = swapped.join(pages, "id").select(F.col("id").alias("chunk_id"), "source", "page", "score", "rank")
    for step in steps or []:
        hits = step(hits)
    return hits


def by_keywords(knowledge: DataFrame, question: str, pool: int, **limits: DataFrame) -> DataFrame:
    """The pool of chunks by the weighted keyword score alone; chunks without any keyword take no part."""
    rows = retrieve.restricted(sets.deduplicated(knowledge, ["chunk_id"], ["ord"]), "source", limits.get("excluded"), limits.get("scope"))
    doc = F.coalesce("norm_text", T.match_text("summary", "keywords", "source", "full_text"))
    score = F.round(T.SPARSE_WEIGHT * T.key_score(T.distinct_keys(F.lit(question)), doc), 6)
    return retrieve.top(rows.select("chunk_id", "source", "page", "ord", score.alias("score")).filter("score > 0"), pool).drop("ord")


def norm_filled(knowledge: DataFrame) -> DataFrame:
    """knowledge whose empty norm_text is filled, so that searches don't fold texts anew; write it to keep it."""
    return knowledge.withColumn("norm_text", F.coalesce("norm_text", T.match_text("summary", "keywords", "source", "full_text")))


def widened(scoped: DataFrame, whole: DataFrame, least: int = 2) -> DataFrame:
    """The scoped hits, or those of the whole shelf where the scope gives fewer than `least`."""
    return scoped if scoped.limit(least).count() >= least else whole


def ingested(pages: DataFrame, shelf: DataFrame, origin: str, target: int = 700, overlap: int = 150, most: int = 1800) -> DataFrame:
    """Chunks to append for pages (source, text): cut, fingerprinted, without content that other sources hold already."""
    cleaned = pages.select("source", D.ingest_text(F.col("text")).alias("text"))
    chunks = ingest.structured_chunks(cleaned, "source", "text", target, overlap, most)
    named = chunks.withColumn("text", F.expr("replace(text, '〔資料〕', source)"))
    rows = named.select("source", F.lit(origin).alias("origin"), F.col("page"), F.col("seq"), F.col("text").alias("full_text"), D.section_path(F.col("text")).alias("section_path"), T.ref_labels("text").alias("refs"))
    rows = rows.withColumn("hash", ingest.fnv1a64(T.norm_hash("full_text"))).withColumn("chunk_id", F.concat(F.lit("bs::"), "hash", F.lit("::p"), F.col("page").cast("string"), F.lit("::c"), F.col("seq").cast("string")))
    rows = sets.deduplicated(rows, ["hash"], ["source", "seq"])
    held = shelf.select(F.lower("source").alias("_s"), ingest.fnv1a64(T.norm_hash("full_text")).alias("hash")).distinct()
    return rows.join(held, (rows["hash"] == held["hash"]) & (F.lower(rows["source"]) != held["_s"]), "left_anti")


def manifest_upserted(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """Manifest (file_path, status, chunk_count, streak) after changes: three failures in a row are permanent, success resets them, a count of -1 keeps the old one."""
    old = manifest.select("file_path", F.col("status").alias("_st"), F.col("chunk_count").alias("_n"), F.col("streak").alias("_k"))
    m = old.join(changes, "file_path", "full_outer")
    failed = F.col("status") == "failed"
    streak = F.when(F.col("status").isNull(), F.coalesce("_k", F.lit(0))).when(failed, F.coalesce("_k", F.lit(0)) + 1).otherwise(0)
    status = F.when(F.col("status").isNull(), F.col("_st")).when(failed & (streak >= 3), "failed_permanent").otherwise(F.col("status"))
    count = F.when(F.coalesce("chunk_count", F.lit(-1)) == -1, F.col("_n")).otherwise(F.col("chunk_count"))
    return m.select("file_path", status.alias("status"), count.alias("chunk_count"), streak.alias("streak"))


def manifest_scope(manifest: DataFrame, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Rows of the user's own files with a known extension in a folder, compared in any case."""
    top = folder.lower().rstrip("/") + "/"
    inside = F.lower("file_path").startswith(top) & ~F.contains(F.expr(f"substring(file_path, {len(top) + 1})"), F.lit("/"))
    return manifest.filter((F.col("origin") == "self") & inside & F.lower(F.regexp_extract("file_path", r"\.([^.]+)$", 1)).isin(*extensions))


def marked_missing(manifest: DataFrame, folder: str) -> DataFrame:
    here = (F.col("origin") == "self") & F.lower("file_path").startswith(folder.lower())
    return manifest.withColumn("status", F.when(here, "missing").otherwise(F.col("status")))


def streak_reset(manifest: DataFrame, path: str) -> DataFrame:
    here = F.col("file_path") == path
    return manifest.withColumn("streak", F.when(here, 0).otherwise(F.col("streak"))).withColumn("status", F.when(here & (F.col("status") == "failed_permanent"), "failed").otherwise(F.col("status")))


def legacy_documents(knowledge: DataFrame, meta: DataFrame, outline: DataFrame) -> DataFrame:
    """Sources with fewer meta rows than chunks or no outline, and how many chapters to expect."""
    k = knowledge.groupBy("source").agg(F.count("*").alias("chunks"))
    m = knowledge.join(meta.select("chunk_id"), "chunk_id", "left_semi").groupBy("source").agg(F.count("*").alias("meta"))
    o = outline.select("source").distinct().withColumn("outline", F.lit(True))
    rows = k.join(m, "source", "left").join(o, "source", "left").select("source", "chunks", F.coalesce("meta", F.lit(0)).alias("meta"), F.coalesce("outline", F.lit(False)).alias("outline"))
    return rows.filter((F.col("meta") < F.col("chunks")) | ~F.col("outline")).withColumn("chapters", D.estimated_chapters(F.col("chunks")))


def synonym_terms(knowledge: DataFrame, meta: DataFrame, outline: DataFrame, most: int = 200) -> DataFrame:
    """Candidate terms of a source: keywords, path segments and outline keywords of two characters or more, once each."""
    parts = [knowledge.select("source", F.explode(T.listed("keywords", "[,、;|]")).alias("term")), meta.select("source", F.explode(T.listed("section_path", ">")).alias("term")), outline.select("source", F.explode(T.listed("keywords", "[,、;|]")).alias("term"))]
    rows = parts[0].union(parts[1]).union(parts[2]).filter(F.length("term") >= 2).distinct()
    w = Window.partitionBy("source").orderBy("term")
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def channel_synced(shelf: DataFrame, pack: DataFrame, channel: str, local: str, remote: str, leaving: str | None = None) -> DataFrame:
    """The shelf after a channel's sync: unchanged for an equal version, else its origin (and the left one's) replaced by the pack."""
    if local == remote:
        return shelf
    gone = [f"channel:{channel}".lower(), *([f"channel:{leaving}".lower()] if leaving else [])]
    kept = shelf.filter(~F.lower("origin").isin(gone))
    return kept.unionByName(pack.withColumn("origin", F.lit(f"channel:{channel}")).select(*kept.columns))


def published(spark: SparkSession, versions: DataFrame, channel: str, path: str, stamp: str) -> DataFrame:
    """Versions (channel, path, version, current) with a new current one; a pointer, so readers never see half a pack."""
    old = versions.withColumn("current", F.col("current") & (F.col("channel") != channel))
    return old.unionByName(spark.createDataFrame([(channel, path, stamp, True)], versions.schema))


def rolled_back(versions: DataFrame, channel: str, version: str) -> DataFrame:
    here = F.col("channel") == channel
    return versions.withColumn("current", F.when(here, F.col("version") == version).otherwise(F.col("current")))


def migrated(stats: DataFrame, exported: DataFrame, owned: tuple[str, ...]) -> DataFrame:
    """stats (key, value) with the exported rows whose key starts with an owned prefix."""
    mine = exported.filter(" OR ".join(f"key LIKE '{p}%'" for p in owned))
    return sets.upserted(stats, mine, ["key"])


def noise_sources(stats: DataFrame) -> DataFrame:
    """Sources that a personal or a general exclusion of 1 or more names, for an anti join."""
    hit = F.lower("key").rlike("^(noise|gexcl):") & (F.col("value").try_cast("long") >= 1)
    return stats.filter(hit).select(F.regexp_replace("key", "^[^:]*:", "").alias("source")).distinct()


def gap_events(questions: DataFrame, sent: DataFrame, hours: int = 24) -> DataFrame:
    """Gap events (key, user, at) of questions (question, user_id, at): not empty, free of personal data once dates are gone, and not sent within the hours before."""
    q = questions.filter(F.trim("question") != "").filter(T.pii_kind(T.strip_dates("question")).isNull()).withColumn("key", T.question_key("question"))
    recent = sent.select(F.col("key").alias("_k"), F.col("at").alias("_at"))
    fresh = q.join(recent, (F.col("key") == F.col("_k")) & (F.col("_at") > F.col("at") - F.expr(f"INTERVAL {hours} HOURS")), "left_anti")
    return fresh.select("key", "question", D.anonymous(F.col("user_id")).alias("user"), "at")


def gap_list(gaps: DataFrame, most: int = 20) -> DataFrame:
    """The newest gaps in one line each."""
    return gaps.orderBy(F.desc("created_at"), "question").limit(most)


def thanks(inbox: DataFrame, me: list[str], seen: DataFrame) -> DataFrame:
    """Unseen thanks addressed to one of my names, in any case."""
    mine = inbox.filter(F.lower("addressee").isin([m.lower() for m in me]))
    return sets.new_rows(sets.deduplicated(mine, ["nonce"], ["at"]), seen, ["nonce"])


#: Points of a thank-you, and the counters that it moves.
THANKS_POINTS, POINTS, THANKED = 10, "exp_total", "thanks_received_total"


def thanked(inbox: DataFrame, me: list[str], seen: DataFrame, stats: DataFrame, points: int = THANKS_POINTS) -> DataFrame:
    """stats (key, value) after a pass over the inbox: each unseen thank-you to me counts once, and gives points."""
    n = thanks(inbox, me, seen).agg(F.count("*").alias("n"))
    deltas = n.select(F.explode(F.create_map(F.lit(POINTS), F.col("n") * points, F.lit(THANKED), F.col("n"))).alias("key", "delta")).filter("delta > 0")
    return bumped(stats, deltas)


def delivered(inbox: DataFrame, me: list[str], seen: DataFrame, most: int = 3) -> DataFrame:
    """The first unseen questions for me; the rest wait for the next pass."""
    return thanks(inbox, me, seen).orderBy("at", "nonce").limit(most)


def bumped(counters: DataFrame, events: DataFrame) -> DataFrame:
    """Counters (key, value) plus the deltas of events (key, delta)."""
    d = events.groupBy("key").agg(F.sum("delta").alias("_d"))
    return counters.join(d, "key", "full_outer").select("key", (F.coalesce("value", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias("value"))


def solved(events: DataFrame, ts: str, minutes: int = 15) -> DataFrame:
    """Keys sv:d:…, sv:m:…, sv:y:… and their minutes: each solved question counts in all three."""
    keys = F.array(F.date_format(ts, "'sv:d:'yyyyMMdd"), F.date_format(ts, "'sv:m:'yyyyMM"), F.date_format(ts, "'sv:y:'yyyy"))
    return events.select(F.explode(keys).alias("key")).groupBy("key").agg((F.count("*") * minutes).alias("minutes"))


def gallery(rows: DataFrame, keyword: str, page: int, size: int, source: str = "source") -> DataFrame:
    """One page of the sources that hold a keyword, in any case."""
    met = rows.select(source).distinct().filter(F.contains(F.lower(source), F.lit(keyword.lower())))
    return met.orderBy(source).offset(page * size).limit(size)


def pending_embedding(vectors: DataFrame, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Rows not embedded yet, with their vectors from an Arrow function."""
    return vectors.filter(~F.coalesce("embedded", F.lit(False))).withColumn("vector", embed(F.col(text))).withColumn("embedded", F.col("vector").isNotNull())


def line_diff(old: DataFrame, new: DataFrame, text: str = "text") -> DataFrame:
    """Lines of two texts that only one of them has, with how often."""
    side = lambda df, n: df.select(F.explode(F.split(text, "\n")).alias("line")).groupBy("line").agg(F.count("*").alias(n))
    both = side(old, "_a").join(side(new, "_b"), "line", "full_outer")
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    return both.select("line", F.greatest(a - b, F.lit(0)).alias("removed"), F.greatest(b - a, F.lit(0)).alias("added")).filter("removed > 0 or added > 0")


def context(hits: DataFrame, most: int = 60000) -> DataFrame:
    """The context of a prompt: hits in order under their source lines, as many characters as fit."""
    before = F.coalesce(F.sum(F.length("full_text")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = hits.withColumn("_b", before).withColumn("_t", F.expr(f"substring(full_text, 1, CAST(greatest({most} - _b, 0) AS INT))")).filter("_t <> ''")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "page", "_t"))), lambda h: F.concat(F.lit("["), h["source"], F.lit(" p."), h["page"].cast("string"), F.lit("]\n"), h["_t"]))
    return kept.agg(F.array_join(lines, "\n\n").alias("context"))

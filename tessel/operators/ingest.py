"""Ingest: pages, chunks, hashes, containment, manifests."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions.python import fnv1a64, small_batches, trimmed

RUN = 6
HELD = 1_000_000  # characters of chunks in a task before it gives them away


def html_text(html: Column | str) -> Column:
    """Text of a page: tags to spaces, white space to single spaces."""
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "[ \t\r\n]+", " "), r"^ +| +\z", "")


def form_feed_pages(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """key, page, text, truncated: pages between form feeds, blank ones at either end dropped, those past `most` cut."""
    p = docs.select(key, F.posexplode(F.split(text, "\f")).alias("_i", "text")).withColumn("page", F.col("_i") + 1)
    filled = p.filter(F.trim("text") != "").groupBy(key).agg(F.min("page").alias("_a"), F.max("page").alias("_b"))
    kept = p.join(filled, key).filter((F.col("page") >= F.col("_a")) & (F.col("page") <= F.col("_b")))
    return kept.filter(F.col("page") <= most).select(key, "page", "text", (F.col("_b") > most).alias("truncated"))


def join_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pages, text: pages in order, a marker line with its number before each."""
    marked = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("--- page "), x["page"].cast("string"), F.lit(" ---\n"), x["text"]))
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.array_join(marked, "\n").alias("text"))


def split_pages(text: Column) -> Column:
    """Inverse of join_pages: array of struct page, text."""
    pieces = F.split(text, r"(?:^|\n)--- page (?=[0-9]+ ---\n)", -1)
    return F.transform(F.filter(pieces, lambda p, i: i > 0), lambda p: F.struct(F.regexp_extract(p, "^([0-9]+) ---", 1).cast("int").alias("page"), F.regexp_replace(p, "^[0-9]+ ---\n", "").alias("text")))


def drop_garbled(pages: DataFrame, key: str, text: str, most: float = 0.2, least_chars: int = 50) -> DataFrame:
    """Pages without garbled ones; a document whose pages are all garbled keeps them, flagged."""
    bad = (F.length(text) >= least_chars) & (T.garble_ratio(text) > most)
    judged = pages.withColumn("_bad", bad)
    whole = judged.groupBy(key).agg(F.min(F.col("_bad").cast("int")).alias("_all"))
    return judged.join(whole, key).filter(~F.col("_bad") | (F.col("_all") == 1)).withColumn("all_garbled", F.col("_all") == 1).drop("_bad", "_all")


SENTENCE_END = re.compile(r"[.!?。！？\n]")


def windows(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of windows; an end moves forward to a sentence end within a quarter of the target."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + target, n)
        if end < n and (m := SENTENCE_END.search(text, end - 1, min(n, end + target // 4))):
            end = m.end()
        out.append((start, end))
        if end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


def _chunked(docs: DataFrame, key: str, text: str, cut, paged: bool = False) -> DataFrame:  # noqa: ANN001
    kind = docs.schema[key].dataType.simpleString()
    fields = [("seq", pa.int32()), *([("page", pa.int32())] if paged else []), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]

    def given(keys: pa.Array, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        schema = pa.schema([pa.field("k", keys.type), *fields])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], schema=schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, held = [], [], 0
            for row, t in enumerate(b.column(1)):
                for i, c in enumerate(cut(t.as_py() or "")):
                    at.append(row)
                    out.append((i, *c))
                    held += len(c[-1])
                    if held > HELD:
                        yield given(b.column(0), at, out)
                        at, out, held = [], [], 0
            if out:
                yield given(b.column(0), at, out)

    each = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return each.mapInArrow(trimmed(rows), f"k {kind}, seq int, {'page int, ' if paged else ''}start long, end long, text string").withColumnRenamed("k", key)


def fixed_chunks(docs: DataFrame, key: str, text: str, target: int, overlap: int) -> DataFrame:
    """key, seq, start, end, text: windows of a fixed size with overlap. A window starts where the last one ended, so this is sequential within a document."""

    def cut(t: str) -> list[tuple]:
        return [(a, b, t[a:b]) for a, b in windows(t, target, overlap)]

    return _chunked(docs, key, text, cut)


NUMERAL = "[0-9０-９一二三四五六七八九十]+"
#: Line classes in the order that decides: class, pattern, fewer characters than, characters that rule it out.
LINE_RULES = (
    (1, re.compile("^# "), None, ""),
    (1, re.compile("^【.*】"), 61, ""),
    (1, re.compile(f"^第{NUMERAL}[編章]"), None, ""),
    (2, re.compile("^##+ "), None, ""),
    (2, re.compile(f"^第{NUMERAL}[条節]"), None, ""),
    (2, re.compile(r"^[0-9]+\."), 50, ""),
    (2, re.compile("^[■●◆]"), 40, "。"),
    (3, re.compile(f"^第{NUMERAL}項"), None, ""),
    (3, re.compile("^(?:・|- |[(（][0-9０-９]|[①-⑳])"), None, ""),
)
DOTTED = re.compile("(?:[.．・…‥]{2,}|[…‥])[ ]*[0-9０-９]+[ ]*$")


def line_class(line: str) -> int:
    """0 body, 1 chapter, 2 section, 3 item, 4 table; equal to text.line_class."""
    t = line.strip(" ")
    if "\t" in line or "   " in t or "|" in line:
        return 4
    return next((c for c, p, below, without in LINE_RULES if p.match(t) and (below is None or len(t) < below) and not (without and without in t)), 0)


def contents_page(page: str) -> bool:
    lines = [x for x in page.split("\n") if x.strip(" ")]
    return len(lines) >= 3 and 2 * sum(bool(DOTTED.search(x)) for x in lines) >= len(lines)


def structured_chunks(docs: DataFrame, key: str, text: str, target: int, overlap: int, most: int) -> DataFrame:
    """key, seq, page, start, end, text: blocks between headings after a breadcrumb line, cut into windows where they are longer than `most`.

    Pages are parted by form feeds; headings hold over pages, and pages of contents have none. Table lines keep their spacing,
    other lines have single spaces. A chunk's page is that of its first ink; start and end count within its block's text.
    """

    def cut(t: str) -> list[tuple]:
        out: list[tuple] = []
        heads = ["", ""]
        block: list[tuple[int, str]] = []

        def flush() -> None:
            body = "\n".join(line for _, line in block)
            if body.strip():
                crumb = "【" + " > ".join(x for x in ("〔資料〕", *heads) if x) + "】\n"
                starts, at = [], 0
                for page, line in block:
                    starts.append((at, page))
                    at += len(line) + 1
                spans = [(0, len(body))] if len(body) <= most - len(crumb) else windows(body, target, overlap)
                for a, b in spans:
                    ink = a + len(body[a:b]) - len(body[a:b].lstrip())
                    page = next((p for s, p in reversed(starts) if s <= ink), 1)
                    out.append((page, a, b, crumb + body[a:b]))
            block.clear()

        for number, page in enumerate(t.split("\f"), 1):
            plain = contents_page(page)
            for line in page.split("\n"):
                c = 0 if plain else line_class(line)
                if c in (1, 2):
                    flush()
                    heads[:] = [line.strip(), ""] if c == 1 else [heads[0], line.strip()]
                block.append((number, line.rstrip() if c == 4 else re.sub(" {2,}", " ", line.strip())))
        flush()
        return out

    return _chunked(docs, key, text, cut, paged=True)


def containing(docs: DataFrame, probes: DataFrame, key: str, text: str, probe_key: str, probe: str, more: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """(probe key, key, more) of texts that contain a probe.

    The table of probes is one row per question; up to `most` of them are broadcast and tested in one pass over the
    texts. Beyond that the texts' runs of RUN words meet the probes' first RUN words in a shuffled join, and only pairs
    that share a run are verified.
    """
    asked = probes.select(F.col(probe_key), F.col(probe).alias("_p"))
    extra = more or []
    if asked.limit(most + 1).count() <= most:
        return docs.select(key, text, *extra).join(F.broadcast(asked), F.contains(F.col(text), F.col("_p"))).select(probe_key, key, *extra)
    words = lambda c: F.split(F.lower(c), r"\W+")
    runs = lambda w: F.when(F.size(w) >= RUN, F.transform(F.sequence(F.lit(1), F.size(w) - RUN + 1), lambda i: F.xxhash64(F.slice(w, i, RUN)))).otherwise(F.array(F.lit(0).cast("long")))
    inner = asked.withColumn("_w", words(F.col("_p"))).withColumn("_h", F.when(F.size("_w") >= RUN + 2, F.xxhash64(F.slice("_w", 2, RUN))))
    offered = docs.select(key, F.explode(F.array_distinct(runs(words(F.col(text))))).alias("_h"))
    met = offered.join(inner.filter("_h is not null").select(probe_key, "_p", "_h"), "_h").select(key, probe_key, "_p").distinct()
    found = docs.join(met, key).filter(F.contains(F.col(text), F.col("_p"))).select(probe_key, key, *extra)
    short = docs.select(key, text, *extra).join(inner.filter("_h is null").select(probe_key, "_p"), F.contains(F.col(text), F.col("_p"))).select(probe_key, key, *extra)
    return found.union(short)


def manifest_diff(listed: DataFrame, manifest: DataFrame, name: str = "file_name") -> DataFrame:
    """name and decision: ingest, replace, keep or missing, of a listing (size, modified_at) against a manifest (also status)."""
    l = listed.select(F.lower(name).alias("_n"), F.col("size").alias("_ls"), F.col("modified_at").alias("_lm"))
    m = manifest.select(F.lower(name).alias("_n"), F.col("size").alias("_ms"), F.col("modified_at").alias("_mm"), "status")
    changed = (F.col("_ls") != F.col("_ms")) | (F.abs(F.unix_micros(F.col("_lm").cast("timestamp")) - F.unix_micros(F.col("_mm").cast("timestamp"))) > 2_000_000)
    decision = F.when(F.col("_ms").isNull(), "ingest").when(F.col("_ls").isNull(), "missing").when(changed | F.col("status").isin("failed", "missing"), "replace").otherwise("keep")
    return l.join(m, "_n", "full_outer").select(F.col("_n").alias(name), decision.alias("decision"))

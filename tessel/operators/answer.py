"""Routes from a question to the material of an answer: parts, chapters, carried context, prompts, spans to show. Answers of a model arrive as columns or arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import decide as D
from tessel.functions import text as T
from tessel.operators import expand
from tessel.operators.rank import HITS

#: What parts turns of a conversation, how long a carried turn and all of them may be, how a carried answer says where it is from, what parts cells of a line.
TURN, CARRY, CARRY_ALL = ";;;", 4000, 20016
HEAD, TAIL = "【直前の", "での文脈】"
NAMES = {"rag": "社内ナレッジ検索", "normal": "一般アシスタント"}
CELLS = "│ "
#: Matches whose starts are folded into one array before it is put beside the others.
SPANS = 256


def by_parts(parts: list[str], search: Callable[[str, int], DataFrame], k: int) -> DataFrame:
    """Hits of a question in several parts: each part takes its share of k from search(part, share); a chunk counts once, by the first part that found it, best score first within a part.

    search gives chunk_id, source, page, score; the result adds part, from 1, and rank over all parts.
    """
    share = max(k // max(len(parts), 1), 6)
    found = None
    for i, part in enumerate(parts, 1):
        rows = search(part, share).select("chunk_id", "source", "page", "score", F.lit(i).alias("part"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no parts")
    first = found.groupBy("chunk_id").agg(F.min(F.struct("part", (-F.col("score")).alias("_s"), "source", "page")).alias("f"))
    rows = first.select("chunk_id", "f.source", "f.page", (-F.col("f._s")).alias("score"), "f.part")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("part", F.desc("score"), "chunk_id")))  # at most `share` hits a part


def by_outline(chunks: DataFrame, outline: DataFrame, picks: Column, question: DataFrame, total: int, least: int, most: int = 8) -> DataFrame:
    """Material of a question about the whole shelf: chunks (source, chap, ord, len) of the chapters that an answer picks by their numbers in the outline (n, source, chap), cut to each one's share of the total.

    picks is a column of question, a table of one row; picks that name no chapter are passed over, the first `most` count.
    """
    numbers = T.listed(picks, "[,、 \n]+")
    chosen = question.select(F.posexplode(F.array_distinct(F.filter(F.transform(numbers, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))).alias("ord", "n"))
    met = chosen.join(outline.select("n", "source", "chap"), "n").orderBy("ord").limit(most)
    return expand.chapter_hits(chunks, met.select("source", "chap", "ord"), total, least)


def outline(groups: DataFrame, chunks: DataFrame, summary: Callable[[Column], Column], most: int) -> DataFrame:
    """A row per chapter: source, chap, n (its place in the source), summary, keywords of the chapter's first `most` characters; a chapter without an answer says so.

    groups has source, chap and first (place of its first chunk); chunks has source, chap, ord, full_text; summary turns a column of text into struct summary, keywords.
    """
    w = Window.partitionBy("source", "chap").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("full_text")).over(w), F.lit(0))
    taken = chunks.withColumn("_b", before).filter(F.col("_b") < most)
    body = taken.groupBy("source", "chap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "full_text"))), lambda x: x["full_text"]), "\n").alias("_body"))
    made = groups.join(body, ["source", "chap"], "left").withColumn("_s", summary(F.substring("_body", 1, most)))
    n = F.row_number().over(Window.partitionBy("source").orderBy("first"))
    return made.select("source", "chap", n.alias("n"), F.coalesce(F.nullif(F.col("_s.summary"), F.lit("")), F.lit("（要約失敗）")).alias("summary"), F.coalesce("_s.keywords", F.lit("")).alias("keywords"))


def turns_of(history: Column) -> Column:
    """The turns of a history, newest first; none of an empty one."""
    return F.when(F.coalesce(history, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(history, TURN, -1))


def plain_turn(turn: Column) -> Column:
    """A turn without the line that says where it is from, cut to its last CARRY characters."""
    at = F.instr(turn, "\n")
    return F.right(F.when(turn.startswith(HEAD) & (at > 0), F.substr(turn, at + 1)).otherwise(turn), F.lit(CARRY))


def headed(turn: Column, mode: Column) -> Column:
    name = F.when(mode == "normal", NAMES["normal"]).otherwise(NAMES["rag"])
    return F.when(turn.startswith(HEAD), turn).otherwise(F.concat(F.lit(HEAD), name, F.lit(TAIL + "\n"), turn))


def fitting(turns: Column) -> Column:
    """The first turns that fit into CARRY_ALL with what parts them; the first one always does."""
    return T.bound(turns, lambda t: F.filter(t, lambda x, i: (i == 0) | (F.aggregate(F.slice(t, 1, i + 1), F.lit(0), lambda a, y: a + F.length(y)) + i * len(TURN) <= CARRY_ALL)))


def bridged(source_q: Column, source_a: Column, target_q: Column, target_a: Column, source: Column, target: Column, most: Column, enabled: Column | None = None) -> Column:
    """What a conversation looks like after a change of mode: struct moved, questions, answers.

    The first `most` pairs of the mode that was left come before the target's own, `most` in all, answers under a line that says where they are from. A pair that
    the target holds already, question and answer, is not carried again, and nothing moves if its first pair is the one that
    would come first, if there is nothing to carry, within one mode, between unknown ones, or where switched off.
    """
    most = F.greatest(most, F.lit(1))
    text = lambda x: F.coalesce(x, F.lit(""))
    known = F.lit(True) if enabled is None else enabled
    apart = ((source == "rag") & (target == "normal")) | ((source == "normal") & (target == "rag"))

    def of(held: Column) -> Column:
        sq, sa, dq, da = held["sq"], held["sa"], held["dq"], held["da"]
        item = lambda a, i: text(F.get(a, i))
        there = lambda i: (item(sq, i) != "") & F.exists(F.transform(dq, lambda x, j: (plain_turn(x) == plain_turn(item(sq, i))) & (plain_turn(item(da, j)) == plain_turn(item(sa, i)))), lambda x: x)
        stays = F.filter(F.sequence(F.lit(0), most - 1), lambda i: ~((i < F.size(sq)) & there(i)))
        carry = lambda a, made: fitting(F.transform(F.filter(stays, lambda i: i < F.size(a)), lambda i: made(F.right(F.get(a, i), F.lit(CARRY)))))
        q, a = carry(sq, lambda x: x), carry(sa, lambda x: headed(x, source))
        leads = ((F.size(dq) > 0) | (F.size(da) > 0)) & (item(dq, F.lit(0)) == F.right(item(sq, F.lit(0)), F.lit(CARRY))) & (item(da, F.lit(0)) == headed(F.right(item(sa, F.lit(0)), F.lit(CARRY)), source))
        some = (item(sq, F.lit(0)) != "") | (item(sa, F.lit(0)) != "")
        joined = lambda new, old: F.array_join(F.slice(F.concat(new, old), 1, F.when(F.size(old) > 0, most).otherwise(F.size(new))), TURN)
        moved = F.coalesce(apart & known & some & ~leads & ((F.size(q) > 0) | (F.size(a) > 0)), F.lit(False))
        return F.struct(moved.alias("moved"), F.when(moved, joined(q, dq)).otherwise(text(target_q)).alias("questions"), F.when(moved, joined(a, da)).otherwise(text(target_a)).alias("answers"))

    return T.bound(F.struct(turns_of(source_q).alias("sq"), turns_of(source_a).alias("sa"), turns_of(target_q).alias("dq"), turns_of(target_a).alias("da")), of)


def clarify_prompt(sources: Column, intents: list[str], head: str, most: int = 4) -> Column:
    """A question back: the sources by number, 0 for none of them, then what may be meant by circled numbers."""
    listed = F.slice(F.filter(F.split(F.coalesce(sources, F.lit("")), r"\|"), lambda x: x != ""), 1, most)
    numbered = F.transform(listed, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s))
    choices = [F.lit(f"  {chr(0x2460 + i)} {x}") for i, x in enumerate(intents)]
    return F.array_join(F.concat(F.array(F.lit(head)), F.when(F.size(listed) > 0, F.concat(numbered, F.array(F.lit("  0. -")))).otherwise(numbered), F.array(*choices)), "\n")


def rerank_prompt(hits: DataFrame, question: str, most: int) -> DataFrame:
    """One prompt: the question, then hits by number, as many characters as fit; hits has rank, source, page, full_text."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # the hits of one question
    rows = hits.orderBy("rank").limit(HITS).withColumn("_b", F.coalesce(F.sum(F.length("full_text")).over(w), F.lit(0)))
    rows = rows.withColumn("_t", F.expr(f"substring(full_text, 1, CAST(greatest({most} - _b, 0) AS INT))")).filter("_t <> ''")
    line = lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] "), h["source"], F.lit(" p."), h["page"].cast("string"), F.lit("\n"), h["_t"])
    return rows.agg(F.concat(F.lit(question + "\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "page", "_t"))), line), "\n")).alias("prompt"))


def spans(text: Column, pattern: str) -> Column:
    """Start (from 1) and length of every match in a text: what a viewer highlights. The text is searched once for matches and once for what lies between; starts are folded from match to match, in blocks of SPANS, so work grows with the text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    spot = "array<struct<start:int,length:int>>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        return F.struct((start + x["length"]).alias("at"), F.concat(a["out"], F.array(F.struct((start + 1).alias("start"), x["length"].alias("length")))).alias("out"))

    def of(pairs: Column) -> Column:
        block = lambda a, i: F.aggregate(F.slice(pairs, i * SPANS + 1, SPANS), F.struct(a["at"].alias("at"), F.array().cast(spot).alias("out")), step)
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(pairs) - 1, F.lit(0)) / SPANS).cast("int"))
        put = lambda a, i: T.bound(block(a, i), lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], F.array(x["out"])).alias("out")))
        return F.when(pairs.isNotNull(), F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spot}>").alias("out")), put, lambda a: a["out"])))

    return T.bound(F.slice(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("length"))), 1, F.size(found)), of)


def viewed(text: Column) -> Column:
    """What a viewer marks in a shown passage: struct head (its first line), crumb (the line after it, if that is a breadcrumb), refs (bracketed tags at the start of lines or cells) and close (the last line), each struct start (from 1; 0 for none) and length.

    Lines are cut at their ends, never searched for from every character, and the pattern of a tag begins with its bracket and looks back from there.
    """
    mark = lambda start, length: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))
    none = mark(F.lit(0), F.lit(0))
    first = lambda s: F.length(F.substring_index(s, "\n", 1))

    def of(held: Column) -> Column:
        text, flat, n, line = held["text"], held["flat"], F.length(held["text"]), held["line"]
        after, last = F.substr(flat, line + 2), F.length(F.substring_index(flat, "\n", -1))
        crumb = F.when((line + 1 < n) & after.startswith("【"), mark(line + 2, first(after))).otherwise(none)
        close = F.when((last > 0) & (last < n), mark(n - last + 1, last)).otherwise(none)
        refs = F.transform(spans(text, f"\\[(?<=(?:\\A|[\r\n]|{CELLS})\\[)[^\\]\r\n]*+\\]"), lambda s: mark(s["start"], s["length"]))
        return F.struct(F.when(n > 0, mark(F.lit(1), line)).otherwise(none).alias("head"), crumb.alias("crumb"), refs.alias("refs"), close.alias("close"))

    flat = F.replace(text, F.lit("\r"), F.lit("\n"))
    return T.bound(T.bound(F.struct(text.alias("text"), flat.alias("flat")), lambda h: F.struct(h["text"].alias("text"), h["flat"].alias("flat"), first(h["flat"]).alias("line"))), of)


def plan(mode: Column) -> Column:
    """What a mode does: struct k, queries, expand, rerank, verify."""
    return F.struct(D.top_k(mode).alias("k"), D.sub_queries(mode).alias("queries"), (mode != "quick").alias("expand"), (mode != "quick").alias("rerank"), (mode == "thorough").alias("verify"))

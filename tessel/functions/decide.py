"""Decisions and small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions.python import fnv1a64

#: What a memo's source starts with, and the mark of an unverified citation.
MEMO_PREFIX = "訂正メモ"
MARK = "（未確認）"


def memo_source(source: Column, prefix: str = MEMO_PREFIX) -> Column:
    return source.startswith(prefix)


def gap_row(kind: Column, reason: Column, consumed: Column) -> Column:
    return (kind == "gap") & ~consumed & (F.coalesce(reason, F.lit("")) != "correction")


def within_window(stamp: Column, limit: Column) -> Column:
    """Strictly newer than the limit; false where either is no time."""
    return F.coalesce(stamp.try_cast("timestamp") > limit.try_cast("timestamp"), F.lit(False))


def gap_aged(kind: Column, created: Column, cutoff: Column) -> Column:
    """Gaps and corrections older than the cutoff; an empty date keeps a row."""
    return kind.isin("gap", "correction") & (F.coalesce(created, F.lit("")) != "") & (created < cutoff)


def too_vague(question: Column, best: Column, gap: Column, most_chars: int = 10, least_score: float = 0.6, least_gap: int = 15) -> Column:
    """A short question whose best score is low or whose sources score alike; never one that asks for the whole."""
    scattered = (gap >= 0) & (gap < least_gap)
    return ~T.global_signal(question) & (F.length(F.trim(question)) <= most_chars) & ((best < least_score) | scattered)


def decompose_gate(mode: Column, question: Column, least_chars: int = 25) -> Column:
    asked = (F.length(question) >= least_chars) | T.compound_signal(question) | T.global_signal(question)
    mode = F.lower(F.trim(mode))
    return F.when(mode == "off", False).when(mode == "always", True).otherwise(asked)


def document_class(has_meta: Column, has_outline: Column, breadcrumb: Column) -> Column:
    return F.when(has_meta & has_outline, "").when(~breadcrumb, "cannot").otherwise("needs")


def shrunk(before: Column, now: Column) -> Column:
    """A table lost rows since it was last saved; without a record of before nothing is said."""
    return (before > 0) & (now < before)


def volatile_path(path: Column, *temporary: str) -> Column:
    """A folder that is gone next time: unpacked from or inside a zip, or in or below one of the temporary folders; in any case of letters."""
    p = F.lower(F.trim(path))
    below = F.concat(p, F.when(p.endswith("\\"), "").otherwise("\\"))
    out = F.contains(p, F.lit("temp1_")) | F.contains(p, F.lit(".zip\\"))
    for folder in temporary:
        if folder.strip():
            out = out | below.startswith(folder.strip().lower().rstrip("\\") + "\\")
    return (p != "") & out


def can_view(listed: Column, admin: Column, publisher: Column) -> Column:
    return F.when(listed, admin).otherwise(publisher)


def expiry(reached: Column, days: Column, limit: Column, warned: Column, wiped: Column, reachable: Column, ahead: int = 7) -> Column:
    """What to do with a copy of the shelf that has not reached the share for days: off without a limit, never without a known reach, none while it can be reached or is early,
    warn once a day value in the last days, warn_first past the limit without any warning before, then wipe once. reached, warned and wiped are texts, empty where unset."""
    held = lambda c: F.trim(F.coalesce(c, F.lit("")))
    early = (days < F.greatest(limit - ahead, F.lit(1))) | (held(warned) == days.cast("string"))
    return (
        F.when(limit <= 0, "off")
        .when(held(reached) == "", "never")
        .when(reachable | (days <= 0), "none")
        .when(days < limit, F.when(early, "none").otherwise("warn"))
        .when(held(warned) == "", "warn_first")
        .when(held(wiped) != "", "none")
        .otherwise("wipe")
    )


def low_hit(best: Column, least: float = 0.3) -> Column:
    return F.coalesce(best, F.lit(0.0)) < least


def usage_percent(used: Column, most: Column) -> Column:
    """Half-even percent, 100 at most; 0 without a limit or use."""
    return F.when((most < 1) | (used <= 0), F.lit(0).cast("long")).otherwise(F.least(F.bround(100.0 * used / most, 0).cast("long"), F.lit(100).cast("long")))


def top_k(mode: Column, quick: int = 6, deep: int = 12, thorough: int = 16) -> Column:
    return F.when(mode == "thorough", thorough).when(mode == "deep", deep).otherwise(quick)


def sub_queries(mode: Column, normal: int = 3, thorough: int = 6) -> Column:
    """How many queries a question is turned into, one at least."""
    return F.greatest(F.when(mode == "thorough", thorough).otherwise(normal), F.lit(1))


def per_chapter_cap(total: Column, chapters: Column, least: Column) -> Column:
    return F.greatest(F.floor(total / F.greatest(chapters, F.lit(1))), least)


def per_part_top_k(k: Column, parts: Column) -> Column:
    return F.greatest(F.floor(k / F.greatest(parts, F.lit(1))), F.lit(6))


def prefilter(rows: Column, least: int, explicit: Column, auto: Column, scoped: Column) -> Column:
    """Whether to scan sign bits first: asked for, or automatic from enough rows; never within a scope."""
    return ~scoped & (explicit | (auto & (rows >= least)))


def same_time(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) <= 2_000_000


def elapsed_ms(start: Column, now: Column) -> Column:
    """Milliseconds between two seconds of the day, over midnight too."""
    return F.floor(F.pmod(now - start, F.lit(86400.0)) * 1000).cast("long")


def batch_bounds(total: Column, size: Column, index: Column) -> Column:
    """First and last page of a batch, from 1; null past the end."""
    first = index * size + 1
    return F.when(first <= total, F.struct(first.alias("first"), F.least(first + size - 1, total).alias("last")))


def rotation_start(files: Column, cap: Column, serial: Column) -> Column:
    return F.when(files > cap, F.pmod(F.pmod(F.abs(serial), files) * cap, files)).otherwise(F.lit(0).cast("long"))


def page_at(starts: Column, pages: Column, position: Column) -> Column:
    """The page whose start is the last one not after the position; null before the first."""
    return F.get(pages, F.size(F.filter(starts, lambda s: s <= position)) - 1)


def estimated_chapters(chunks: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.floor(chunks / 3).cast("int")))


def thin_extract(ext: Column, pages: Column, chunks: Column, chars: Column) -> Column:
    return (ext == "pdf") & (pages >= 10) & ((chunks <= F.floor(pages / 20)) | (chars < 60 * pages))


def diff_decision(known: Column, size_changed: Column, time_changed: Column) -> Column:
    return F.when(~known, "ingest").when(size_changed | time_changed, "replace").otherwise("keep")


def resolved(decision: Column, known: Column, status: Column) -> Column:
    """A kept file that failed or went missing is replaced; one that failed for good stays."""
    return F.when((decision == "keep") & known & status.isin("failed", "missing"), "replace").otherwise(decision)


def pending_expired(saved: Column, now: Column, minutes: int = 30) -> Column:
    """Strictly older than the minutes; a time that can't be read is expired, an empty one is not."""
    t = saved.try_cast("timestamp")
    return F.when(F.coalesce(saved, F.lit("")) == "", False).otherwise(F.coalesce(t < now - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(True)))


def lock_action(held: Column, age: Column, stale: Column) -> Column:
    return F.when(~held, "go").when(F.abs(age) >= stale, "stale").otherwise("wait")


def board_status(body: Column, rows: Column, made: Column, cutoff: Column) -> Column:
    """broken where the closing line doesn't count the rows, old before the cutoff, else ok."""
    return F.when(F.coalesce(F.regexp_extract(body, "#end ([0-9]+)$", 1).try_cast("long") != rows, F.lit(True)), "broken").when(made < cutoff, "old").otherwise("ok")


def nonce_keep_days(days: Column) -> Column:
    return days + 7


def beacon(user: Column, thanks: Column, dk: Column, dm: Column, mk: Column, mm: Column, yk: Column, ym: Column, team: Column) -> Column:
    return F.concat_ws("\t", user, *[c.cast("string") for c in (thanks, dk, dm, mk, mm, yk, ym)], team)


def beacon_fields(line: Column) -> Column:
    """Fields of a beacon with its stamp; nine-field lines have no team; null for shorter ones or without a user."""
    f = F.split(line, "\t")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    names = ("user", "thanks", "day_key", "day_min", "month_key", "month_min", "year_key", "year_min")
    body = [(at(i).try_cast("long") if n.endswith("min") or n == "thanks" else at(i)).alias(n) for i, n in enumerate(names)]
    return F.when((F.size(f) >= 9) & (at(0) != ""), F.struct(*body, F.when(F.size(f) >= 10, at(8)).otherwise("").alias("team"), F.when(F.size(f) >= 10, at(9)).otherwise(at(8)).alias("stamp")))


def safe_left(s: Column, n: int) -> Column:
    """As many characters as fit into n units of UTF-16, in which those beyond U+FFFF take two; none is cut in half."""
    plain = F.substring(s, 1, max(n, 0))
    wide = F.regexp_replace(plain, "([^\\x{0}-\\x{FFFF}])", "$1\uffff")  # a wide character's second unit
    return F.when(plain.rlike("[^\\x{0}-\\x{FFFF}]"), F.regexp_replace(F.regexp_replace(F.substring(wide, 1, max(n, 0)), "[^\\x{0}-\\x{FFFF}]$", ""), "\uffff", "")).otherwise(plain)


def ingest_text(s: Column) -> Column:
    """Without lines that are page numbers, spaces inside article numbers closed."""
    lines = F.filter(F.split(s, "\n"), lambda x: ~T.page_number_line(x) | (F.trim(x) == ""))
    return F.array_join(F.transform(lines, joined_numbers), "\n")


def joined_numbers(line: Column) -> Column:
    """第 １ ２ 条 becomes 第12条: between 第 and its unit spaces go and digits fold, however many there are; all else stays."""
    label = "第[ 　\t]*[0-9０-９][0-9０-９ 　\t]*[条章節項号編]"
    fold = lambda x: F.translate(x, "０１２３４５６７８９ 　\t", "0123456789")
    found = F.concat(F.transform(F.regexp_extract_all(line, F.lit(label), F.lit(0)), fold), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(line, label, -1), found, lambda gap, x: F.concat(gap, x)), "")


def breadcrumb(source: Column, chapter: Column, section: Column) -> Column:
    parts = F.filter(F.array(source, chapter, section), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat(F.lit("【"), F.array_join(parts, " > "), F.lit("】"))


def section_path(chunk: Column, most: int = 200) -> Column:
    """Chapter and section of a chunk's breadcrumb line, joined by >; empty without one."""
    inner = F.regexp_extract(chunk, "^【([^】\n]*)】", 1)
    return F.substring(F.array_join(F.slice(F.split(inner, " > "), 2, 10), ">"), 1, most)


def anonymous(user: Column) -> Column:
    """The id's hash as fnv1a64 gives it; an empty id stays empty."""
    return F.when(user == "", "").otherwise(fnv1a64(user))


def unverified(answer: Column, known: Column) -> Column:
    """The mark after every citation that is not among the known ones; spaces don't count."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    good = F.transform(known, bare)
    return F.aggregate(F.slice(F.array_distinct(T.cite_tags(answer)), 1, 64), answer, lambda a, t: F.when(F.array_contains(good, bare(t)), a).otherwise(F.replace(a, t, F.concat(t, F.lit(MARK)))))


def choice_numbers(s: Column, most: int) -> Column:
    """Distinct numbers in range from digits, wide digits and circled ones; anything else voids the answer."""
    circled = "".join(chr(0x2460 + i) for i in range(20))
    plain = F.translate(s, "０１２３４５６７８９", "0123456789")
    spaced = F.regexp_replace(plain, f"([{circled}])", " $1 ")
    parts = F.filter(F.split(spaced, "[ 　,、，.．・\n\t]+"), lambda x: x != "")
    number = lambda x: F.coalesce(F.when(x.rlike(f"^[{circled}]$"), F.ascii(x) - 0x245F), x.try_cast("int"))
    numbers = F.transform(parts, number)
    return F.when(F.exists(numbers, lambda n: n.isNull()), F.array().cast("array<int>")).otherwise(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= most))))


def path_escapes(s: Column) -> Column:
    """Why a name can't be that of a folder: 'parent' for two dots, 'start' or 'end' for a space, TAB or dot there; empty where it can."""
    edge = lambda c: c.isin(" ", ".", "\t", "　")
    return F.when(s == "", "").when(F.contains(s, F.lit("..")), "parent").when(edge(F.left(s, F.lit(1))), "start").when(edge(F.right(s, F.lit(1))), "end").otherwise("")


def cell_safe(s: Column) -> Column:
    """A spreadsheet cell: formula starters get a quote before them."""
    return F.when(F.left(s, F.lit(1)).isin("=", "+", "-", "@"), F.concat(F.lit("'"), s)).otherwise(s)


def encoding_pick(utf8: Column, known: Column, other: Column) -> Column:
    return F.when(known & (other < utf8), "shift_jis").otherwise("utf-8")


def key_match(question: Column, memo: Column) -> Column:
    """Percent of a question's search keys that a memo's text holds; -1 with fewer than two."""
    keys = T.distinct_keys(question)
    hits = F.size(F.filter(keys, lambda k: F.contains(T.compact(memo), k)))
    return F.when(F.size(keys) < 2, -1).otherwise(F.floor(100 * hits / F.size(keys)).cast("int"))


def memo_level(question: Column, memo: Column, least: int = 60) -> Column:
    """2 for the same question, 1 for enough shared keys, else 0."""
    return F.when(T.question_key(question, None) == T.question_key(memo, None), 2).when(key_match(question, memo) >= least, 1).otherwise(0)


def wrong_source(line: Column, source: Column, page: Column) -> Column:
    """Whether a list of `source p.N` names this source and page."""
    entries = F.transform(F.split(line, "[|,、\n]"), lambda x: F.lower(F.trim(x)))
    return F.array_contains(entries, F.concat(F.lower(source), F.lit(" p."), page.cast("string")))


def author_id(stored: Column, must_resolve: Column, author: Column) -> Column:
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(must_resolve, "").otherwise(author))


def embedding_arrays(response: Column) -> Column:
    """The vectors of a response {"data": [{"embedding": […]}]}."""
    return F.from_json(response, "data array<struct<embedding:array<double>>>")["data"]["embedding"]


def enrichments(response: Column) -> Column:
    """Rows of a model's [{"i", "summary", "keywords"}], scanned rather than parsed: text around, broken ends and missing fields (then empty) do no harm; an entry without a number is passed over."""

    def value(piece: Column, name: str) -> Column:
        raw = F.regexp_extract(piece, f'(?is)"{name}"[^:]*:[^"]*"((?:\\\\.|[^"\\\\])*)', 1)
        plain = F.replace(F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
        return F.replace(F.regexp_replace(plain, r"(?s)\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))

    pieces = F.filter(F.split(F.coalesce(response, F.lit("")), '"i"', -1), lambda p, i: i > 0)
    numbered = F.filter(pieces, lambda p: p.rlike("^[^:]*:[ ]*[0-9]"))
    return F.transform(numbered, lambda p: F.struct(F.regexp_extract(p, "^[^:]*:[ ]*([0-9]+)", 1).try_cast("int").alias("i"), value(p, "summary").alias("summary"), value(p, "keywords").alias("keywords")))


def distinct_lines(s: Column, most: int) -> Column:
    """Lines once each in any case, the first `most`."""
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.aggregate(lines, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x))))
    return F.slice(kept, 1, most)

"""Spans of regular expressions in native expressions: positions in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,end:long,text:string,before:string,after:string>>"
STEP = 128
CONTEXT = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a Java pattern, as array<struct<start, end, text, before, after>>; none in a null text.

    Texts between the matches give the positions. Sums run within steps of STEP matches and over the steps, so the
    cost of many matches in one text stays low. before holds up to CONTEXT characters since the last match began, after
    the next character.
    """

    def located(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(F.transform(found, lambda m, i: piece(found, gaps, m, i)), stepped))

    def piece(found: Column, gaps: Column, m: Column, i: Column) -> Column:
        gap, nothing = F.get(gaps, i), F.lit("")
        before = F.right(F.concat(F.when(i > 0, F.get(found, i - 1)).otherwise(nothing), gap), F.lit(CONTEXT))
        after = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), nothing)), F.lit(1))
        return F.struct(F.length(gap).cast("long").alias("g"), F.length(m).cast("long").alias("n"), m.alias("t"), before.alias("before"), after.alias("after"))

    def stepped(pieces: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STEP).cast("int")), lambda b: F.slice(pieces, b * STEP + 1, STEP))
        return let(steps, joined)

    def joined(steps: Column) -> Column:
        length = F.transform(steps, lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["n"]))
        starts = F.aggregate(
            length,
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )
        return F.flatten(F.zip_with(steps, starts, within))

    def within(step: Column, start: Column) -> Column:
        return F.aggregate(
            step,
            F.struct(start.alias("at"), F.array().cast(SPAN).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["g"] + x["n"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["n"]).alias("end"), x["t"].alias("text"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(F.array().cast(SPAN))


def kinded(spans: Column, kind: str, order: int) -> Column:
    """Spans as array<struct<start, rank, end, kind>>, which sort by start, then kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def most_before(values: Column) -> Column:
    """For each place of an array of numbers the largest value before it, null at the first; nulls are passed over.

    Steps of STEP values, and the largest of each step, keep the cost of long arrays low.
    """

    def stepped(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda b: F.slice(v, b * STEP + 1, STEP))
        return let(steps, lambda s: let(F.transform(s, F.array_max), lambda tops: F.flatten(F.transform(s, lambda x, b: within(x, F.array_max(F.slice(tops, 1, b)))))))

    def within(step: Column, top: Column) -> Column:
        return F.transform(step, lambda x, i: F.greatest(top, F.array_max(F.slice(step, 1, i))))

    return let(values, lambda v: F.when(F.size(v) > 0, stepped(v)).otherwise(v))


def clear_of(loose: Column, base: Column) -> Column:
    """The spans of loose, with start and end, that overlap no span of base; one sort of both, not every pair."""

    def mark(spans: Column, own: int) -> Column:
        return F.transform(spans, lambda s, i: F.struct(s["start"].cast("long").alias("start"), F.lit(own).alias("own"), s["end"].cast("long").alias("end"), i.cast("int").alias("place")))

    def clear(m: Column) -> Column:
        """Places of loose spans that no base span before them reaches, and that reach no base span after them."""
        end = most_before(F.transform(m, lambda x: F.when(x["own"] == 0, x["end"])))
        start = F.reverse(most_before(F.reverse(F.transform(m, lambda x: F.when(x["own"] == 0, -x["start"])))))
        near = F.zip_with(end, start, lambda e, s: F.struct(e.alias("end"), (-s).alias("start")))
        met = lambda x, n: F.coalesce(n["end"] > x["start"], F.lit(False)) | F.coalesce(n["start"] < x["end"], F.lit(False))
        return F.array_sort(F.array_compact(F.zip_with(m, near, lambda x, n: F.when((x["own"] == 1) & ~met(x, n), x["place"]))))

    def left(x: Column) -> Column:
        places = let(F.array_sort(F.concat(mark(x["base"], 0), mark(x["loose"], 1))), clear)
        return F.transform(places, lambda i: F.get(x["loose"], i))

    return F.when((F.size(loose) > 0) & (F.size(base) > 0), let(F.struct(loose.alias("loose"), base.alias("base")), left)).otherwise(loose)


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with every span (start, end, kind), and what overlaps it, replaced by its label; a span that starts inside an earlier one adds none."""

    def ordered(s: Column) -> Column:
        return let(F.array_sort(F.transform(s, lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["kind"].alias("kind")))), placed)

    def placed(s: Column) -> Column:
        return let(most_before(F.transform(s, lambda x: x["end"])), lambda ends: pieces(F.zip_with(s, ends, lambda x, e: F.struct(F.coalesce(e, F.lit(0).cast("long")).alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))

    def pieces(s: Column) -> Column:
        tail = let(F.array_max(F.transform(s, lambda x: x["end"])), lambda e: F.substring(text, (e + 1).cast("int"), F.length(text)))
        return F.concat(cut_up(text, F.lit(0).cast("long"), s, STEP * STEP), tail)

    def cut_up(t: Column, at: Column, s: Column, size: int) -> Column:
        """The replaced text of spans, given the text from character `at` on: each step's part is cut out once, and smaller steps out of that."""
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int")), lambda b: F.slice(s, b * size + 1, size))
        return F.array_join(F.transform(steps, lambda step: step_of(t, at, step, size)), "")

    def step_of(t: Column, at: Column, step: Column, size: int) -> Column:
        first, last = step[0]["at"], F.array_max(F.transform(step, lambda x: F.greatest(x["at"], x["end"])))
        part = F.struct(first.alias("at"), F.substring(t, (first - at + 1).cast("int"), (last - first).cast("int")).alias("t"))
        return let(part, lambda p: cut_up(p["t"], p["at"], step, STEP) if size > STEP else F.array_join(F.transform(step, lambda x: one(p, x)), ""))

    def one(p: Column, x: Column) -> Column:
        gap = F.substring(p["t"], (x["at"] - p["at"] + 1).cast("int"), F.greatest(x["start"] - x["at"], F.lit(0)).cast("int"))
        return F.when(x["start"] >= x["at"], F.concat(gap, label(x["kind"]))).otherwise("")

    return F.when(F.size(spans) > 0, let(spans, ordered)).otherwise(text)

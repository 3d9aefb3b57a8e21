"""Secret scans by multipart credential linking.

A credential has parts: an identifier, a secret, an endpoint. Strong parts (BASE) are reported wherever they are. Weak
candidates (WEAK) are common in harmless text, so one is reported only if complementary parts stand in its scope,
within SCOPE characters: for a secret an identifier or an endpoint, for an identifier a secret, for an endpoint both an
identifier and a secret. Candidates that overlap a strong part are that part and are dropped.

All of it is native. The scan leaves only spans; the interval join deals them by (row, position / SCOPE) and gets, per
bin and role, just the first and last start, so a candidate meets nine rows at most however many parts a text holds.

Defined cases: a null text is empty; texts are scanned whole; repeated rows are scanned each; spans that tie for a start
go by kind as listed; rows without a key are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import clear_of, kinded, matches

SCOPE = 240
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?{VALUE}++"""
#: The base kinds, in the order that ranks them, with their roles.
BASE = (("assign", "secret"), ("access", "identifier"), ("hex", "secret"))
#: Weak candidates: kind, role, pattern (matches of key must mix digits and letters of both cases, those of short are filtered by the value's length).
WEAK = (
    ("id", "identifier", r"""(?i:client_?id|access_?key(?:_?id)?|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""),
    ("key", "secret", r"""(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"""),
    ("short", "secret", rf"""(?i:password|passwd|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?{VALUE}++"""),
    ("endpoint", "endpoint", r"""(?i:(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9_.:@-]{3,}+"""),
)
ROLES = ("identifier", "secret", "endpoint")


def value_length(s: Column) -> Column:
    """Characters after the separator of a name and value."""
    return F.length(F.regexp_extract(s["text"], rf"""[:=]\x20*["']?({VALUE}+)$""", 1))


def base_spans(text: Column) -> Column:
    """struct of the base kinds' spans."""
    assign = F.filter(matches(text, ASSIGN), lambda s: value_length(s) >= 12)
    access = matches(text, "AKIA[A-Z0-9]{14,}+")
    hexes = matches(text, "(?<![0-9a-f])[0-9a-f]{16,}+")
    return F.struct(assign.alias("assign"), access.alias("access"), hexes.alias("hex"))


def _loose(text: Column, kind: str, pattern: str) -> Column:
    """Matches of a weak kind; a short value has 4 to 11 characters, as longer ones are strong; a key mixes three kinds of characters."""
    found = matches(text, pattern)
    if kind == "short":
        return F.filter(found, lambda s: value_length(s).between(4, 11))
    if kind == "key":
        return F.filter(found, lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[a-z]") & s["text"].rlike("[A-Z]"))
    return found


def _candidates(spans: Column, kind: str, role: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(role).alias("role")))


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, base (array of kinded spans), weak (array of struct kind, role, start, end); no texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), base_spans(t).alias("b"), *[_loose(t, k, p).alias(f"w{i}") for i, (k, _, p) in enumerate(WEAK)])
    base = F.concat(*[kinded(F.col(f"b.{k}"), k, i) for i, (k, _) in enumerate(BASE)])
    flat = F.concat(*[_candidates(F.col(f"w{i}"), k, r, len(BASE) + i) for i, (k, r, _) in enumerate(WEAK)])
    return found.select("key", "row", base.alias("base"), flat.alias("weak")).select("key", "row", "base", clear_of(F.col("weak"), F.col("base")).alias("weak"))


def linked(rows: DataFrame) -> DataFrame:
    """row and the weak candidates that complementary parts confirm (array of kinded spans)."""
    role = F.create_map(*[F.lit(x) for pair in BASE for x in pair])
    strong = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.element_at(role, s["kind"]).alias("role")))
    some = rows.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    bin_ = F.floor(F.col("p.start") / SCOPE).alias("bin")
    parts = some.select("row", F.explode(F.concat(strong, F.col("weak"))).alias("p")).select("row", bin_, F.col("p.role").alias("role"), F.col("p.start").alias("start"))
    ends = parts.groupBy("row", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    seen = ends.select("row", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("role").alias("by"), "first", "last")
    weak = some.select("row", F.explode("weak").alias("p")).select("row", bin_, "p")
    near = weak.join(seen, ["row", "bin"]).filter((F.col("by") != F.col("p.role")) & (F.least(F.abs(F.col("first") - F.col("p.start")), F.abs(F.col("last") - F.col("p.start"))) <= SCOPE))
    has = near.groupBy("row", "p").agg(*[F.max(F.col("by") == r).alias(r) for r in ROLES])
    good = (
        ((F.col("p.role") == "identifier") & F.col("secret"))
        | ((F.col("p.role") == "secret") & (F.col("identifier") | F.col("endpoint")))
        | ((F.col("p.role") == "endpoint") & F.col("identifier") & F.col("secret"))
    )
    return has.filter(good).groupBy("row").agg(F.collect_list(F.struct("p.start", "p.rank", "p.end", "p.kind")).alias("added"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans of every row: arrays of struct start, rank, end, kind, by start, then kind as listed."""
    rows = written(scanned(docs, key, text), "secret-spans")
    out = rows.join(linked(rows), "row", "left")
    kinds = "array<struct<start:long,rank:int,end:long,kind:string>>"
    return out.select(F.col("key").alias(key), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(kinds)))).alias("spans"))

"""Text functions as column expressions: normalisation, tokens, keys, scores, predicates, parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width digits and letters, wide space and TAB with what they fold to.
WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
NARROW = "0123456789abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD_FROM, FOLD_TO = WIDE + UPPER + "　\t", NARROW + LOWER + "  "
#: Weights of the keyword score.
KEY_POWER, KEY_LENGTH, KEY_DOCUMENT, KEY_CAP, KEY_MOST, SPARSE_WEIGHT = 1.5, 8, 900.0, 3.0, 8, 0.06
#: Of the term score.
K1, B = 1.2, 0.75
#: Letters that count as Japanese for tokens, and as kanji or katakana for keys.
JAPANESE = "ぁ-ゟ゠-ヿ一-鿿"
KEY_LETTERS = "゠-ヿ一-鿿"
#: Phrases that ask for the whole shelf.
GLOBAL_SIGNALS = ("全体像", "全体の流れ", "全体を通し", "全部教え", "ぜんぶ教え", "すべて教え", "全て教え", "一覧", "まとめて", "どんなこと", "どんな種類", "概要", "何が書いて", "どういう構成")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def norm_search(s: Column | str) -> Column:
    """Folds full-width letters and digits, A-Z, wide spaces and TAB; nothing else."""
    return F.translate(_c(s), FOLD_FROM, FOLD_TO)


def compact(s: Column | str) -> Column:
    """norm_search without spaces."""
    return F.replace(norm_search(s), F.lit(" "), F.lit(""))


def match_text(*parts: Column | str) -> Column:
    """Compact text of summary, keywords, source and body side by side; nulls are empty."""
    return compact(F.concat(*[F.coalesce(_c(p), F.lit("")) for p in parts]))


def norm_hash(s: Column | str) -> Column:
    """CRLF to LF, runs of spaces and TABs to one space, spaces trimmed at the ends (line ends stay)."""
    return F.regexp_replace(F.regexp_replace(F.replace(_c(s), F.lit("\r\n"), F.lit("\n")), "[ \t]+", " "), r"^ +| +\z", "")


def tokens(s: Column | str) -> Column:
    """Runs of ASCII letters and digits, then bigrams over the Japanese letters put side by side."""
    none = F.array().cast("array<string>")

    def grams(ja: Column) -> Column:
        each = bound(F.split(ja, ""), lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.concat(x, F.get(c, i + 1))))
        return F.when(F.length(ja) > 1, each).otherwise(none)

    return bound(norm_search(s), lambda n: F.concat(F.regexp_extract_all(n, F.lit("[0-9a-z]+"), F.lit(0)), F.when(n.rlike(f"[{JAPANESE}]"), bound(F.regexp_replace(n, f"[^{JAPANESE}]", ""), grams)).otherwise(none)))


def distinct_keys(query: Column | str) -> Column:
    """Search keys of a question, eight at most: article labels, then tables and forms, then runs of one script, longest first."""
    s = compact(query)
    articles = F.regexp_extract_all(s, F.lit("第[0-9]+[条章項号]"), F.lit(0))
    forms = F.array_distinct(F.concat(F.regexp_extract_all(s, F.lit("別表第?[0-9]+"), F.lit(0)), F.regexp_extract_all(s, F.lit("様式第?[0-9]+"), F.lit(0))))
    runs = F.regexp_extract_all(s, F.lit(f"[0-9a-z]{{2,}}|[{KEY_LETTERS}]{{2,}}"), F.lit(0))
    placed = F.transform(F.array_sort(F.transform(runs, lambda r, i: F.struct((-F.length(r)).alias("n"), i.alias("i"), r.alias("r")))), lambda x: x["r"])
    fixed = F.concat(articles, forms)
    return F.slice(F.concat(fixed, F.array_except(F.array_distinct(placed), fixed)), 1, KEY_MOST)


def occurrences(text: Column, key: Column) -> Column:
    """Non-overlapping occurrences of a key."""
    return ((F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)).cast("long")


def key_weight(length: Column) -> Column:
    return F.pow(F.least(length, F.lit(KEY_LENGTH)).cast("double"), F.lit(KEY_POWER))


def cap_score(raw: Column, cap: float) -> Column:
    """At most cap; a cap of 0 or less is none."""
    return raw if cap <= 0 else F.least(raw, F.lit(float(cap)))


def key_score(keys: Column, text: Column, cap: float = KEY_CAP) -> Column:
    """Length-weighted keyword score of a compact text, damped by its length and capped."""

    def score(t: Column) -> Column:
        def add(total: Column, key: Column) -> Column:
            return total + bound(occurrences(t, key), lambda n: F.when((F.length(key) >= 2) & (n > 0), key_weight(F.length(key)) * (1 + F.log(n.cast("double")))).otherwise(F.lit(0.0)))

        return bound(F.aggregate(keys, F.lit(0.0), add), lambda raw: F.when(raw > 0, cap_score(raw / (1 + F.log(1 + F.length(t) / F.lit(KEY_DOCUMENT))), cap)).otherwise(F.lit(0.0)))

    return bound(text, score)


def key_score_of(keys: list[str], text: Column, cap: float = KEY_CAP) -> Column:
    """key_score for keys that are known when the query is written: one expression a key, which runs as generated code."""

    def score(t: Column) -> Column:
        raw = F.lit(0.0)
        for k in keys:
            if len(k) >= 2:
                n = occurrences(t, F.lit(k))
                raw = raw + F.when(F.contains(t, F.lit(k)), float(min(len(k), KEY_LENGTH)) ** KEY_POWER * (1 + F.log(n.cast("double")))).otherwise(F.lit(0.0))
        return F.when(raw > 0, cap_score(raw / (1 + F.log(1 + F.length(t) / F.lit(KEY_DOCUMENT))), cap)).otherwise(F.lit(0.0))

    return score(text)


def any_key(keys: Column, text: Column) -> Column:
    return F.exists(keys, lambda k: (F.length(k) >= 2) & F.contains(text, k))


def exact_hits(keys: Column, text: Column) -> Column:
    """Keys that occur in the normalised text, spaces kept."""
    return bound(norm_search(text), lambda n: F.size(F.filter(keys, lambda k: F.contains(n, k))).cast("long"))


def coverage(keys: Column, text: Column) -> Column:
    """Share of keys present; 0 without keys."""
    return F.when(F.size(keys) > 0, F.size(F.filter(keys, lambda k: F.contains(text, k))) / F.size(keys)).otherwise(F.lit(0.0))


def ref_labels(s: Column | str) -> Column:
    """Labels a text refers to: articles, then tables, then forms; distinct, 24 at most."""
    n = _c(s)
    found = [F.regexp_extract_all(n, F.lit(p), F.lit(0)) for p in ("第[0-9０-９]+[条項章]", "別表第?[0-9０-９]+", "様式第?[0-9０-９]+")]
    return F.slice(F.array_distinct(F.concat(*found)), 1, 24)


def line_class(line: Column | str) -> Column:
    """0 body, 1 chapter, 2 section, 3 item, 4 table; the first rule that fits decides."""
    s = _c(line)
    t = F.trim(s)
    return (
        F.when(F.contains(s, F.lit("\t")) | F.contains(t, F.lit("   ")) | F.contains(s, F.lit("|")), 4)
        .when(t.rlike("^# "), 1)
        .when(t.rlike("^【.*】") & (F.length(t) <= 60), 1)
        .when(t.rlike("^第[0-9０-９一二三四五六七八九十]+[編章]"), 1)
        .when(t.rlike("^##+ "), 2)
        .when(t.rlike("^第[0-9０-９一二三四五六七八九十]+[条節]"), 2)
        .when(t.rlike("^[0-9]+\\.") & (F.length(t) < 50), 2)
        .when(t.rlike("^[■●◆]") & (F.length(t) < 40) & ~F.contains(t, F.lit("。")), 2)
        .when(t.rlike("^第[0-9０-９一二三四五六七八九十]+項"), 3)
        .when(t.rlike("^(?:・|- |[(（][0-9０-９]|[①-⑳])"), 3)
        .otherwise(0)
    )


def page_number_line(line: Column | str) -> Column:
    return F.trim(_c(line)).rlike("^[-‐－ー]?[ ]*[0-9０-９]{1,4}[ ]*[-‐－ー]?$")


def toc_page(text: Column | str) -> Column:
    """Three filled lines or more, half of them with leader dots and a page number at the end."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: F.trim(x) != "")
    dotted = F.filter(lines, lambda x: x.rlike("(?:[.．・…‥]{2,}|[…‥])[ ]*[0-9０-９]+[ ]*$"))
    return (F.size(lines) >= 3) & (F.size(dotted) * 2 >= F.size(lines))


def replacement_ratio(s: Column | str) -> Column:
    """Replacement characters per character that is no white space, in the first 20,000."""
    h = F.substring(_c(s), 1, 20000)
    full = F.length(F.regexp_replace(h, "[ \t\r\n　]", ""))
    return F.when(full > 0, F.regexp_count(h, F.lit("�")) / full).otherwise(F.lit(0.0))


def garble_ratio(s: Column | str) -> Column:
    """Control, Greek, Cyrillic, private and replacement characters per character that is no white space."""
    full = F.length(F.regexp_replace(_c(s), "[ \t\r\n　]", ""))
    bad = F.regexp_count(_c(s), F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1fͰ-ϿЀ-ԯ-�]"))
    return F.when(full > 0, bad / full).otherwise(F.lit(0.0))


def strip_controls(s: Column | str) -> Column:
    """Control characters as one space each, then runs of spaces as one; a text without any is left alone."""
    controls = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
    return F.when(_c(s).rlike(controls), F.regexp_replace(F.regexp_replace(_c(s), controls, " "), " {2,}", " ")).otherwise(_c(s))


def csv_safe(s: Column | str) -> Column:
    """A CSV field: formula starters get a quote before them, fields with separators are quoted."""
    t = F.when(F.substring(_c(s), 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), _c(s))).otherwise(_c(s))
    return F.when(t.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def question_key(s: Column | str, most: int | None = 40) -> Column:
    """Lower-cased question without spaces and punctuation, cut at `most` characters."""
    t = F.regexp_replace(_c(s), "[ 　\t\r\n、。，．,.?？!！「」・]", "")
    return F.lower(t if most is None else F.substring(t, 1, most))


def pii_kind(s: Column | str) -> Column:
    """'email', 'number' (ten digits, hyphens and spaces between allowed) or null, after folding widths."""
    t = F.translate(_c(s), WIDE + "＠．－　", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz@.- ")
    mail = t.rlike("[A-Za-z0-9.]@[A-Za-z0-9.]") & F.regexp_extract(t, "(?s)@(.*)$", 1).contains(".")
    return F.when(mail, "email").when(t.rlike("(?:[0-9][- ‐]*){10}"), "number")


def strip_dates(s: Column | str) -> Column:
    """Without tokens that look like dates or times."""
    return F.regexp_replace(_c(s), "[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?", "")


def chunk_key(chunk_id: Column | str) -> Column:
    """struct doc, page, seq of an id doc::pN::cM; null where it is none."""
    r = r"^(.+)::p([0-9]+)::c([0-9]+)$"
    part = lambda i: F.regexp_extract(_c(chunk_id), r, i)
    return F.when(_c(chunk_id).rlike(r), F.struct(part(1).alias("doc"), part(2).cast("int").alias("page"), part(3).cast("int").alias("seq")))


def chapter_key(path: Column | str) -> Column:
    """First segment of a section path, without the dots and page number of a contents entry."""
    return F.trim(F.regexp_replace(F.split(_c(path), ">")[0], "[.．・…‥]{2,}[ ]*[0-9０-９]*[ ]*$", ""))


def team_code(user_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(user_id), "_([0-9A-Z]{4,6})$", 1), F.lit(""))


def department(user_id: Column | str) -> Column:
    return F.substring(team_code(user_id), 1, 3)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), r"[\\/]"), -1)


def tag_body(response: Column | str, tag: str) -> Column:
    """What stands between <tag> and </tag>; empty without it."""
    return F.regexp_extract(_c(response), f"(?s)<{tag}>(.*?)</{tag}>", 1)


def listed(s: Column | str, separator: str, most: int | None = None) -> Column:
    """Trimmed non-empty parts, the first `most`."""
    parts = F.filter(F.transform(F.split(_c(s), separator), lambda x: F.trim(x)), lambda x: x != "")
    return parts if most is None else F.slice(parts, 1, most)


def mode(s: Column | str) -> Column:
    t = F.lower(F.trim(_c(s)))
    return F.when(t.isin("thorough", "deep"), t).otherwise("quick")


def human_bytes(n: Column | str) -> Column:
    """B without decimals, KB to TB with one; less than nothing is 0."""
    n = F.greatest(_c(n).cast("double"), F.lit(0.0))
    step = lambda p, unit: F.concat(F.format_string("%.1f", n / 1024**p), F.lit(unit))
    whole = F.concat(F.bround(n, 0).cast("long").cast("string"), F.lit(" B"))
    return F.when(n < 1024, whole).when(n < 1024**2, step(1, " KB")).when(n < 1024**3, step(2, " MB")).when(n < 1024**4, step(3, " GB")).otherwise(step(4, " TB"))


def human_seconds(n: Column | str) -> Column:
    """約N秒, 約N分 or 約N分N秒."""
    s = F.greatest(F.bround(_c(n).cast("double"), 0).cast("long"), F.lit(0).cast("long"))
    minutes, rest = F.floor(s / 60).cast("string"), s % 60
    return F.when(s < 60, F.concat(F.lit("約"), s.cast("string"), F.lit("秒"))).when(rest == 0, F.concat(F.lit("約"), minutes, F.lit("分"))).otherwise(F.concat(F.lit("約"), minutes, F.lit("分"), rest.cast("string"), F.lit("秒")))


def eta(left: Column, ms: Column) -> Column:
    """How long the items left will take at so many milliseconds each: empty while unknown, else in minutes or hours."""
    sec = left * ms / 1000.0
    minutes = F.greatest(F.floor(sec / 60 + 0.5), F.lit(1))
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    text = F.when(sec < 60, "まもなく完了").when(minutes < 60, F.concat(F.lit("残り約"), minutes.cast("string"), F.lit("分"))).when(rest == 0, F.concat(F.lit("残り約"), hours, F.lit("時間"))).otherwise(F.concat(F.lit("残り約"), hours, F.lit("時間"), rest.cast("string"), F.lit("分")))
    return F.when((left <= 0) | (ms <= 0), "").otherwise(text)


def extension(path: Column | str) -> Column:
    """What follows the last dot of a file's name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def date_keys(ts: Column | str) -> Column:
    """struct of the date's forms: iso, iso with time, compact, year and month, year."""
    form = lambda f, name: F.date_format(_c(ts), f).alias(name)
    return F.struct(form("yyyy-MM-dd", "iso"), form("yyyy-MM-dd HH:mm:ss", "stamp"), form("yyyyMMdd", "compact"), form("yyyyMM", "month"), form("yyyy", "year"))


def json_escaped(s: Column | str) -> Column:
    """A text as the inside of a JSON string: backslashes, quotes, line breaks and TABs by letter, other control characters by number."""
    out = F.replace(F.replace(_c(s), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(c), F.lit("\\" + letter))
    plain = out
    for c in (*range(9), 11, 12, *range(14, 32)):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04X}"))
    return F.when(plain.rlike("[\\x00-\\x1f]"), out).otherwise(plain)


def merged_labels(held: Column, added: Column) -> Column:
    """Labels parted by |, with those of another list that are not among them."""
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|", -1), lambda x: x != "")
    new = F.array_distinct(F.array_except(parts(added), parts(held)))
    return F.when(F.size(new) == 0, F.coalesce(held, F.lit(""))).otherwise(F.array_join(F.concat(F.when(F.coalesce(held, F.lit("")) != "", F.array(held)).otherwise(F.array().cast("array<string>")), new), "|"))


def origin_kind(origin: Column | str) -> Column:
    t = F.lower(F.ltrim(_c(origin)))
    return F.when(t.startswith("pack:"), "pack").when(t.startswith("channel:"), "channel").otherwise("")


def compound_signal(q: Column | str) -> Column:
    """Two question marks or more, or two filled sentences or more."""
    sentences = F.filter(F.split(_c(q), "[。.!！?？\n]"), lambda x: F.trim(x) != "")
    return (F.regexp_count(_c(q), F.lit("[?？]")) >= 2) | (F.size(sentences) >= 2)


def global_signal(q: Column | str) -> Column:
    out = F.lit(False)
    for w in GLOBAL_SIGNALS:
        out = out | F.contains(_c(q), F.lit(w))
    return out


def main_keyword(q: Column | str) -> Column:
    """The longest run of word characters of two or more, the first of equals."""
    runs = F.regexp_extract_all(norm_search(q), F.lit(f"[0-9a-z{JAPANESE}]{{2,}}"), F.lit(0))
    ordered = F.array_sort(F.transform(runs, lambda r, i: F.struct((-F.length(r)).alias("n"), i.alias("i"), r.alias("r"))))
    return F.try_element_at(F.transform(ordered, lambda x: x["r"]), F.lit(1))


def iso_date(s: Column | str) -> Column:
    """Year-first dates as yyyy-mm-dd; anything else unchanged."""
    m = F.regexp_extract(_c(s), "^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})", 0)
    part = lambda i: F.lpad(F.regexp_extract(_c(s), "^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})", i), 2 if i > 1 else 4, "0")
    return F.when(m != "", F.concat_ws("-", part(1), part(2), part(3))).otherwise(_c(s))


def cite_tags(s: Column | str) -> Column:
    """Bracketed citations of shelf or pack sources."""
    return F.regexp_extract_all(_c(s), F.lit(r"\[(?:shelf|pack|本棚|パック)[^\]]*\]"), F.lit(0))


#: Units that make a number a claim, longer ones first; digits that make a bare one; how many are told.
UNITS = "ヶ月|か月|カ月|箇月|万円|億円|千円|パーセント|％|%|割|円|日|年|歳|件|名|回|倍|点|口"
BARE, TOLD = 3, 4
OWN_TAGS = (r"\[本棚:[^\]]*\]", r"[\[][A-Za-z]{1,3}[0-9]{1,7}(?: 付近)?\]|[(][A-Za-z]{1,3}[0-9]{1,7}(?: 付近)?[)]", r"\(コード[:：][^)]*\)")
CLAIM = f"第[0-9]+[条項章号]|(?:別表|様式)第?[0-9]+|[0-9]+(?:[,.][0-9]+)*(?:{UNITS})?"
LIST_HEAD = f"(?<![^\\r\\n])([ (（]*)[0-9](?:{'|'.join(u for u in UNITS.split('|') if len(u) == 1)})(?=[.．)）、，])"


def ungrounded(answer: Column, evidence: Column, most: int = TOLD) -> Column:
    """Claims of an answer that the evidence lacks, the first `most`: labels of articles, tables and forms, and numbers with a unit, with commas, or of three digits or more. The answer's own tags and the numbers of lists are no claims; a claim is grounded if the evidence holds it, or its digits where these are two or more. None without evidence."""

    def missing(body: Column) -> Column:
        own = answer
        for tag in OWN_TAGS:
            own = F.regexp_replace(own, tag, " ")
        claims = F.regexp_extract_all(F.regexp_replace(norm_search(own), LIST_HEAD, "$1 "), F.lit(CLAIM), F.lit(0))
        meant = F.filter(claims, lambda c: c.rlike("[^0-9.]") | (F.length(F.regexp_replace(c, "[^0-9]", "")) >= BARE))
        digits = lambda c: F.regexp_replace(c, "[^0-9,.]", "")
        lacking = F.filter(F.array_distinct(meant), lambda c: ~(F.contains(body, c) | ((F.length(digits(c)) >= 2) & F.contains(body, digits(c)))))
        return F.when(F.length(body) > 0, F.slice(lacking, 1, most)).otherwise(F.array().cast("array<string>"))

    return bound(norm_search(F.coalesce(evidence, F.lit(""))), missing)

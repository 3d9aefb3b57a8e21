"""Queries over single rows: decisions, parsers, formats, and Japanese fixtures whose results are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import decide as D
from tessel.functions import python as P
from tessel.functions import text as T
from tessel.operators import answer, queue
from tessel.plans.base import query, table
from tessel.sources import files

def events_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def pick(*values: Column | str | int | None) -> Column:
    """The value whose place is event_id modulo their number."""
    i = F.col("event_id")
    out = F.lit(values[-1]) if not isinstance(values[-1], Column) else values[-1]
    for k, v in enumerate(values[:-1]):
        out = F.when(i % len(values) == k, v).otherwise(out)
    return out


@query(
    """SELECT event_id, event_id % 4 = 0 AS memo, event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS gap, event_id % 11 <> 0 AND date_trunc('second', ts) > TIMESTAMP '2024-01-15 12:00:00' AS newer,
    event_id % 3 <> 1 AND event_id % 6 <> 0 AND ts::DATE < DATE '2024-01-10' AS aged, CASE WHEN event_id % 6 = 0 THEN false WHEN event_id % 11 = 0 THEN true ELSE date_trunc('second', ts) < TIMESTAMP '2024-01-15 11:30:00' END AS expired,
    event_id % 30 + 7 AS keep_days, event_id % 5 <= 2 AS same, ((event_id * 7) % 86400 - event_id % 86400 + 86400) % 86400 * 1000 AS elapsed FROM events"""
)
def rules_of_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp")
    kind, stamp = pick("gap", "qa", "correction"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    created = F.when(i % 6 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    saved = F.when(i % 6 == 0, "").when(i % 11 == 0, "no time").otherwise(stamp)
    return events_(spark, sf_dir).select(
        "event_id",
        D.memo_source(F.concat(F.when(i % 4 == 0, "訂正メモ: ").otherwise("doc"), i.cast("string"))).alias("memo"),
        D.gap_row(kind, F.when(i % 7 == 0, "correction").when(i % 7 == 1, None).otherwise("low"), i % 5 == 0).alias("gap"),
        D.within_window(F.when(i % 11 == 0, "no time").otherwise(stamp), F.lit("2024-01-15 12:00:00")).alias("newer"),
        D.gap_aged(kind, created, F.lit("2024-01-10")).alias("aged"),
        D.pending_expired(saved, noon).alias("expired"),
        D.nonce_keep_days(i % 30).alias("keep_days"),
        D.same_time(noon, noon + F.make_interval(secs=i % 5)).alias("same"),
        D.elapsed_ms((i % 86400).cast("double"), ((i * 7) % 86400).cast("double")).alias("elapsed"),
    )


@query(
    """WITH m AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'thorough' WHEN 1 THEN 'deep' ELSE 'quick' END AS mode FROM events)
    SELECT event_id, mode, CASE mode WHEN 'thorough' THEN 16 WHEN 'deep' THEN 12 ELSE 6 END AS k, CASE mode WHEN 'thorough' THEN 6 ELSE 3 END AS queries, mode <> 'quick' AS expand, mode = 'thorough' AS verify,
    greatest((event_id % 40) // greatest(event_id % 5, 1), 6) AS part_k, event_id % 9 = 0 OR event_id % 10 < 3 AS low, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 5 <> 0 THEN 'cannot' ELSE 'needs' END AS class,
    event_id % 4 > 0 AND event_id % 3 < event_id % 4 AS shrunk, CASE WHEN event_id % 2 = 0 THEN event_id % 3 = 0 ELSE event_id % 5 = 0 END AS may_view,
    event_id % 5 <> 0 AND (event_id % 2 = 0 OR event_id % 3 = 0 AND event_id % 10000 >= 5000) AS prefilter, greatest(1, least(60, event_id % 400 // 3))::INTEGER AS chapters,
    CASE WHEN event_id % 7 * 8 + 1 <= event_id % 50 THEN (event_id % 7 * 8 + 1) || '-' || least(event_id % 7 * 8 + 8, event_id % 50) END AS batch,
    event_id % 4 IN (0, 1) AS volatile, CASE WHEN event_id % 2 = 0 AND event_id % 3 < 2 THEN 'shift_jis' ELSE 'utf-8' END AS charset FROM m"""
)
def rules_of_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    mode = T.mode(pick(" Thorough", "DEEP", "quick", "other"))
    batch = D.batch_bounds(i % 50, F.lit(8), i % 7)
    path = pick("C:\\Users\\a\\Temp1_x.zip\\b", "D:\\TEMP\\own", "D:\\temp2\\own", "D:\\work\\temp")
    e = events_(spark, sf_dir).withColumn("mode", mode).withColumn("plan", answer.plan(F.col("mode"))).withColumn("b", batch)
    return e.select(
        "event_id",
        "mode",
        "plan.k",
        "plan.queries",
        "plan.expand",
        "plan.verify",
        D.per_part_top_k(i % 40, i % 5).alias("part_k"),
        D.low_hit(F.when(i % 9 != 0, (i % 10) / 10.0)).alias("low"),
        D.document_class(i % 2 == 0, i % 3 == 0, i % 5 == 0).alias("class"),
        D.shrunk(i % 4, i % 3).alias("shrunk"),
        D.can_view(i % 2 == 0, i % 3 == 0, i % 5 == 0).alias("may_view"),
        D.prefilter(i % 10000, 5000, i % 2 == 0, i % 3 == 0, i % 5 == 0).alias("prefilter"),
        D.estimated_chapters(i % 400).alias("chapters"),
        F.when(F.col("b").isNotNull(), F.concat_ws("-", F.col("b.first").cast("string"), F.col("b.last").cast("string"))).alias("batch"),
        D.volatile_path(path, "D:\\temp").alias("volatile"),
        D.encoding_pick(F.lit(0.2), i % 2 == 0, (i % 3) / 10.0).alias("charset"),
    )


@query(
    """WITH r AS (SELECT event_id, event_id % 45 - 2 AS days, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 30 END AS lim, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN (event_id % 45 - 2)::VARCHAR ELSE '1' END AS warned, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END AS wiped, event_id % 13 = 0 AS unknown, event_id % 11 = 0 AS reach FROM events)
    SELECT event_id, CASE WHEN lim <= 0 THEN 'off' WHEN unknown THEN 'never' WHEN reach OR days <= 0 THEN 'none' WHEN days < lim THEN CASE WHEN days >= greatest(lim - 7, 1) AND warned <> days::VARCHAR THEN 'warn' ELSE 'none' END
    WHEN warned = '' THEN 'warn_first' WHEN wiped <> '' THEN 'none' ELSE 'wipe' END AS action FROM r"""
)
def expiry_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    days = i % 45 - 2
    warned, wiped = pick("", days.cast("string"), "1"), F.when(i % 7 == 0, "x").otherwise("")
    return events_(spark, sf_dir).select("event_id", D.expiry(F.when(i % 13 == 0, "").otherwise("2024-01-01"), days, pick(0, 5, 30, 30), warned, wiped, i % 11 == 0).alias("action"))


@query(
    r"""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'doc' || event_id || '/' || (event_id % 9) || '/' || (event_id % 5) END AS chunk, CASE WHEN event_id % 2 = 0 THEN 'Part ' || (event_id % 7) ELSE 'Intro' END AS chapter,
    CASE WHEN event_id % 3 <> 0 THEN (1000 + event_id % 9000)::VARCHAR END AS team, CASE WHEN event_id % 3 <> 0 THEN substring((1000 + event_id % 9000)::VARCHAR, 1, 3) END AS dept,
    CASE WHEN event_id % 2 = 0 THEN 'b_' || event_id || '.TXT' ELSE 'plain' || event_id END AS name, CASE WHEN event_id % 2 = 0 THEN 'txt' ELSE '' END AS ext, event_id || ',2' AS tag, 'a,b' || event_id || ',c' AS parts,
    '【doc > 第1章' || CASE WHEN event_id % 2 = 0 THEN ' > 第2条' ELSE '' END || '】' AS crumb, '第1章' || CASE WHEN event_id % 2 = 0 THEN '>第2条' ELSE '' END AS path,
    '第' || (event_id % 20) || '条,別表' || (event_id % 3) || ',様式第' || (event_id % 4) AS refs, [event_id % 5 + 1, 2, 7].list_distinct().list_sort().list_aggregate('string_agg', ',') AS choice FROM events"""
)
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    chunk = T.chunk_key(F.when(i % 3 == 0, text("bad", i)).otherwise(text("doc", i, "::p", i % 9, "::c", i % 5)))
    user = F.when(i % 3 == 0, text("u_ab", i % 9)).otherwise(text("u_", 1000 + i % 9000))
    path = F.when(i % 2 == 0, text("C:\\dir/sub\\b_", i, ".TXT")).otherwise(text("/x.y/plain", i))
    crumb = D.breadcrumb(F.lit("doc"), F.lit("第1章"), F.when(i % 2 == 0, "第2条"))
    refs = T.ref_labels(text("第", i % 20, "条と別表", i % 3, "、様式第", i % 4, "と第", i % 20, "条"))
    e = events_(spark, sf_dir).withColumn("c", chunk)
    return e.select(
        "event_id",
        F.when(F.col("c").isNotNull(), F.concat_ws("/", "c.doc", F.col("c.page").cast("string"), F.col("c.seq").cast("string"))).alias("chunk"),
        T.chapter_key(F.when(i % 2 == 0, text("Part ", i % 7, "....", i % 30, ">x")).otherwise("Intro>y")).alias("chapter"),
        T.team_code(user).alias("team"),
        T.department(user).alias("dept"),
        T.file_name(path).alias("name"),
        T.extension(path).alias("ext"),
        T.tag_body(text("x<rank>", i, ",2</rank>y"), "rank").alias("tag"),
        F.array_join(T.listed(text("a| b", i, " ||c|d"), r"\|", 3), ",").alias("parts"),
        crumb.alias("crumb"),
        D.section_path(F.concat(crumb, F.lit("\nbody"))).alias("path"),
        F.array_join(refs, ",").alias("refs"),
        F.array_join(F.array_sort(D.choice_numbers(text("②、", i % 5 + 1, " ７,99"), 9)), ",").alias("choice"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 3000 < 2 THEN (event_id % 3000 * 512) || ' B' WHEN event_id % 3000 < 2048 THEN format('{:.1f} KB', round(event_id % 3000 / 2.0::DOUBLE, 1)) ELSE format('{:.1f} MB', floor(event_id % 3000 / 2048.0::DOUBLE * 10 + 0.5) / 10) END AS bytes,
    CASE WHEN s < 60 THEN '約' || s || '秒' WHEN s % 60 = 0 THEN '約' || (s // 60) || '分' ELSE '約' || (s // 60) || '分' || (s % 60) || '秒' END AS seconds,
    CASE WHEN n = 0 OR ms = 0 THEN '' WHEN n * ms / 1000.0 < 60 THEN 'まもなく完了' WHEN mins < 60 THEN '残り約' || mins || '分' WHEN mins % 60 = 0 THEN '残り約' || (mins // 60) || '時間' ELSE '残り約' || (mins // 60) || '時間' || (mins % 60) || '分' END AS eta,
    CASE event_id % 3 WHEN 0 THEN '2024-03-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') WHEN 1 THEN 'x' || event_id ELSE '2024-12-01' END AS date,
    strftime(ts, '%Y-%m-%d/%Y-%m-%d %H:%M:%S/%Y%m%d/%Y%m/%Y') AS keys, CASE event_id % 5 WHEN 0 THEN 'parent' WHEN 1 THEN 'start' WHEN 2 THEN 'end' ELSE '' END AS reason,
    CASE event_id % 3 WHEN 0 THEN '''=1' WHEN 1 THEN '''@x' ELSE 'a=1' END AS cell, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '😀' WHEN 3 THEN '😀a' WHEN 4 THEN '😀a' WHEN 5 THEN '😀a😀' ELSE '😀a😀b' END AS head
    FROM (SELECT *, event_id % 400 AS s, event_id % 900 AS n, event_id % 3 * 2500 AS ms, greatest(floor((event_id % 900) * (event_id % 3 * 2500) / 1000.0::DOUBLE / 60 + 0.5), 1)::BIGINT AS mins FROM events)"""
)
def written_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    dates = pick(F.concat(F.lit("2024/3/"), (i % 28 + 1).cast("string")), F.concat(F.lit("x"), i.cast("string")), "2024.12.01 10:00")
    heads = pick(*[D.safe_left(F.lit("😀a😀b"), n) for n in range(7)])
    names = pick("a..b", "　a", "a.", "plain", "")
    return events_(spark, sf_dir).withColumn("k", T.date_keys("ts")).select(
        "event_id",
        T.human_bytes(i % 3000 * 512).alias("bytes"),
        T.human_seconds(i % 400).alias("seconds"),
        T.eta(i % 900, i % 3 * 2500).alias("eta"),
        T.iso_date(dates).alias("date"),
        F.concat_ws("/", "k.iso", "k.stamp", "k.compact", "k.month", "k.year").alias("keys"),
        D.path_escapes(names).alias("reason"),
        D.cell_safe(pick("=1", "@x", "a=1")).alias("cell"),
        heads.alias("head"),
    )


@query(
    r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(1), '\u0001')) AS escaped, len(list_filter(string_split(text, ' '), lambda x: trim(x, ' ') <> '')) AS words
    FROM (SELECT doc_id, text, text || chr(9) || '"\' || chr(1) AS t FROM documents)"""
)
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat("text", F.lit('\t"\\\x01'))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.json_escaped(odd)).alias("escaped"), F.size(T.listed("text", " ")).cast("long").alias("words"))


#: Japanese fixtures: a text, and by hand its lines joined, class, whether it is a page number, tokens, search keys, longest run, compact form, question key, what ingest leaves after a line x, whether it asks for the whole.
JAPANESE = [
    ("第 １ ２ 条 目的", "第12条 目的", 2, False, "1|2|第条|条目|目的", "第12条|条目的|12", "目的", "第12条目的", "第１２条目的", "x\n第12条 目的", False),
    ("第３ 章 と 第　４　項", "第3章 と 第4項", 1, False, "3|4|第章|章と|と第|第項", "第3章|第4項", "第3", "第3章と第4項", "第３章と第４項", "x\n第3章 と 第4項", False),
    ("Ａ１ 保険 ﾌｫｰﾑ", "Ａ１ 保険 ﾌｫｰﾑ", 0, False, "a1|保険", "a1|保険", "a1", "a1保険ﾌｫｰﾑ", "ａ１保険ﾌｫｰﾑ", "x\nＡ１ 保険 ﾌｫｰﾑ", False),
    ("- １９ -", "- １９ -", 3, True, "19", "19", "19", "-19-", "-１９-", "x", False),
    ("第 x 回 交通費", "第 x 回 交通費", 0, False, "x|第回|回交|交通|通費", "回交通費", "交通費", "第x回交通費", "第x回交通費", "x\n第 x 回 交通費", False),
    ("別表第1と様式2の一覧", "別表第1と様式2の一覧", 0, False, "1|2|別表|表第|第と|と様|様式|式の|の一|一覧", "別表第1|様式2|別表第|様式|一覧", "別表第1と様式2の一覧", "別表第1と様式2の一覧", "別表第1と様式2の一覧", "x\n別表第1と様式2の一覧", True),
]


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_documents(values: str) -> str:
    """SQL of documents, each with one of the given rows (i from 0)."""
    return f"j AS (SELECT * FROM (VALUES {values}) t), d AS (SELECT doc_id, text, j.* FROM documents JOIN j ON doc_id % {len(JAPANESE)} = j.i)"


def japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a Japanese line each."""
    lines = F.array(*[F.lit(r[0]) for r in JAPANESE])
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.get(lines, F.col("doc_id") % len(JAPANESE)).alias("line"))


@query(
    "WITH "
    + in_documents(", ".join(f"({i}, {sql_text(a)}, {sql_text(b)}, {str(p).lower()}, {c})" for i, (a, b, c, p, *_) in enumerate(JAPANESE))).replace(") t)", ") t(i, line, joined, page_line, class))")
    + " SELECT doc_id, joined, page_line, class, md5(text || chr(10) || joined) AS whole FROM d"
)
def japanese_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = japanese(spark, sf_dir)
    joined = D.joined_numbers(F.col("line"))
    return rows.select("doc_id", joined.alias("joined"), T.page_number_line("line").alias("page_line"), T.line_class(joined).alias("class"), F.md5(F.concat("text", F.lit("\n"), joined)).alias("whole"))


LATIN = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz ')"


@query(
    "WITH "
    + in_documents(", ".join(f"({i}, " + ", ".join(sql_text(x) for x in (r[0], *r[4:10])) + f", {str(r[10]).lower()})" for i, r in enumerate(JAPANESE))).replace(") t)", ") t(i, line, tokens, keys, main, compact, question, ingested, global))")
    + f""" SELECT doc_id, keys, main, question, ingested, global, md5(replace({LATIN}, ' ', '') || chr(10) || compact) AS compact,
    md5(array_to_string(list_concat(list_concat(regexp_extract_all({LATIN}, '[0-9a-z]+'), list_filter(string_split(tokens, '|'), lambda x: regexp_matches(x, '^[0-9a-z]+$'))), list_filter(string_split(tokens, '|'), lambda x: NOT regexp_matches(x, '^[0-9a-z]+$') AND x <> '')), '|')) AS tokens FROM d"""
)
def japanese_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = japanese(spark, sf_dir)
    both = F.concat("text", F.lit("\n"), "line")
    return rows.select(
        "doc_id",
        F.array_join(T.distinct_keys("line"), "|").alias("keys"),
        T.main_keyword("line").alias("main"),
        T.question_key("line").alias("question"),
        D.ingest_text(F.concat(F.lit("x\n"), "line")).alias("ingested"),
        T.global_signal("line").alias("global"),
        F.md5(T.compact(both)).alias("compact"),
        F.md5(F.array_join(T.tokens(both), "|")).alias("tokens"),
    )


#: The golden values of the hash that names chunks: text and hash.
HASHES = [("", "cbf29ce484222325"), ("hello", "32964f71b2764b97"), ("第12条", "5b02a1a0f87d2243")]


FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, flatten(list_transform(string_split({s}, ''), lambda c: [(unicode(c) % 256)::HUGEINT, (unicode(c) // 256)::HUGEINT]))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
HEX = "printf('%08x', ({h} // 4294967296)::BIGINT) || printf('%08x', ({h} % 4294967296)::BIGINT)"


@query(
    f"""WITH n AS (SELECT doc_id, '第' || source || '条-' || lang || doc_id AS s FROM documents), h AS (SELECT doc_id, {FNV.format(s="s")} AS h FROM n), x AS (SELECT doc_id, {HEX.format(h="h")} AS hash FROM h)
    SELECT doc_id, hash, upper(hash) AS upper, CASE WHEN doc_id % 3 = 0 THEN '' ELSE hash END AS anonymous FROM x"""
)
def hashed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("第"), "source", F.lit("条-"), "lang", i.cast("string")).alias("s"))
    return rows.select("doc_id", P.fnv1a64(F.col("s")).alias("hash"), P.fnv1a64(F.col("s"), True).alias("upper"), D.anonymous(F.when(i % 3 == 0, "").otherwise(F.col("s"))).alias("anonymous"))


@query("SELECT doc_id, md5(text) AS text FROM documents")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 3
    plain = F.encode("text", "UTF-8")
    content = F.when(i == 0, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(i == 1, F.encode("text", "UTF-16")).otherwise(plain)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(files.decoded(content)).alias("text"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'encrypted' ELSE 'unknown' END AS kind,
    CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '[A' || event_id || ']' || event_type ELSE '[A' || event_id || ']' || event_type || chr(9) || chr(9) || '[C' || event_id || ']x' END AS line FROM events"""
)
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    head = F.unhex(pick("504B0304", "D0CF11E0A1B11AE1", "25504446"))
    cells = F.when(i % 4 == 0, F.array(F.lit(""), F.lit(None).cast("string"))).when(i % 4 == 1, F.array("event_type", F.lit(""))).otherwise(F.array("event_type", F.lit(""), F.lit("x"), F.lit("")))
    return events_(spark, sf_dir).select("event_id", files.encrypted(head).alias("kind"), files.sheet_row(cells, i).alias("line"))


@query(
    """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'u' || user_id || '/' || (event_id % 9) || '/' || CASE WHEN event_id % 2 = 0 THEN 'T' || (event_id % 4) ELSE '' END || '/stamp' END AS beacon,
    CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'broken' WHEN 2 THEN 'broken' ELSE 'old' END AS status, CASE WHEN event_id % 12 < 3 THEN NULL WHEN event_id % 12 < 7 THEN 4 ELSE 9 END AS page FROM events"""
)
def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    full = F.concat_ws("\t", D.beacon(user, i % 9, F.lit("d"), F.lit(1), F.lit("m"), F.lit(2), F.lit("y"), F.lit(3), F.concat(F.lit("T"), (i % 4).cast("string"))), F.lit("stamp"))
    legacy = F.concat_ws("\t", user, (i % 9).cast("string"), F.lit("d"), F.lit("1"), F.lit("m"), F.lit("2"), F.lit("y"), F.lit("3"), F.lit("stamp"))
    line = F.when(i % 6 == 0, F.when(i % 12 == 0, "too\tshort").otherwise(F.regexp_replace(full, "^[^\t]*", ""))).when(i % 2 == 0, full).otherwise(legacy)
    body = pick("head\nrow\nrow\n#end 2", "head\nrow", "head\nrow\n#end 2", "head\nrow\nrow\n#end 2")
    made = pick("2024-01-20", "2024-01-20", "2024-01-20", "2024-01-01")
    b = D.beacon_fields(line)
    return events_(spark, sf_dir).withColumn("b", b).select(
        "event_id",
        F.when(F.col("b").isNotNull(), F.concat_ws("/", "b.user", F.col("b.thanks").cast("string"), "b.team", "b.stamp")).alias("beacon"),
        D.board_status(body, F.lit(1) + F.when(i % 4 != 2, 1).otherwise(0), made, F.lit("2024-01-10")).alias("status"),
        D.page_at(F.array(F.lit(3), F.lit(7)).cast("array<long>"), F.array(F.lit(4), F.lit(9)), i % 12).alias("page"),
    )


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 50 WHEN 1 THEN 7 ELSE 3 END AS number, CASE event_id % 4 WHEN 2 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS ratio, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS switch,
    CASE WHEN event_id % 5 = 0 THEN 'default' ELSE event_type END AS word, event_id % 7 = 0 OR event_id % 6 = 0 OR event_id % 3 = 1 OR event_id % 5 = 0 AS stale FROM events"""
)
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    number = pick(F.concat((i % 50).cast("string"), F.lit(".2")), "99999999999", " 2.6 ", "3")
    return events_(spark, sf_dir).select(
        "event_id",
        queue.setting(number, 7).alias("number"),
        queue.setting(pick("1.5", None, "0.5", "none"), 1.5).alias("ratio"),
        queue.setting(pick("Yes", "0", "?"), True).alias("switch"),
        queue.setting(F.when(i % 5 != 0, F.col("event_type")).otherwise(""), "default").alias("word"),
        queue.stale(i % 7 != 0, F.lit("3|a|b"), (i % 3).cast("int"), F.when(i % 6 == 0, "").when(i % 5 == 0, "4|a|b").otherwise("3|a|b"), F.when(i % 3 == 1, 9).otherwise(i % 3).cast("int")).alias("stale"),
    )


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' [shelf a]' ELSE text || ' [pack b]（未確認）' END AS answer, 12 AS figure FROM conversations")
def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    cited = F.concat("text", F.when(F.col("turn") % 3 == 0, " [shelf a]").otherwise(" [pack b]"))
    return c.select("conv_id", "turn", D.unverified(cited, F.array(F.lit("[shelfa]"))).alias("answer"), F.lit(12).alias("figure"))


@query(
    """SELECT event_id, 'Which?' || chr(10) || CASE WHEN event_id % 2 = 0 THEN '  1. s' || (event_id % 20) || chr(10) || '  2. t' || chr(10) || '  0. -' || chr(10) ELSE '' END || '  ① how' || chr(10) || '  ② when' AS prompt FROM events"""
)
def clarifying_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    sources = F.when(i % 2 == 0, F.concat(F.lit("s"), (i % 20).cast("string"), F.lit("|t"))).otherwise("")
    return events_(spark, sf_dir).select("event_id", answer.clarify_prompt(sources, ["how", "when"], "Which?").alias("prompt"))


#: Histories of a conversation in one mode, and what the other mode holds of them: nothing, older pairs that were carried before, the same questions with other answers, or the newest pair in front.
HISTORIES = """t AS (SELECT conv_id, list(text ORDER BY turn DESC) FILTER (role = 'user') AS u, list(text ORDER BY turn DESC) FILTER (role = 'assistant') AS r FROM conversations GROUP BY conv_id),
    h AS (SELECT conv_id, coalesce(u[1:4], []) AS sq, coalesce(r[1:4], []) AS sa, CASE conv_id % 4 WHEN 1 THEN coalesce(u[2:3], []) WHEN 2 THEN list_concat(['other'], coalesce(u[1:2], [])) WHEN 3 THEN coalesce(u[1:2], []) ELSE [] END AS dq,
    CASE conv_id % 4 WHEN 1 THEN list_transform(coalesce(r[2:3], []), lambda x: '【直前の社内ナレッジ検索での文脈】' || chr(10) || x) WHEN 2 THEN ['reply', 'different'] WHEN 3 THEN list_transform(coalesce(r[1:2], []), lambda x: '【直前の社内ナレッジ検索での文脈】' || chr(10) || x) ELSE [] END AS da FROM t)"""


@query(
    f"""WITH {HISTORIES}, i AS (SELECT conv_id, sq, sa, dq, da, unnest(range(1, 4)) AS i FROM h),
    n AS (SELECT *, list_filter(range(1, len(dq) + 1), lambda j: dq[j] = sq[i] AND regexp_replace(coalesce(da[j], ''), '^【直前の[^\n]*\n', '') = coalesce(sa[i], '')) AS there FROM i),
    k AS (SELECT conv_id, list(i ORDER BY i) FILTER (i > len(sq) OR len(there) = 0) AS stays FROM n GROUP BY conv_id),
    c AS (SELECT h.*, list_transform(list_filter(coalesce(stays, []), lambda i: i <= len(sq)), lambda i: right(sq[i], 4000)) AS q, list_transform(list_filter(coalesce(stays, []), lambda i: i <= len(sa)), lambda i: '【直前の社内ナレッジ検索での文脈】' || chr(10) || right(sa[i], 4000)) AS a FROM h JOIN k USING (conv_id)),
    m AS (SELECT *, (len(sq) > 0 OR len(sa) > 0) AND (len(q) > 0 OR len(a) > 0) AND NOT coalesce(len(dq) + len(da) > 0 AND coalesce(dq[1], '') = coalesce(sq[1], '') AND coalesce(da[1], '') = '【直前の社内ナレッジ検索での文脈】' || chr(10) || coalesce(sa[1], ''), false) AS moved FROM c)
    SELECT conv_id, moved, md5(array_to_string(CASE WHEN moved THEN list_concat(q, dq)[1:3] ELSE dq END, ';;;')) AS questions, md5(array_to_string(CASE WHEN moved THEN list_concat(a, da)[1:3] ELSE da END, ';;;')) AS answers, conv_id % 5 <> 0 AND moved AS switched FROM m"""
)
def carried_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories carried from one mode to the other; switched: the same where carrying is off for some."""
    c = table(spark, sf_dir, "conversations")
    of = lambda role: F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))), lambda x: x["text"])
    t = c.groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("r"))
    head = lambda x: F.concat(F.lit("【直前の社内ナレッジ検索での文脈】\n"), x)
    k, none = F.col("conv_id") % 4, F.array().cast("array<string>")
    dq = F.when(k == 1, F.slice("u", 2, 2)).when(k == 2, F.concat(F.array(F.lit("other")), F.slice("u", 1, 2))).when(k == 3, F.slice("u", 1, 2)).otherwise(none)
    da = F.when(k == 1, F.transform(F.slice("r", 2, 2), head)).when(k == 2, F.array(F.lit("reply"), F.lit("different"))).when(k == 3, F.transform(F.slice("r", 1, 2), head)).otherwise(none)
    text = lambda a: F.array_join(a, ";;;")
    args = [text(F.slice("u", 1, 4)), text(F.slice("r", 1, 4)), text(dq), text(da), F.lit("rag"), F.lit("normal"), F.lit(3)]
    made = t.select("conv_id", answer.bridged(*args).alias("b"), answer.bridged(*args, enabled=F.col("conv_id") % 5 != 0)["moved"].alias("switched"))
    return made.select("conv_id", "b.moved", F.md5("b.questions").alias("questions"), F.md5("b.answers").alias("answers"), "switched")


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '📄 ' || source || chr(10) || '【第1章】' || chr(10) || '[A1]x│ [B1]y' || chr(10) || replace(text, '[', '(') || chr(10) || '✕' WHEN 1 THEN source ELSE source || chr(10) || '[本棚] ' || replace(text, '[', '(') END AS t, source, text FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN length(source) + 2 WHEN doc_id % 3 = 1 THEN length(source) ELSE length(source) END::INTEGER AS head, CASE WHEN doc_id % 3 = 0 THEN (length(source) + 4) || '+5' ELSE '0+0' END AS crumb,
    CASE doc_id % 3 WHEN 0 THEN (length(source) + 10) || '+4,' || (length(source) + 17) || '+4' WHEN 1 THEN '' ELSE (length(source) + 2) || '+4' END AS refs,
    length(regexp_extract(t, '[^\r\n]*$'))::INTEGER * (CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END)::INTEGER AS closing FROM d"""
)
def marks_of_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer marks in passages: head, breadcrumb, tags at the start of lines and cells, closing line."""
    i, body = F.col("doc_id"), F.replace("text", F.lit("["), F.lit("("))
    shown = F.when(i % 3 == 0, F.concat(F.lit("📄 "), "source", F.lit("\n【第1章】\n[A1]x│ [B1]y\n"), body, F.lit("\n✕"))).when(i % 3 == 1, F.col("source")).otherwise(F.concat("source", F.lit("\n[本棚] "), body))
    v = table(spark, sf_dir, "documents").select("doc_id", answer.viewed(shown).alias("v"))
    plus = lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))
    return v.select("doc_id", F.col("v.head.length").alias("head"), plus(F.col("v.crumb")).alias("crumb"), F.array_join(F.transform("v.refs", plus), ",").alias("refs"), F.col("v.close.length").alias("closing"))


@query("SELECT conv_id, turn, array_to_string(list_slice(l, 1, 3), chr(10)) AS lines FROM (SELECT conv_id, turn, list_distinct_ordered AS l FROM (SELECT conv_id, turn, list_filter(list_transform(list_zip(w, range(1, len(w) + 1)), lambda z: CASE WHEN list_position(w, z[1]) = z[2] THEN z[1] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT conv_id, turn, list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda x: x <> '') AS w FROM conversations)))")
def lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", D.distinct_lines(F.replace(F.lower("text"), F.lit(" "), F.lit("\n")), 3).alias("l")).select("conv_id", "turn", F.array_join("l", "\n").alias("lines"))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '1.0,2.0;3.0,4.0' WHEN vec_id % 3 = 1 THEN '' ELSE label || '.5' END AS vectors,
    CASE WHEN vec_id % 4 = 0 THEN '1:s"' || vec_id || chr(10) || chr(92) || ':k' WHEN vec_id % 4 = 1 THEN '' WHEN vec_id % 4 = 2 THEN '2::a,b;7:cut off ' || vec_id || ':' ELSE '3:S' || label || ':' END AS rich FROM embeddings"""
)
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and enrichments of answers, whole, broken, with text around, or none."""
    i, label = F.col("vec_id"), F.col("label").cast("string")
    response = F.when(i % 3 == 0, '{"data":[{"embedding":[1.0,2]},{"embedding":[3,4]}]}').when(i % 3 == 1, "not json").otherwise(F.concat(F.lit('{"data":[{"embedding":['), label, F.lit(".5]}]}")))
    n = i.cast("string")
    rich = (
        F.when(i % 4 == 0, F.concat(F.lit('Here: [{"i": 1, "summary":"s\\"'), n, F.lit('\\n\\\\","keywords":"k"}] done')))
        .when(i % 4 == 1, "#ERR")
        .when(i % 4 == 2, F.concat(F.lit('[{"i":2,"keywords":"a,b"},{"i":x},{"i":7,"summary":"cut off '), n))
        .otherwise(F.concat(F.lit('{"i":3,"SUMMARY" : "S'), label, F.lit('"}')))
    )
    vectors = F.array_join(F.transform(D.embedding_arrays(response), lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")), ";")
    rows = F.array_join(F.transform(D.enrichments(rich), lambda r: F.concat_ws(":", r["i"].cast("string"), r["summary"], r["keywords"])), ";")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(vectors, F.lit("")).alias("vectors"), rows.alias("rich"))


@query(
    """SELECT doc_id, source || '|' || lang || CASE WHEN doc_id % 2 = 0 THEN '|x' ELSE '' END || CASE WHEN lang = 'en' THEN '' ELSE '|en' END AS labels FROM documents"""
)
def labels_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    held = F.concat_ws("|", "source", "lang", F.when(F.col("doc_id") % 2 == 0, F.lit("x")))
    return d.select("doc_id", T.merged_labels(held, F.concat(F.lit("|en||"), F.col("source"), F.lit("|en"))).alias("labels"))


@query(
    """WITH s AS (SELECT DISTINCT source AS key, 'old' AS value FROM documents), c AS (SELECT upper(source) AS key, max_by(doc_id, doc_id) AS value FROM documents WHERE source <> 'src3' GROUP BY source)
    SELECT s.key, coalesce(c.value::VARCHAR, s.value) AS value FROM s LEFT JOIN c ON lower(c.key) = s.key UNION ALL SELECT 'New', max(doc_id)::VARCHAR FROM documents"""
)
def settings_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    settings = d.select(F.col("source").alias("key"), F.lit("old").alias("value")).distinct()
    changes = d.filter("source <> 'src3'").select(F.concat(F.lit(" "), F.upper("source")).alias("key"), i.cast("string").alias("value"), i.alias("at")).unionByName(d.select(F.lit("New ").alias("key"), i.cast("string").alias("value"), i.alias("at")))
    return queue.settings_put(settings, changes)


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'me' WHEN event_id % 4 = 2 THEN '' ELSE 'id' || user_id END AS author, event_id % 5 < 2 AS wrong, event_id % 2 = 0 AS named FROM events")
def authors_and_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    stored = F.when(i % 4 < 2, F.concat(F.lit("id"), F.col("user_id").cast("string"))).otherwise("")
    line = F.lit("Doc A p.0|doc b p.1、Other p.7")
    return events_(spark, sf_dir).select("event_id", D.author_id(stored, i % 4 == 2, F.lit("me")).alias("author"), D.wrong_source(line, pick("doc a", "DOC B", "doc a", "other", "x"), i % 5).alias("wrong"), (i % 2 == 0).alias("named"))

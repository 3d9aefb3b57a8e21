"""Functions and operators on small inputs with known answers."""

import datetime as dt
import math
import re
import time

import pytest
from pyspark.sql import functions as F

from tessel.functions import python as P
from tessel.functions import text as T
from tessel.functions import vector as V
from tessel.functions.register import register
from tessel.operators import ingest, links, rank, retrieve, sets, usage
from tessel.sources import files
from tessel.streaming import stream


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("", "cbf29ce484222325"), ("hello", "32964f71b2764b97"), ("第12条", "5b02a1a0f87d2243")])
def test_fnv(spark, text, want):
    assert P.fnv(text) == want
    assert one(spark, ingest.fnv1a64(F.col("s")), s=text) == want


def test_normalisation(spark):
    assert one(spark, T.norm_search("s"), s="ＡbＣ１２　É\tx") == "abc12 É x"
    assert one(spark, T.compact("s"), s="ＡbＣ １２　É\tx") == "abc12Éx"
    assert one(spark, T.norm_hash("s"), s=" a   b\t\tc \r\n d ") == "a b c \n d"


def test_tokens_and_keys(spark):
    assert one(spark, T.tokens("s"), s="Rule12 第3条の規定 x") == ["rule12", "3", "x", "第条", "条の", "の規", "規定"]
    assert one(spark, T.distinct_keys("s"), s="第３条と第１２条の交通費精算について 別表2 KEYWORD")[:3] == ["第3条", "第12条", "別表2"]
    keys = one(spark, T.distinct_keys("s"), s="aa bb, ccc 交通費")
    assert keys == ["aabb", "ccc", "交通費"]
    assert one(spark, T.main_keyword("s"), s="what is 交通費精算規程 ok") == "交通費精算規程"


def test_key_score(spark):
    def want(keys, doc, cap=3.0):
        t = sum(min(len(k), 8) ** 1.5 * (1 + math.log(doc.count(k))) for k in keys if len(k) >= 2 and k in doc)
        return min(cap, t / (1 + math.log(1 + len(doc) / 900))) if t else 0.0

    for keys, doc in ((["ab", "x"], "abxabab"), (["交通費"], "交通費は交通費"), (["zz"], "abc"), (["longkeyword"], "longkeyword" * 3)):
        for cap in (3.0, 0.0):
            got = one(spark, T.key_score(F.array(*[F.lit(k) for k in keys]), F.col("d"), cap), d=doc)
            assert math.isclose(got, want(keys, doc, cap or 1e9), rel_tol=1e-12)


def test_labels_lines_and_pages(spark):
    assert one(spark, T.ref_labels("s"), s="第3条 様式第1 別表2 第3条 第4項") == ["第3条", "第4項", "別表2", "様式第1"]
    for line, want in (("a\tb", 4), ("# T", 1), ("【総則】", 1), ("第1章 総則", 1), ("## S", 2), ("第3条 目的", 2), ("1. x", 2), ("■見出し", 2), ("第2項", 3), ("・x", 3), ("①x", 3), ("body", 0)):
        assert one(spark, T.line_class("s"), s=line) == want, line
    assert one(spark, T.toc_page("s"), s="a ..... 1\nb ..... 2\nc") and not one(spark, T.toc_page("s"), s="a\nb\nc")
    assert one(spark, T.page_number_line("s"), s="- 12 -") and not one(spark, T.page_number_line("s"), s="x 12")
    assert one(spark, T.chapter_key("s"), s="総則 ..... 3>第1条") == "総則"
    assert one(spark, T.chunk_key("s"), s="bs::ab::p3::c14").asDict() == {"doc": "bs::ab", "page": 3, "seq": 14}
    assert one(spark, T.chunk_key("s"), s="other") is None


def test_small_parsers(spark):
    assert one(spark, T.pii_kind("s"), s="mail ａ＠ｂ．ｃ") == "email" and one(spark, T.pii_kind("s"), s="tel 03-1234 56789") == "number" and one(spark, T.pii_kind("s"), s="x 123") is None
    assert one(spark, T.strip_dates("s"), s="on 2024-01-02 at 10:30 ok") == "on  at  ok"
    assert one(spark, T.csv_safe("s"), s='=a,"b"') == '"\'=a,""b"""' and one(spark, T.csv_safe("s"), s="ok") == "ok"
    assert one(spark, T.team_code("s"), s="x_y_AB12C") == "AB12C" and one(spark, T.department("s"), s="x_AB12C") == "AB1" and one(spark, T.team_code("s"), s="x_ab") is None
    assert one(spark, T.tag_body("s", "rank"), s="a<rank>1,2</rank>") == "1,2" and one(spark, T.listed("s", r"\|", 2), s=" a || b |c") == ["a", "b"]
    assert one(spark, T.mode("s"), s=" Deep ") == "deep" and one(spark, T.mode("s"), s="x") == "quick"
    assert one(spark, T.human_bytes("n"), n=1536) == "1.5 KB" and one(spark, T.origin_kind("s"), s=" Pack:x") == "pack"
    assert one(spark, T.iso_date("s"), s="2024年3月5日") == "2024-03-05" and one(spark, T.iso_date("s"), s="soon") == "soon"
    assert one(spark, T.strip_controls("s"), s="a\x01\x02b  c") == "a b c" and one(spark, T.strip_controls("s"), s="a  b") == "a  b"
    assert one(spark, T.garble_ratio("s"), s="aяb ") == pytest.approx(1 / 3) and one(spark, T.replacement_ratio("s"), s="a�") == 0.5
    assert one(spark, T.question_key("s"), s="What, is THIS？ ") == "whatisthis" and one(spark, T.global_signal("s"), s="概要は") and one(spark, T.compound_signal("s"), s="a? b?")
    assert one(spark, T.cite_tags("s"), s="x [shelf a p1] [note]") == ["[shelf a p1]"]


def test_vectors(spark):
    a = [0.5, -1.0, 2.0]
    assert one(spark, V.dot("a", "b"), a=a, b=[1.0, 1.0, 1.0]) == 1.5 and one(spark, V.dot("a", "b"), a=a, b=[1.0]) == 0.0
    assert one(spark, V.l2_normalize("a"), a=[3.0, 4.0]) == [0.6, 0.8] and one(spark, V.l2_normalize("a"), a=[0.0]) is None
    assert one(spark, V.truncated("a", 2), a=[3.0, 4.0, 9.0]) == [0.6, 0.8]
    assert one(spark, V.sign_words("a"), a=[1.0, -1.0, 0.0]) == [0b101] and len(one(spark, V.sign_words("a"), a=[1.0] * 33)) == 2
    assert one(spark, V.hamming("a", "b"), a=[5, 1], b=[6, 1]) == 2
    assert one(spark, V.from_csv("s"), s="1, 2.5,-3") == [1.0, 2.5, -3.0] and one(spark, V.from_csv("s"), s="1,,2") is None and one(spark, V.from_csv("s"), s="1,x") is None
    assert one(spark, V.to_csv("a"), a=[0.1234565, 1.0]) == "0.123457,1.0"


def test_python_functions(spark):
    v = P.mock_embedding("x", 8)
    assert v == P.mock_embedding("x", 8) != P.mock_embedding("y", 8) and math.isclose(sum(x * x for x in v), 1)
    lacking = lambda a, b: spark.range(1).select(T.ungrounded(F.lit(a), F.lit(b)).alias("x")).first().x
    assert lacking("1. It takes 45日\n第3条 says 10% of 7 and 1234, 1,5", "10 percent 第4条") == ["45日", "第3条", "1234", "1,5"]
    assert lacking("a 45円 b 第9条", "") == [] and lacking("45円", None) == [] and lacking("(3) x\n3点. y", "z") == []
    assert lacking("100円 200円 300円 400円 500円", "z") == ["100円", "200円", "300円", "400円"]
    assert lacking("[B42] (ab12 付近) [本棚: 9999] (コード: E0203) ４５円", "45 円") == []


def test_chunks(spark):
    text = "One sentence here. " * 100
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string")
    rows = ingest.fixed_chunks(df, "id", "t", 200, 50).orderBy("seq").collect()
    covered = set()
    for r in rows:
        assert text[r.start : r.end] == r.text and len(r.text) <= 250
        covered |= set(range(r.start, r.end))
    assert covered == set(range(len(text))) and {r.id for r in rows} == {1}
    s = spark.createDataFrame([(1, "# A\nbody a\n## B\nbody b\n# C\n" + "long text. " * 60)], "id long, t string")
    parts = ingest.structured_chunks(s, "id", "t", 200, 40, 300).orderBy("seq").collect()
    assert parts[0].text.startswith("【〔資料〕 > # A】\n# A") and parts[1].text.startswith("【〔資料〕 > # A > ## B】\n") and len(parts) > 4
    p = spark.createDataFrame([(1, "a .... 1\n# b .... 2\nc .... 3\f# T\nx   y\fmore  text\f■ S")], "id long, t string")
    got = [(r.page, r.text) for r in ingest.structured_chunks(p, "id", "t", 200, 40, 300).orderBy("seq").collect()]
    assert got == [(1, "【〔資料〕】\na .... 1\n# b .... 2\nc .... 3"), (2, "【〔資料〕 > # T】\n# T\nx   y\nmore text"), (4, "【〔資料〕 > # T > ■ S】\n■ S")]
    for line in ("a\tb", "# T", "【総則】", "第1章 総則", "## S", "第3条 目的", "1. x", "■見出し", "■見出し。", "第2項", "・x", "①x", "(1) x", "body", "x   y"):
        assert one(spark, T.line_class("s"), s=line) == ingest.line_class(line), line


def test_pages(spark):
    df = spark.createDataFrame([(1, "\f a \fb\f \fc\f")], "id long, t string")
    p = ingest.form_feed_pages(df, "id", "t", 4).orderBy("page").collect()
    assert [(r.page, r.text, r.truncated) for r in p] == [(2, " a ", True), (3, "b", True), (4, " ", True)]
    pages = spark.createDataFrame([(1, 1, "x\ny"), (1, 3, "z")], "id long, page int, text string")
    joined = ingest.join_pages(pages, ["id"])
    back = joined.select(F.inline(ingest.split_pages(F.col("text")))).collect()
    assert [(r.page, r.text) for r in back] == [(1, "x\ny"), (3, "z")]
    bad = spark.createDataFrame([(1, "я" * 60), (1, "ok" * 30), (2, "я" * 60)], "id long, text string")
    kept = {(r.id, r.all_garbled) for r in ingest.drop_garbled(bad, "id", "text").collect()}
    assert kept == {(1, False), (2, True)}


def test_rank_operators(spark):
    hits = spark.createDataFrame([("a", "s", 0.9, 1), ("b", "s", 0.8, 2), ("c", "t", 0.7, 3), ("d", "s", 0.6, 4)], "id string, source string, score double, ord int")
    assert [r.id for r in rank.diversity_order(hits).orderBy("place").collect()] == ["a", "c", "b", "d"]
    assert [r.id for r in rank.demoted(hits, F.col("id") == "a", 3, "ord").collect()] == ["b", "c", "d"]
    assert [r.id for r in rank.wrong_last(hits, F.col("id").isin("a", "b"), "ord").orderBy("place").collect()] == ["c", "d", "b", "a"]
    assert one(spark, rank.explicit_order(F.col("s"), F.lit(4)), s="3, 1,x,3,9 2") == [3, 1, 2]
    same = hits.filter("source = 's'").select("id", "source", "score", F.col("ord").alias("rank"))
    pool = hits.select("id", "source", "score")
    assert {r.id for r in rank.diversity_swap(same, pool, 70).collect()} == {"a", "b", "c"}
    assert {r.id for r in rank.diversity_swap(same, pool, 200).collect()} == {"a", "b", "d"}
    assert rank.dispersion(hits.withColumn("g", F.lit(1)), ["g"]).first().gap == 22
    near = spark.createDataFrame([("s", i) for i in range(10)], "source string, n int")
    assert {r.n for r in rank.neighbours(near, F.col("n") == 4, "source", ["n"], 2).collect()} == {2, 3, 5, 6}


def test_sets_and_usage(spark):
    old = spark.createDataFrame([("A", "xx", 1), ("bb", "yy", 2)], "term string, canonical string, ord int")
    new = spark.createDataFrame([("a", "z", 3)], "term string, canonical string, ord int")
    assert {(r.term, r.canonical) for r in sets.merged_pairs(old, new).collect()} == {("bb", "yy"), ("a", "z")}
    q = spark.createDataFrame([("on yy only",), ("none",)], "query string")
    assert {r.expanded for r in sets.synonyms(q, old).collect()} == {"on yy only bb", "none"}
    assert one(spark, sets.merged_recent(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a")), 2)) == ["c", "a"]
    assert one(spark, usage.source_of(F.col("s")), s="source=My Doc chunks=3") == "My Doc" and one(spark, usage.source_of(F.col("s")), s="a source=Doc x") == "Doc" and one(spark, usage.source_of(F.col("s")), s="src=My Doc") == "My Doc"
    days = usage.business_days(spark, "2024-01-01", "2024-01-09", ["2024-01-01", "2024-01-08"])
    assert [str(r.day) for r in days.orderBy("i").collect()] == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-09"]


def test_containing_both_ways(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again today"), (2, "nothing here")], "d long, t string")
    probes = spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog again"), (8, "nothing")], "p long, q string")
    for most in (10, 0):
        assert {(r.p, r.d) for r in ingest.containing(docs, probes, "d", "t", "p", "q", most=most).collect()} == {(7, 1), (8, 2)}


def test_centroids_and_kmeans(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0, 0.1 * (i % 3)] if i % 2 else [0.1 * (i % 3), 1.0]) for i in range(20)], "id long, g int, v array<double>")
    c = {r.g: r.centroid for r in links.centroids(rows, ["g"], "v").collect()}
    assert c[1][0] > 0.9 and c[0][1] > 0.9
    k = {r.id: r.cluster for r in links.kmeans(rows, "id", "v").collect()}
    assert all(k[i] != k[j] for i in range(0, 20, 2) for j in range(1, 20, 2))
    assert links.nearest_centroids(links.centroids(rows, ["g"], "v"), "g", "centroid", 3).count() == 2


def test_search_equals_brute_force(spark):
    rows = spark.createDataFrame([(i, [float((i * 7) % 5), float((i * 3) % 4), 1.0], f"key text {i}") for i in range(50)] + [(99, [1.0], "x")], "id long, v array<double>, t string")
    q = [0.5, 0.25, 1.0]
    got = [(r.id, r.score) for r in retrieve.search(rows, q, "id", "v", 5).collect()]
    want = sorted(((i, round(sum(a * b for a, b in zip([float((i * 7) % 5), float((i * 3) % 4), 1.0], q, strict=True)), 6)) for i in range(50)), key=lambda x: (-x[1], x[0]))[:5]
    assert got == want
    assert [r.id for r in retrieve.prefiltered(rows.filter("id < 99"), q, "id", "v", 60, 5).collect()] == [i for i, _ in want]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes("第1条 交通費の精算について定める。".encode("cp932"))
    (tmp_path / "~$c.txt").write_text("temp")
    (tmp_path / "d.bin").write_text("x")
    texts = {r.file_name: r.text for r in files.text_files(spark, str(tmp_path)).collect()}
    assert texts["a.txt"] == "héllo" and texts["b.txt"] == "第1条 交通費の精算について定める。"
    assert {r.file_name for r in files.folder(spark, str(tmp_path)).collect()} == {"a.txt", "b.txt"}
    assert one(spark, files.sheet_row(F.array(F.lit("a"), F.lit(""), F.lit("c"), F.lit("")), F.lit(3))) == "[A3]a\t\t[C3]c"
    assert one(spark, files.encrypted(F.col("b")), b=bytearray(b"PK\x03\x04")) == "plain"


def test_packs(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "S", "self", 1, "", "", "text one"), ("c2", "S", "self", 2, "", "", "text  two"), ("c3", "T", "self", 1, "", "", "mail a@b.c")], files.CHUNKS)
    vectors = spark.createDataFrame([("c1", [1.0, 2.0]), ("c1", [1.0, 2.0])], files.VECTORS)
    files.write_pack(str(tmp_path / "p"), chunks, vectors, "me", 2, source="s")
    meta, pack = files.read_pack(spark, str(tmp_path / "p"), 2)
    assert meta["author"] == "me" and pack.count() == 2
    with pytest.raises(ValueError):
        files.write_pack(str(tmp_path / "q"), chunks, vectors, "me", 2)
    with pytest.raises(ValueError):
        files.read_pack(spark, str(tmp_path / "p"), 3)
    shelf = spark.createDataFrame([("k", "S", "pack:me", "text two", True), ("l", "S", "self", "text one", True)], "chunk_id string, source string, origin string, full_text string, embedded boolean")
    got = {(r.chunk_id, r.origin, r.embedded) for r in files.imported(shelf, pack, "pack:me", ["PACK:ME"]).collect()}
    assert got == {("l", "self", True), ("c2", "pack:me", False)}


def test_manifest(spark):
    t = dt.datetime(2024, 1, 1)
    listed = spark.createDataFrame([("A", 1, t), ("b", 2, t), ("c", 3, t), ("d", 4, t)], "file_name string, size long, modified_at timestamp")
    manifest = spark.createDataFrame([("a", 1, t, "done"), ("B", 9, t, "done"), ("c", 3, t, "failed"), ("e", 1, t, "done")], "file_name string, size long, modified_at timestamp, status string")
    got = {r.file_name: r.decision for r in ingest.manifest_diff(listed, manifest).collect()}
    assert got == {"a": "keep", "b": "replace", "c": "replace", "d": "ingest", "e": "missing"}


def test_registered_functions(spark):
    names = register(spark)
    assert {"norm_search", "dot", "chunk_text"} <= set(names)
    r = spark.sql("SELECT compact('Ａ b') AS a, dot(array(1D, 2D), array(3D, 4D)) AS d, fnv1a64('hello') AS f, occurrences('abab', 'ab') AS o, exp_level(400) AS l, size(mock_embedding('x', 4)) AS m").first()
    assert (r.a, r.d, r.f, r.o, r.l, r.m) == ("ab", 11.0, "32964f71b2764b97", 2, 3, 4)
    assert spark.sql("SELECT count(*) AS n FROM chunk_text('" + "word. " * 50 + "', 100, 20)").first().n > 2


def test_used_chunks_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", t, "a"), ("s", t + dt.timedelta(minutes=5), "a"), ("s", t + dt.timedelta(minutes=50), "a"), ("u", t, "b")]
    df = spark.createDataFrame(rows, "session string, ts timestamp, chunk string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted((r.session, r.chunk, r.seen_before) for r in stream.drained(stream.used_chunks(s, "session", "ts", "chunk"), folder=str(tmp_path)).collect())
    assert got == [("s", "a", False), ("s", "a", False), ("s", "a", True), ("u", "b", False)]


def test_bridged_carries_pairs_once(spark):
    from tessel.operators import answer

    head = "【直前の社内ナレッジ検索での文脈】\n"

    def made(sq, sa, dq, da, a="rag", b="normal", most=3, **more):
        c = answer.bridged(*(F.lit(x).cast("string") for x in (sq, sa, dq, da)), F.lit(a), F.lit(b), F.lit(most), **more)
        r = spark.range(1).select(c.alias("x")).first().x
        return r.moved, r.questions, r.answers

    assert made("q2;;;q1", "a2;;;a1", "q1", head + "a1") == (True, "q2;;;q1", f"{head}a2;;;{head}a1")
    assert made("q2;;;q1", "a2;;;a1", "q1", "another") == (True, "q2;;;q1;;;q1", f"{head}a2;;;{head}a1;;;another")
    assert made("q1", "a1", "q1", head + "a1") == (False, "q1", head + "a1")
    assert made("q1", "a1", "x;;;y;;;z", "1;;;2;;;3") == (True, "q1;;;x;;;y", f"{head}a1;;;1;;;2")
    assert made("", "", "x", "1") == made(None, None, "x", "1") == made("q", "a", "x", "1", "rag", "rag") == made("q", "a", "x", "1", "rag", "other") == (False, "x", "1")
    assert made("q", "a", "", "", enabled=F.lit(False)) == (False, "", "")
    assert made("q", "a", None, None, "normal", "rag", 0) == (True, "q", "【直前の一般アシスタントでの文脈】\na")
    long = "x" * 5000
    moved, q, a = made(f"{long};;;q2", f"{long};;;a2", "", "")
    assert q == "x" * 4000 + ";;;q2" and a == head + "x" * 4000 + f";;;{head}a2"
    assert made(long, long, "x" * 4000, head + "x" * 4000)[0] is False
    many = ";;;".join(["y" * 4000] * 6)
    assert made(many, "", "", "", most=9)[1] == ";;;".join(["y" * 4000] * 5)


def test_viewed_marks(spark):
    from tessel.operators import answer

    def marks(t):
        v = one(spark, answer.viewed(F.col("t")), t=t)
        return tuple(v.head), tuple(v.crumb), [tuple(r) for r in v.refs], tuple(v.close)

    assert marks("") == ((0, 0), (0, 0), [], (0, 0)) and marks("head") == ((1, 4), (0, 0), [], (0, 0))
    assert marks("h\n【c】\n[A1]x│ [B1]y [C1]\r[open\n[x]]z\nend") == ((1, 1), (3, 3), [(7, 4), (14, 4), (31, 3)], (37, 3))
    assert marks("[A]\n【c") == ((1, 3), (5, 2), [(1, 3)], (5, 2)) and marks("h\n") == ((1, 1), (0, 0), [], (0, 0))


def test_viewed_takes_time_with_the_text_only(spark):
    from tessel.operators import answer

    text = "head\n" + "x" * 60_000 + "\n" + "[A1]y│ [B1 𝒳]é x[no]\n" * 1500 + "[open\n" + "[" * 20_000 + "\rend"
    want = [(m.start() + 1, len(m.group())) for m in re.finditer("(?:\\A|(?<=[\r\n])|(?<=│ ))\\[[^\\]\r\n]*\\]", text)]
    t = time.monotonic()
    v = one(spark, answer.viewed(F.col("t")), t=text)
    assert [tuple(r) for r in v.refs] == want and len(want) == 3000
    assert (tuple(v.head), tuple(v.crumb), tuple(v.close)) == ((1, 4), (0, 0), (len(text) - 2, 3))
    assert time.monotonic() - t < 30
    assert one(spark, answer.spans(F.col("t"), "[0-9]+"), t="12é3") == [(1, 2), (4, 1)] and one(spark, answer.spans(F.lit(None).cast("string"), "x")) is None


def test_a_shared_file_is_replaced_in_one_step(spark, tmp_path):
    from tessel.sources import shared

    at = f"{tmp_path}/x/version.txt"
    for text in ("one", "二" * 1000, ""):
        shared.write_text(spark, at, text)
        assert shared.read_text(spark, at) == text
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["version.txt"]


def test_analytics_files_begin_with_a_mark(spark, tmp_path):
    files.write_analytics(spark.createDataFrame([(1, "é")], "a int, b string").coalesce(1), f"{tmp_path}/out")
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b\n")


def test_enrichments_are_scanned(spark):
    from tessel.functions import decide as D

    got = lambda t: [tuple(r) for r in one(spark, D.enrichments(F.col("t")), t=t)]
    assert got('x [{"i":1,"summary":"a \\"b\\" \\\\ c\\n","keywords":"k,l"}, {"i": 2}] y') == [(1, 'a "b" \\ c\n', "k,l"), (2, "", "")]
    assert got('{"i":x} {"i": 30 ,"Keywords":"only"') == [(30, "", "only")] and got("") == [] == got("nothing")
    assert got('"i":5,"summary":"never closed') == [(5, "never closed", "")]


def test_labels_settings_and_scores_of_known_keys(spark):
    from tessel.operators import queue

    assert one(spark, T.merged_labels(F.col("a"), F.col("b")), a="x|y|x", b="y|z||z") == "x|y|x|z"
    assert one(spark, T.merged_labels(F.col("a"), F.col("b")), a="", b="z") == "z" and one(spark, T.merged_labels(F.lit(None).cast("string"), F.lit(""))) == ""
    old = spark.createDataFrame([("Top_K", "5"), ("other", "x")], "key string, value string")
    new = spark.createDataFrame([(" top_k", "7", 1), ("TOP_K", "9", 2), ("new", "1", 1), ("  ", "z", 1)], "key string, value string, at int")
    assert {tuple(r) for r in queue.settings_put(old, new).collect()} == {("Top_K", "9"), ("other", "x"), ("new", "1")}
    for t in ("", "licenselicenseapache", "a", "xxthe"):
        keys = ["license", "apache", "the", "a"]
        assert math.isclose(one(spark, T.key_score_of(keys, F.col("t")), t=t), one(spark, T.key_score(F.array(*[F.lit(k) for k in keys]), F.col("t")), t=t))


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    def checked(rows):
        def all_rows(batches):
            for b in rows(batches):
                assert len(b) < 10
                yield b

        return all_rows

    monkeypatch.setattr(ingest, "HELD", 1000)
    monkeypatch.setattr(ingest, "trimmed", checked)
    df = spark.createDataFrame([(i, "word. " * 400) for i in range(8)], "id int, t string").coalesce(1)
    for f, more in ((ingest.fixed_chunks, ()), (ingest.structured_chunks, (300,))):
        got = f(df, "id", "t", 200, 50, *more).groupBy("id").agg(F.count("*").alias("n"), F.max("end").alias("end"), F.max("seq").alias("last")).collect()
        assert len(got) == 8 and all(r.n == r.last + 1 and r.end >= 2398 for r in got)


def test_suppressed_events_keep_a_state_row_a_bucket(spark, tmp_path):
    rows = [(i, i % 3000, dt.datetime(2024, 1, 1, 3 * (i // 3000))) for i in range(6000)]
    spark.createDataFrame(rows, "id long, user long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, user long, ts timestamp").parquet(str(tmp_path / "in"))
    at = str(tmp_path / "out")
    q = stream.suppressed(s, ["user"], "ts", "id", 2).writeStream.format("parquet").option("path", at).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(at).count() == 6000
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(sizes) <= stream.BUCKETS

"""Decisions, expansion and shelf operators on small inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessel.functions import decide as D
from tessel.functions.python import mock_embedding
from tessel.operators import expand, shelf

L = F.lit


@pytest.fixture(scope="module")
def ask(spark):
    """Values of several columns at once, as one job."""

    def of(**columns):
        return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()

    return of


def test_predicates(ask):
    day = "2024-01-02"
    got = ask(
        memo=D.memo_source(L("訂正メモ:x")),
        gap=D.gap_row(L("gap"), L(None).cast("string"), L(False)),
        not_gap=D.gap_row(L("gap"), L("correction"), L(False)),
        newer=D.within_window(L(day), L("2024-01-01")),
        equal=D.within_window(L(day), L(day)),
        bad=D.within_window(L("x"), L(day)),
        aged=D.gap_aged(L("gap"), L("2023-01-01"), L(day)),
        dateless=D.gap_aged(L("gap"), L(""), L(day)),
        vague=D.too_vague(L("how?"), L(0.5), L(40)),
        clear=D.too_vague(L("how?"), L(0.9), L(40)),
        whole=D.too_vague(L("概要は"), L(0.1), L(1)),
        gate=D.decompose_gate(L("auto"), L("a? b?")),
        gate_off=D.decompose_gate(L("off"), L("a? b?")),
        needs=D.document_class(L(True), L(False), L(True)),
        cannot=D.document_class(L(True), L(False), L(False)),
        shrunk=D.shrunk(L(10), L(4)),
        low=D.low_hit(L(0.2)),
    )
    assert got == dict(memo=True, gap=True, not_gap=False, newer=True, equal=False, bad=False, aged=True, dateless=False, vague=True, clear=False, whole=False, gate=True, gate_off=False, needs="needs", cannot="cannot", shrunk=True, low=True)


def test_expiry_and_locks(ask):
    e = lambda days, warned="", wiped="", reach=False, limit=30: D.expiry(L("" if days is None else "2024-01-01"), L(days).cast("int"), L(limit), L(warned), L(wiped), L(reach))
    got = ask(off=e(1, limit=0), never=e(None), early=e(5), warn=e(25), warned=e(25, "25"), late=e(40), wipe=e(40, "25"), done=e(40, "25", "x"), near=e(40, "25", reach=True), go=D.lock_action(L(False), L(0), L(5)), stale=D.lock_action(L(True), L(-6), L(5)), wait=D.lock_action(L(True), L(1), L(5)))
    assert got == dict(off="off", never="never", early="none", warn="warn", warned="none", late="warn_first", wipe="wipe", done="none", near="none", go="go", stale="stale", wait="wait")


def test_arithmetic(ask):
    got = ask(
        used=D.usage_percent(L(1), L(8)),
        over=D.usage_percent(L(9), L(8)),
        none=D.usage_percent(L(9), L(0)),
        cap=D.per_chapter_cap(L(100), L(3), L(5)).cast("int"),
        part=D.per_part_top_k(L(16), L(4)).cast("int"),
        start=D.rotation_start(L(10), L(4), L(-7)),
        page=D.page_at(F.array(L(0), L(10), L(20)), F.array(L(1), L(2), L(5)), L(15)),
        midnight=D.elapsed_ms(L(86399.0), L(1.0)),
        batch=D.batch_bounds(L(10), L(4), L(2)),
        past=D.batch_bounds(L(10), L(4), L(3)),
        chapters=D.estimated_chapters(L(7)),
        thin=D.thin_extract(L("pdf"), L(40), L(2), L(99999)),
        pre=D.prefilter(L(6000), 5000, L(False), L(True), L(False)),
        scoped=D.prefilter(L(6000), 5000, L(True), L(True), L(True)),
        keep=D.nonce_keep_days(L(30)),
    )
    assert got == dict(used=12, over=100, none=0, cap=33, part=6, start=8, page=2, midnight=2000, batch=(9, 10), past=None, chapters=2, thin=True, pre=True, scoped=False, keep=37)


def test_states_and_codecs(ask):
    now = L("2024-01-01 12:00:00").cast("timestamp")
    line = D.beacon(L("u"), L(3), L("20240101"), L(15), L("202401"), L(30), L("2024"), L(45), L("AB12"))
    got = ask(
        old=D.pending_expired(L("2024-01-01 11:29:59"), now),
        edge=D.pending_expired(L("2024-01-01 11:30:00"), now),
        odd=D.pending_expired(L("x"), now),
        blank=D.pending_expired(L(""), now),
        ok=D.board_status(L("a\n#end 1"), L(1), now, now),
        broken=D.board_status(L("a"), L(1), now, now),
        new=D.beacon_fields(F.concat_ws("\t", line, L("t"))),
        legacy=D.beacon_fields(L("u\t1\td\t5\tm\t6\ty\t7\tt")),
        short=D.beacon_fields(L("u\t1")),
    )
    assert (got["old"], got["edge"], got["odd"], got["blank"], got["ok"], got["broken"], got["short"]) == (True, False, True, False, "ok", "broken", None)
    assert got["new"].team == "AB12" and got["new"].day_min == 15 and got["new"].stamp == "t"
    assert got["legacy"].team == "" and got["legacy"].year_min == 7


def test_texts(ask):
    got = ask(
        joined=D.joined_numbers(L("第 １ ２ 条 目的")),
        kept=D.joined_numbers(L("plain 第 x")),
        text=D.ingest_text(L("a\n- 12 -\nb")),
        crumb=D.breadcrumb(L("S"), L("C"), L("")),
        path=D.section_path(L("【S > 第1章 > 第2条】\nbody")),
        cites=D.unverified(L("x [shelf a p1] y [pack b]"), F.array(L("[shelf ap1]"))),
        choice=D.choice_numbers(L("1、２ ③, 3 99"), 5),
        void=D.choice_numbers(L("1 or 2"), 5),
        parent=D.path_escapes(L("a/../b")),
        fine=D.path_escapes(L("name")),
        pick=D.encoding_pick(L(0.5), L(True), L(0.1)),
        lines=D.distinct_lines(L("A\na\n\nb\nc"), 2),
        same=D.memo_level(L("What is x?"), L("what is X")),
        near=D.memo_level(L("交通費の精算"), L("交通費と精算は")),
        far=D.memo_level(L("交通費 精算"), L("other")),
        wrong=D.wrong_source(L("Doc A p.3|Doc B p.4"), L("doc b"), L(4)),
        right=D.wrong_source(L("Doc A p.3"), L("doc a"), L(4)),
        author=D.author_id(L(""), L(False), L("me")),
        unknown=D.author_id(L(""), L(True), L("me")),
        vectors=D.embedding_arrays(L('{"data":[{"embedding":[1.0,2]}]}')),
        rich=D.enrichments(L('[{"i":1,"summary":"s","keywords":"k"}]')),
        poor=F.size(D.enrichments(L("not json"))),
    )
    assert (got["joined"], got["kept"], got["text"], got["crumb"], got["path"]) == ("第12条 目的", "plain 第 x", "a\nb", "【S > C】", "第1章>第2条")
    assert got["cites"] == "x [shelf a p1] y [pack b]（未確認）"
    assert (got["choice"], got["void"], got["parent"], got["fine"], got["pick"], got["lines"]) == ([1, 2, 3], [], "parent", "", "shift_jis", ["A", "b"])
    assert (got["same"], got["near"], got["far"], got["wrong"], got["right"], got["author"], got["unknown"]) == (2, 1, 0, True, False, "me", "")
    assert got["vectors"] == [[1.0, 2.0]] and got["rich"][0].summary == "s" and got["poor"] <= 1


def test_memo_injection(spark):
    hits = spark.createDataFrame([("a", "Doc A", 1, 0.9, 1), ("b", "Doc B", 4, 0.8, 2), ("c", "Doc C", 1, 0.7, 3)], "id string, source string, page int, score double, rank int")
    memos = spark.createDataFrame([("m1", "訂正メモ:1", "what is x", "Doc A p.1", 1), ("m2", "訂正メモ:2", "What is X?", "Doc B p.4", 2)], "id string, source string, question string, wrong string, ord int")
    got = [(r.id, r.score) for r in expand.memo_injected(hits, memos, "What is x", 4).orderBy("place").collect()]
    assert got == [("m2", 1.0), ("a", 0.9), ("c", 0.7), ("b", 0.8)]
    assert [r.id for r in expand.memo_injected(hits, memos, "other words", 2).orderBy("place").collect()] == ["a", "b"]


def test_chapter_groups(spark):
    rows = [("s", f"Ch {c}>x", 10 * i + j) for i, (c, n) in enumerate([("A", 1), ("B", 1), ("C", 4), ("D", 1)]) for j in range(n)]
    got = [(r.keys, r.chunks) for r in expand.chapter_groups(spark.createDataFrame(rows, "source string, section_path string, ord int")).orderBy("group").collect()]
    assert got == [("Ch A｜Ch B｜Ch C", 6), ("Ch D", 1)]
    many = [("s", f"Ch {i}", i) for i in range(300)]
    assert expand.chapter_groups(spark.createDataFrame(many, "source string, section_path string, ord int")).count() <= 60


def test_chapter_groups_of_many_chapters(spark):
    import time

    def folded(ns, enough):
        out = []
        for c, n in ns:
            if out and out[-1][1] < enough:
                out[-1] = (f"{out[-1][0]}｜{c}", out[-1][1] + n)
            else:
                out.append((c, n))
        return out

    few, many = [(f"Ch {i}", i % 3 + 1) for i in range(50)], [(f"Ch {i}", i % 4 + 1) for i in range(20_000)]
    df = spark.range(20_000).selectExpr("'s' AS source", "id", "id % 4 + 1 AS n").unionByName(spark.range(50).selectExpr("CAST(null AS STRING) AS source", "id", "id % 3 + 1 AS n"))
    df = df.selectExpr("source", "concat('Ch ', id, '>x') AS section_path", "explode(sequence(id * 10, id * 10 + n - 1)) AS ord")
    t = time.monotonic()
    got = [(r.source, r.keys, r.chunks) for r in expand.chapter_groups(df).orderBy("source", "group").collect()]
    assert time.monotonic() - t < 40
    want = folded(few, 3)
    assert len(want) <= 60 and len(folded(many, 3)) > 60
    assert got == [(None, *x) for x in want] + [("s", *x) for x in folded(many, -(-sum(n for _, n in many) // 60))]


def test_manifest_states(spark):
    m = spark.createDataFrame([("/f/a.txt", "failed", 3, 2), ("/f/b.txt", "failed", 1, 1), ("/f/c.txt", "done", 5, 0)], "file_path string, status string, chunk_count int, streak int")
    ch = spark.createDataFrame([("/f/a.txt", "failed", -1), ("/f/b.txt", "done", 4), ("/f/d.txt", "failed", 0)], "file_path string, status string, chunk_count int")
    got = {r.file_path: (r.status, r.chunk_count, r.streak) for r in shelf.manifest_upserted(m, ch).collect()}
    assert got == {"/f/a.txt": ("failed_permanent", 3, 3), "/f/b.txt": ("done", 4, 0), "/f/c.txt": ("done", 5, 0), "/f/d.txt": ("failed", 0, 1)}
    own = m.withColumn("origin", F.lit("self"))
    assert shelf.manifest_scope(own, "/F", ("txt",)).count() == 3 and {r.status for r in shelf.marked_missing(own, "/f").collect()} == {"missing"}
    done = shelf.manifest_upserted(m, ch)
    assert {r.file_path: r.status for r in shelf.streak_reset(done, "/f/a.txt").collect()}["/f/a.txt"] == "failed"


def test_ingest_is_idempotent(spark):
    pages = spark.createDataFrame([("Doc", "# Top\nBody of 第 １ 条 here.\n- 3 -\n# Next\nMore text about 別表2.")], "source string, text string")
    none = spark.createDataFrame([], "source string, full_text string")
    first = shelf.ingested(pages, none, "self").orderBy("seq").collect()
    assert [r.section_path for r in first] == ["# Top", "# Next"] and first[0].full_text.startswith("【Doc > # Top】") and "第1条" in first[0].full_text and first[1].refs == ["別表2"]
    held = spark.createDataFrame([("Other", r.full_text) for r in first], "source string, full_text string")
    assert shelf.ingested(pages, held, "self").count() == 0


def test_channels_and_versions(spark):
    v = spark.createDataFrame([("a", "/p1", "1", True), ("b", "/q", "1", True)], "channel string, path string, version string, current boolean")
    p = shelf.published(spark, v, "a", "/p2", "2")
    now = lambda df: {r.channel: r.path for r in df.filter("current").collect()}
    assert now(p) == {"a": "/p2", "b": "/q"} and now(shelf.rolled_back(p, "a", "1")) == {"a": "/p1", "b": "/q"}
    shelf_ = spark.createDataFrame([(1, "self")], "id int, origin string")
    assert shelf.channel_synced(shelf_, shelf_, "x", "1", "1") is shelf_


def test_inboxes(spark):
    t = dt.datetime(2024, 1, 2, 12)
    q = spark.createDataFrame([("How to x?", "u1", t), ("mail me a@b.c", "u1", t), ("", "u1", t), ("Old one", "u2", t), ("On 2024-01-01 at 10:00 what", "u3", t)], "question string, user_id string, at timestamp")
    sent = spark.createDataFrame([("oldone", t - dt.timedelta(hours=23)), ("howtox", t - dt.timedelta(hours=24))], "key string, at timestamp")
    assert {r.key for r in shelf.gap_events(q, sent).collect()} == {"howtox", "on2024-01-01at10:00what"}
    box = spark.createDataFrame([("n1", "ME", t, 1), ("n1", "me", t, 2), ("n2", "you", t, 3), ("n3", "me", t, 4)], "nonce string, addressee string, at timestamp, x int")
    seen = spark.createDataFrame([("n3",)], "nonce string")
    assert [r.nonce for r in shelf.thanks(box, ["Me"], seen).collect()] == ["n1"]
    assert shelf.delivered(box, ["me", "you"], seen, 1).count() == 1


def test_search_over_tables(spark):
    k = spark.createDataFrame([("c1", "S", 1, "", "", "alpha beta", None, 1), ("c1", "S", 1, "", "", "later", None, 2), ("c2", "T", 1, "", "", "beta beta", None, 3), ("c3", "T", 1, "", "", "x", None, 4)], "chunk_id string, source string, page int, summary string, keywords string, full_text string, norm_text string, ord int")
    v = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [1.0]), ("c9", [1.0, 1.0])], "chunk_id string, vector array<double>")
    hits = shelf.search(v, k, [1.0, 0.5], "beta", 5).collect()
    assert [h.chunk_id for h in hits] == ["c1", "c2"] and hits[0].preview == "alpha beta" and hits[1].score > 0.5
    assert shelf.multi_search(v, k, [("q", None)], 5).count() == 0
    none = shelf.search(v, k, [1.0, 0.5], "beta", 5, scope=spark.createDataFrame([("S",)], "source string"))
    assert shelf.widened(none, shelf.search(v, k, [1.0, 0.5], "beta", 5)).count() == 2
    embed = F.udf(lambda s: mock_embedding(s, 4), "array<double>")
    todo = spark.createDataFrame([("a", "text", False), ("b", "t", True)], "chunk_id string, t string, embedded boolean")
    assert [r.chunk_id for r in shelf.pending_embedding(todo, "t", embed).filter("embedded").collect()] == ["a"]
    ctx = shelf.context(spark.createDataFrame([("S", 1, "abcdef", 1), ("T", 2, "ghijkl", 2)], "source string, page int, full_text string, rank int"), 8).first().context
    assert ctx == "[S p.1]\nabcdef\n\n[T p.2]\ngh"


def test_blended_folds_every_value(spark):
    from tessel.operators import usage

    n = 1_000_003
    rows = spark.range(n).select(F.lit("u").alias("user"), "id", F.when(F.col("id") == n - 1, 1.0).otherwise(0.0).alias("x"))
    assert [tuple(r) for r in usage.blended(rows, "user", "id", "x").collect()] == [("u", 0.5)]
    few = spark.createDataFrame([("a", 2, 4.0), ("a", 1, 2.0), ("b", 1, 7.0), ("a", 3, 5.0)], "user string, id int, x double")
    assert {tuple(r) for r in usage.blended(few, "user", "id", "x").collect()} == {("a", 4.0), ("b", 7.0)}

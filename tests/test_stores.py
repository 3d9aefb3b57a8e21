"""Queues, the shelf's files, streams with state, values over time."""

import json
import random
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessel.functions.register import register
from tessel.operators import history, worklog
from tessel.plans import stores
from tessel.scratch import folder
from tessel.sources import shelf_source, workbook
from tessel.streaming import state, stream

# Queues


def texts(spark, n, first=0):
    return spark.createDataFrame([(i, f"t{i}") for i in range(first, first + n)], "k long, body string")


def calls_of(at):
    import os

    return sorted(line for f in os.listdir(at) for line in open(f"{at}/{f}").read().split())


def counting(at):
    """A service that notes every text it answers."""
    import os
    import uuid

    os.makedirs(at)

    def answer(batch):
        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(batch))
        return [[float(len(t))] for t in batch]

    return answer


def test_a_killed_pass_goes_on_and_does_each_row_once(spark, tmp_path):
    at, service = folder(spark), counting(str(tmp_path / "calls"))
    assert worklog.add(texts(spark, 40), at, "k", "body", size=8) == 40
    assert worklog.run(spark, at, service, most=2) == {"committed": 2, "failed": 0, "lost": 0}
    before = calls_of(str(tmp_path / "calls"))

    def fault(batch):
        raise RuntimeError("a fault of the code")

    with pytest.raises(Exception, match="a fault of the code"):
        worklog.run(spark, at, fault)
    assert worklog.results(spark, at).count() == len(before) and worklog.history(spark, at).agg(F.max("failed")).first()[0] == 0
    assert worklog.add(texts(spark, 45), at, "k", "body", size=8) == 5
    worklog.run(spark, at, service)
    assert calls_of(str(tmp_path / "calls")) == sorted(f"t{i}" for i in range(45))
    assert sorted(int(r.key) for r in worklog.results(spark, at).collect()) == list(range(45)) and worklog.pending(spark, at).count() == 0
    assert worklog.run(spark, at, service) == {"committed": 0, "failed": 0, "lost": 0}


def test_failures_are_counted_over_the_queue_and_passes(spark):
    at = folder(spark)
    worklog.add(texts(spark, 60), at, "k", "body", size=10)

    def down(batch):
        raise worklog.Unavailable

    assert worklog.run(spark, at, down, most=2)["failed"] == 2
    assert worklog.run(spark, at, down)["failed"] == 1  # the third in a row stops the queue
    assert worklog.run(spark, at, down) == {"committed": 0, "failed": 0, "lost": 0}
    assert worklog.pending(spark, at).count() == 60
    worklog.resume(spark, at)
    half = lambda batch: [[1.0] if int(t[1:]) % 2 else None for t in batch]
    worklog.run(spark, at, half, failures=100)
    assert worklog.results(spark, at).count() == 30 and worklog.pending(spark, at).count() == 30
    worklog.resume(spark, at)
    worklog.run(spark, at, lambda batch: [[2.0] for _ in batch])
    got = {int(r.key): r.vector[0] for r in worklog.results(spark, at).collect()}
    assert got == {i: 1.0 if i % 2 else 2.0 for i in range(60)}
    assert worklog.results(spark, at).count() == 60


def test_many_batches_take_few_jobs_and_commits(spark):
    at = folder(spark)
    worklog.add(texts(spark, 400), at, "k", "body", size=4)
    odd = lambda batch: [None if t == "t77" else [1.0] for t in batch]
    assert worklog.run(spark, at, odd)["failed"] == 1
    assert worklog.history(spark, at).count() < 12
    assert worklog.results(spark, at).count() == 399 and [r.key for r in worklog.pending(spark, at).collect()] == ["77"]
    worklog.run(spark, at, lambda batch: [[2.0] for _ in batch])
    assert worklog.results(spark, at).filter("vector[0] = 2.0").count() == 1 and worklog.results(spark, at).count() == 400


def test_of_two_passes_one_commits_a_batch(spark):
    at = folder(spark)
    worklog.add(texts(spark, 5), at, "k", "body")
    outer = []

    def slow(path):
        worklog.run(spark, path, lambda batch: [[1.0] for _ in batch])

    real = worklog._called

    def called(rows, embed, call, failures):
        made = real(rows, embed, call, failures)
        if not outer:
            outer.append(1)
            slow(at)  # the other pass is done before this one commits
        return made

    worklog._called = called
    try:
        assert worklog.run(spark, at, lambda batch: [[2.0] for _ in batch])["lost"] == 1
    finally:
        worklog._called = real
    assert {r.vector[0] for r in worklog.results(spark, at).collect()} == {1.0} and worklog.results(spark, at).count() == 5


def test_an_empty_queue(spark):
    at = folder(spark)
    assert worklog.add(texts(spark, 0), at, "k", "body") == 0
    assert worklog.run(spark, at, lambda batch: []) == {"committed": 0, "failed": 0, "lost": 0}
    assert worklog.results(spark, at).count() == 0 and worklog.pending(spark, at).count() == 0
    odd = spark.createDataFrame([(None, "x"), (1, None), (2, "a"), (2, "b")], "k long, body string")
    assert worklog.add(odd, at, "k", "body") == 2


# The shelf's files


def test_kinds_failures_and_charsets(spark, tmp_path):
    shelf_source.register(spark)
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.TXT").write_bytes("one\r\ntwo\rthree\n\nfive".encode())
    (tmp_path / "sub dir" / "b.md").write_bytes("規程の本文です\n第二条".encode("cp932"))
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbf" + "é,1\n".encode())
    (tmp_path / "d.xlsx").write_bytes(workbook.made({"S & <1>": [["x", "", "z"], [], ["ü\"'<&>"]], "T": []}))
    (tmp_path / "e.xlsx").write_bytes(b"PK no zip")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.txt").write_bytes(b"")
    (tmp_path / "h.exe").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "i.xlsm", "w") as z:
        z.writestr("xl/workbook.xml", "<workbook>")
    rows = spark.read.format("shelf").option("path", str(tmp_path)).load()
    got = {(r.name, r.unit, r.row, r.line) for r in rows.filter("error IS NULL").collect()}
    lines = [("a.TXT", n, x) for n, x in enumerate(["one", "two", "three", "", "five"], 1)] + [("b.md", 1, "規程の本文です"), ("b.md", 2, "第二条"), ("c.csv", 1, "é,1")]
    assert got == {(f, None, n, x) for f, n, x in lines} | {("d.xlsx", "S & <1>", 1, "[A1]x\t[C1]z"), ("d.xlsx", "S & <1>", 3, "[A3]ü\"'<&>")}
    assert {r.name for r in rows.filter("error IS NOT NULL").collect()} == {"e.xlsx", "f.pdf", "i.xlsm"}
    assert {r.name for r in spark.read.format("shelf").option("path", str(tmp_path)).option("kind", "text").load().collect()} == {"a.TXT", "b.md", "c.csv"}
    assert spark.read.format("shelf").option("path", str(tmp_path / "nowhere")).load().count() == 0


def test_a_sheet_beyond_a_million_rows_is_whole():
    book = workbook.made({"S": [["x"]] * 1_000_100})
    assert sum(1 for _ in workbook.lines(book)) == 1_000_100


def test_inboxes_are_read_once(spark, tmp_path):
    import os

    shelf_source.register(spark)
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
    put = lambda name, text, at: ((tmp_path / name).write_text(text), os.utime(tmp_path / name, (at, at)))
    put("one/a.txt", "1\n", 100)
    put("two/b.txt", "2\n", 100)
    source = spark.readStream.format("shelf").option("path", f"{tmp_path}/one,{tmp_path}/two").load()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: source.select("line").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start().awaitTermination()
    read = lambda: sorted(r.line for r in spark.read.schema("line string").parquet(out).collect())
    run()
    assert read() == ["1", "2"]
    put("one/c.txt", "3\n", 100)  # as old as the last one seen
    put("two/d.txt", "4\n4\n", 200)
    run()
    run()
    assert read() == ["1", "2", "3", "4", "4"]


# State


def turns(spark, tmp_path, batches):
    at = str(tmp_path / "turns")
    day = datetime(2024, 1, 1)
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, c, day + timedelta(minutes=m)) for k, c, m in rows], "k string, c string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{at}/b{i}")
    s = state.session_for_state(spark)
    return s.readStream.schema("k string, c string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(at)


def test_chunks_are_forgotten_when_a_session_ends(spark, tmp_path):
    s = turns(spark, tmp_path, [[("a", "x", 0), ("a", "x", 10), ("b", "x", 5), (None, "x", 1)], [("a", "y", 35), ("a", "x", 36)], [("a", "x", 80), ("a", "y", 81), ("a", "y", 82)]])
    got = {(r.k, r.c, r.ts.hour * 60 + r.ts.minute): r.seen_before for r in stream.drained(state.used_chunks(s, "k", "c", "ts")).collect()}
    assert got == {("a", "x", 0): False, ("a", "x", 10): True, ("b", "x", 5): False, ("a", "y", 35): False, ("a", "x", 36): True, ("a", "x", 80): False, ("a", "y", 81): False, ("a", "y", 82): True}


def test_state_shrinks_when_nonces_expire(spark, tmp_path):
    many = [(f"k{i % 5}", f"n{i}", i % 30) for i in range(200)]
    s = turns(spark, tmp_path, [many, [("k0", "n0", 40), ("k0", "late", 200)], [("k1", "n1", 5000)], [("k1", "n1", 5001)]])
    at = folder(spark)
    q = state.remembered(s, "k", "c", "ts", 60).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress) if p["stateOperators"]]
    got = spark.read.parquet(f"{at}/out")
    assert got.count() == 200 + 1 + 1 and got.filter("c = 'n1'").count() == 2
    assert max(sizes) >= 200 and sizes[-1] < 20, sizes


def test_state_of_nonces_has_a_row_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "NONCES", 16)
    many = [(f"k{i}", c, m) for i in range(1000) for c, m in (("n", 0), (" N ", 20), ("", 5))]
    s = turns(spark, tmp_path, [many, [("k1", "n", 60), ("k2", "n\t", 61), ("k3", "m", 61)], [("z", "n", 1000)], [("z", "n", 1001)]])
    at = folder(spark)
    q = state.remembered(s, "k", "c", "ts", 60).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress) if p["stateOperators"]]
    got = sorted((r.k, r.c, r.ts.hour * 60 + r.ts.minute) for r in spark.read.parquet(f"{at}/out").collect())
    assert got == sorted([*((f"k{i}", "n", 0) for i in range(1000)), ("k2", "n\t", 61), ("k3", "m", 61), ("z", "n", 16 * 60 + 40)])
    assert 0 < max(sizes) <= 16 and sizes[-1] <= 1, sizes


def test_state_has_as_many_stores_as_the_session_has_partitions(spark, tmp_path):
    names = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("3", "Asia/Tokyo"), strict=True):
            spark.conf.set(n, v)
        s = state.session_for_state(spark)
        assert [s.conf.get(n) for n in names] == ["3", "Asia/Tokyo"] and s.conf.get("spark.sql.streaming.stateStore.providerClass") == state.STORE
        spark.conf.set(names[1], before[names[1]])
        rows = turns(spark, tmp_path, [[("a", "x", 0), ("a", " X", 10), (None, "x", 1), ("b", None, 1), ("c", "", 1), ("a", "x", 61)], [("a", "x", 60), ("b", "x", 62)]])
        at = folder(spark)
        q = state.remembered(rows, "k", "c", "ts", 60).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        told = [p["stateOperators"][0] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress) if p["stateOperators"]]
        assert {x["numShufflePartitions"] for x in told} == {3} == {x["numStateStoreInstances"] for x in told}, told
        assert sorted((r.k, r.c, r.ts.hour * 60 + r.ts.minute) for r in spark.read.parquet(f"{at}/out").collect()) == [("a", "x", 0), ("a", "x", 61), ("b", "x", 62)]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_sessions_meet_across_batches_and_late_rows(spark, tmp_path):
    s = turns(spark, tmp_path, [[("a", "", 0), ("a", "", 50)], [("a", "", 25), ("b", "", 60)], [("z", "", 1000)], [("z", "", 1001)], [("a", "", 2), ("z", "", 5000)]])
    got = {(r.k, r.opened.hour * 60 + r.opened.minute, r.closed.hour * 60 + r.closed.minute, r.n) for r in stream.drained(state.lapsed(s, "k", "ts", 30, "100 minutes")).collect()}
    assert {x for x in got if x[0] in "ab"} == {("a", 0, 50, 3), ("b", 60, 60, 1)}


def test_state_of_sessions_has_a_row_a_bucket(spark, tmp_path):
    many = [(f"k{i}", "c", 0) for i in range(5000)]
    s = turns(spark, tmp_path, [many, [("k1", "c", 10), ("k4999", "d", 20)], [("z", "c", 1000)], [("z", "c", 1001)]])
    at = folder(spark)
    q = state.lapsed(s, "k", "ts", 30, "10 minutes").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress) if p["stateOperators"]]
    got = {r.k: (r.closed.hour * 60 + r.closed.minute, r.n) for r in spark.read.parquet(f"{at}/out").collect()}
    assert len(got) == 5000 and got["k1"] == (10, 2) and got["k4999"] == (20, 2) and got["k7"] == (0, 1)
    assert 1 < max(sizes) <= state.BUCKETS and sizes[-1] == 1, sizes


# Values over time


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_brute_force(spark, strict):
    r = random.Random(1)
    rows = lambda n, first: [(r.choice(["hot", "hot", "hot", "b", None, f"k{r.randrange(9)}"]), r.choice([None, *range(60)]), first + i) for i in range(n)]
    left, right = rows(300, 0), list({(k, t): (k, t, i) for k, t, i in rows(80, 1000)}.values())
    l = spark.createDataFrame(left, "k string, t int, id long")
    v = spark.createDataFrame([(k, t, i, f"v{i}") for k, t, i in right], "k string, t int, value long, name string")
    got = {x.id: (x.value, x.name) for x in history.as_of(l, v, "k", "t", ["value", "name"], strict, size=16).collect()}
    for k, t, i in left:
        before = [(t2, i2) for k2, t2, i2 in right if None not in (k, t, k2, t2) and k2 == k and (t2 < t if strict else t2 <= t)]
        assert got[i] == ((max(before)[1], f"v{max(before)[1]}") if before else (None, None)), (k, t)
    assert len(got) == 300 and history.as_of(l.limit(0), v, "k", "t", ["value", "name"]).count() == 0
    assert history.as_of(l, v.limit(0), "k", "t", ["value", "name"]).filter("value IS NOT NULL").count() == 0


def test_sketches_merge_to_what_one_sketch_of_all_gives(spark):
    e = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 40).alias("day"), (F.col("id") % 7001).alias("who"), F.col("id").cast("double").alias("x"))
    merged = history.estimated(history.merged(history.sketched(e, ["k", "day"], F.col("who"), F.col("x")), ["k"]), ["k"]).collect()
    assert {r.k: r.n for r in merged} == {0: 6667, 1: 6667, 2: 6666}
    for r in merged:
        assert abs(r.distinct - 5000) < 0.05 * 5000 or r.distinct <= 7001
        assert abs(r.q50 - 10_000) < 0.02 * 20_000 and abs(r.q90 - 18_000) < 0.02 * 20_000


def test_vector_sums_refuse_what_they_cannot_sum(spark):
    register(spark)
    spark.createDataFrame([(1, [1.0, 2.0]), (1, None), (1, [3.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0])], "k int, v array<double>").createOrReplaceTempView("_vs")
    got = {r.k: (r.n, r.total) for r in spark.sql("SELECT * FROM vector_sums(TABLE(_vs) PARTITION BY (k), 'k', 'v')").collect()}
    assert got[2] == (1, [0.0, 0.0]) and got[None] == (1, [1.0, 1.0]) and got[1][0] == 1
    with pytest.raises(Exception, match="vector_sums"):
        spark.sql("SELECT * FROM vector_sums(TABLE(_vs) PARTITION BY (k), 'k', 'nothing')").collect()
    assert spark.sql("SELECT vector_sum(v) AS s FROM _vs WHERE k IS NULL OR k = 2").first().s == [1.0, 1.0]


def test_files_of_a_shelf_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PIECE", 300)
    monkeypatch.setattr(shelf_source, "SMALL", 200)
    rows = [(i, None if i % 50 == 0 else f"text {i}\t\n" + "x" * (i % 40)) for i in range(1200)]
    d, at = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "shelf")
    stores.shelved(d, at)
    plain = [p for p in Path(at).rglob("*") if p.suffix in (".txt", ".MD", ".csv") and p.is_file()]
    assert len({p.name for p in plain}) == 18 and max(p.stat().st_size for p in plain) < 900
    shelf_source.register(spark)
    read = stores.parsed(spark.read.format("shelf").option("path", at).load())
    assert sorted(map(tuple, read.collect())) == [(i, t or "") for i, t in rows]
    sheets = stores.parsed(workbook.sheet_lines(spark, at).withColumn("kind", F.lit("workbook")), "sheet")
    assert {(r.doc_id, r.sheet) for r in sheets.collect()} == {(i, ("First", "Second & last")[i // 24 % 2]) for i, _ in rows if i % 24 % 4 == 2}

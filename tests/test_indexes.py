"""Indexes, links by pivots, neighbours in parts, versioned tables, against brute force and in defined cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import index, links, rank, retrieve, signs
from tessel.scratch import folder
from tessel.sources import versions

# Inverted index


def texts(seed, n):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "日本", "x1"]
    return [(i, " ".join(r.choices(words, [40, 10, 5, 2, 1, 2, 1], k=r.randrange(60)))) for i in range(n)]


def scores(rows, question, k):
    """The term score of distinct words, from its formula."""
    import re

    held = {i: Counter(re.findall("[0-9a-z]+", (t or "").lower()) + ["日本"] * (t or "").count("日本")) for i, t in rows}
    n, avg = len(held), sum(sum(c.values()) for c in held.values()) / max(1, len(held))
    out = []
    for i, c in held.items():
        s = 0.0
        for w in sorted(set(question)):
            df = sum(w in x for x in held.values())
            if c[w]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
        if s:
            out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def close(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_index_equals_the_formula_and_skips_blocks(spark):
    rows = [(i, t.replace("日本", "x1")) for i, t in texts(1, 600)] + [(1000, None), (1001, ""), (None, "alpha alpha")]
    df = spark.createDataFrame(rows, "k long, body string")
    at, told = folder(spark), []
    index.build(df, "k", T.tokens("body"), at, block=16)
    known = [r for r in rows if r[0] is not None]
    for question, k in ((["eps"], 5), (["alpha", "eps", "alpha"], 7), (["delta", "nowhere"], 50), (["alpha"], 2000)):
        close([tuple(r) for r in index.search(spark, at, question, k, "k", told=told.append).collect()], scores(known, question, k))
    assert any(t["read"] < t["blocks"] / 2 for t in told), told
    assert index.search(spark, at, ["nowhere"], 3).collect() == [] and index.search(spark, at, [], 3).collect() == []


def test_updates_equal_a_rebuild(spark):
    rows = dict((i, t.replace("日本", "x1")) for i, t in texts(2, 120))
    frame = lambda x: spark.createDataFrame(list(x), "k long, body string")
    at = folder(spark)
    index.build(frame(rows.items()), "k", T.tokens("body"), at, block=8)
    r = random.Random(3)
    for step in range(3):
        changed = {i: " ".join(r.choices(["alpha", "eps", "new"], k=5)) for i in (*r.sample(sorted(rows), 9), 500 + step)}
        removed = [i for i in r.sample(sorted(rows), 7) if i not in changed]
        index.update(at, frame(changed.items()), "k", T.tokens("body"), removed=frame((i, "") for i in removed), block=8)
        rows = {i: t for i, t in (rows | changed).items() if i not in removed}
        close([tuple(x) for x in index.search(spark, at, ["eps", "new"], 15, "k").collect()], scores(rows.items(), ["eps", "new"], 15))
    old = index.search(spark, at, ["eps"], 200, version=1).collect()
    index.compact(spark, at, block=8)
    close([tuple(x) for x in index.search(spark, at, ["eps", "alpha"], 15, "k").collect()], scores(rows.items(), ["eps", "alpha"], 15))
    assert {x.key for x in index.live(spark, at).collect()} == set(rows)
    assert [tuple(x) for x in index.search(spark, at, ["eps"], 200, version=1).collect()] == [tuple(x) for x in old]


def test_index_of_an_empty_table_and_repeated_keys(spark):
    at = folder(spark)
    index.build(spark.createDataFrame([], "k long, body string"), "k", T.tokens("body"), at)
    assert index.search(spark, at, ["a"], 3).collect() == []
    index.update(at, spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b")], "k long, body string"), "k", T.tokens("body"))
    assert [r.key for r in index.search(spark, at, ["b"], 3).collect()] == [2, 1]


def plans_of(part, monkeypatch):
    plans, real = [], DataFrameWriter.parquet

    def spied(self, path, *a, **b):
        if part in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    return plans


def test_rows_of_postings_move_once_and_are_gathered_after_it(spark, monkeypatch):
    plans, at = plans_of("/postings", monkeypatch), folder(spark)
    index.build(spark.createDataFrame(texts(5, 50), "k long, body string"), "k", T.tokens("body"), at, block=8)
    index.update(at, spark.createDataFrame(texts(6, 9), "k long, body string"), "k", T.tokens("body"), block=8)
    index.compact(spark, at, block=8)
    assert len(plans) == 3
    for plan in plans:
        above, _, below = plan.partition("Exchange rangepartitioning(term")
        assert below and "Exchange" not in above + below and "ObjectHashAggregate" in above and "Aggregate" not in below, plan


def test_lists_are_those_of_the_documents(spark):
    at = folder(spark)
    index.build(spark.createDataFrame(texts(7, 90), "k long, body string"), "k", T.tokens("body"), at, block=8)
    segment = f"{at}/{index._segments(spark, at)[0][0]}"
    docs, want = spark.read.parquet(f"{segment}/docs").collect(), {}
    for d in docs:
        assert d.dl == sum(x.tf for x in d.terms)
        for x in d.terms:
            want.setdefault((x.term, d.block), []).append((d.key, x.tf, d.dl))
    got = spark.read.parquet(f"{segment}/postings").collect()
    assert {(r.term, r.block): list(zip(r.keys, r.tfs, r.dls, strict=True)) for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    assert all((r.n, r.tf, r.dl) == (len(r.keys), max(r.tfs), min(r.dls)) for r in got)
    assert max(Counter(d.block for d in docs).values()) <= 8


def test_compaction_takes_terms_as_they_are(spark, monkeypatch):
    rows = [(1, "alpha beta alpha"), (1, "alpha beta alpha"), (2, None), (3, ""), (None, "beta"), (4, "beta gamma"), (5, "gamma")]
    frame = lambda x: spark.createDataFrame(x, "k long, body string")
    at, calls, real = folder(spark), [], index.counted
    index.build(frame(rows), "k", T.tokens("body"), at)
    index.update(at, frame([(4, "alpha"), (6, None), (None, "alpha"), (7, "beta"), (7, "beta")]), "k", T.tokens("body"), removed=frame([(5, ""), (None, ""), (5, ""), (99, "")]))
    before = [tuple(r) for r in index.search(spark, at, ["alpha", "beta", "gamma"], 9).collect()]
    monkeypatch.setattr(index, "counted", lambda t: (calls.append(t), real(t))[1])
    index.compact(spark, at)
    assert not calls
    assert [tuple(r) for r in index.search(spark, at, ["alpha", "beta", "gamma"], 9).collect()] == before
    close(before, scores([(1, "alpha beta alpha"), (2, None), (3, ""), (4, "alpha"), (6, None), (7, "beta")], ["alpha", "beta", "gamma"], 9))
    assert {(r.key, r.dl) for r in index.live(spark, at).collect()} == {(1, 3), (2, 0), (3, 0), (4, 1), (6, 0), (7, 1)}


def test_an_update_looks_up_removed_documents_of_its_keys_only(spark, monkeypatch):
    frame = lambda x: spark.createDataFrame(x, "k long, body string")
    plans, at = plans_of("/removed-", monkeypatch), folder(spark)
    index.build(frame([(i, "alpha beta") for i in range(30)]), "k", T.tokens("body"), at)
    index.update(at, frame([(1, "beta"), (None, "beta"), (40, None)]), "k", T.tokens("body"), removed=frame([(2, ""), (2, ""), (None, "")]))
    index.update(at, frame([(1, "gamma"), (2, "gamma"), (3, None), (3, None)]), "k", T.tokens("body"), removed=frame([(40, "")]))
    assert 0 < plans[1].index("LeftAnti") < plans[1].index("LeftSemi"), plans[1]
    gone = [{(r.key, r.dl) for r in spark.read.parquet(f"{at}/{x}").collect()} for x in index._segments(spark, at)[1]]
    assert gone == [{(1, 2), (2, 2)}, {(1, 1), (3, 2), (40, 0)}]
    left = [(i, "alpha beta") for i in range(30) if i not in (1, 2, 3)] + [(1, "gamma"), (2, "gamma"), (3, None)]
    close([tuple(r) for r in index.search(spark, at, ["beta", "gamma"], 50).collect()], scores(left, ["beta", "gamma"], 50))
    assert sorted(r.key for r in index.live(spark, at).collect()) == list(range(30))


# Sign bits


@pytest.mark.parametrize(("dim", "n"), [(64, 400), (20, 300), (5, 60)])
def test_sign_index_equals_a_scan(spark, dim, n):
    r = np.random.default_rng(dim)
    centre = r.normal(size=(6, dim))
    rows = [(i, [float(x) for x in centre[i % 6] + 0.4 * r.normal(size=dim)]) for i in range(n)] + [(n, None), (n + 1, []), (n + 2, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    at, told = folder(spark), []
    signs.build(df, "k", "v", at)
    asked = df.filter("k < 5")
    got = signs.nearest(spark.read.parquet(at), signs.coded(asked, "k", "v").withColumnRenamed("key", "query"), 7, told=told).collect()
    for k, q in rows[:5]:
        want = sorted((sum((a >= 0) != (b >= 0) for a, b in zip(v, q, strict=True)), i) for i, v in rows[:n])[:7]
        assert [(x.distance, x.key) for x in sorted((x for x in got if x.query == k), key=lambda x: x.rank)] == want
    if dim == 64:
        assert sum(t["met"] for t in told) < 0.6 * 5 * n, told
    few = signs.nearest(spark.read.parquet(at), signs.coded(df.filter(f"k = {n + 2}"), "k", "v").withColumnRenamed("key", "query"), 7).collect()
    assert [(x.key, x.distance) for x in few] == [(n + 2, 0)]
    assert signs.nearest(spark.read.parquet(at), signs.coded(df.limit(0), "k", "v").withColumnRenamed("key", "query"), 7).collect() == []


def test_words_of_many_queries_are_not_broadcast(spark, monkeypatch):
    centre = np.random.default_rng(9).normal(size=(6, 32))
    df = spark.createDataFrame([(i, centre[i % 6].tolist()) for i in range(60)], "k long, v array<double>")
    at, plans, real = folder(spark), [], signs.written
    signs.build(df, "k", "v", at)
    monkeypatch.setattr(signs, "written", lambda d, name: (plans.append(d._jdf.queryExecution().executedPlan().toString()) if name == "sign-met" else None, real(d, name))[1])
    assert signs.nearest(spark.read.parquet(at), signs.coded(df, "k", "v").withColumnRenamed("key", "query"), 3).count() == 180
    looked = [p for p in plans if "SortMergeJoin" in p or "bitwise" in p or "flip" in p]
    assert looked and not any("BroadcastHashJoin" in p for p in looked), plans[0]


def test_copies_in_cells_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(unit_rows(4, 60, 8, 3))], "k long, v array<double>")
    plan = links.nearest_by_pivots(df, "k", "v", 2, least=40)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan


# Links


def unit_rows(seed, n, dim, groups):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim))
    v = centre[r.integers(groups, size=n)] + 0.25 * r.normal(size=(n, dim))
    v[: n // 6] = v[0]  # copies
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("least", [None, 90, 20])
def test_links_by_pivots_equal_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(links, "TILE_ROWS", 20)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(unit_rows(4, 240, 10, 12))], "k long, v array<double>").unionByName(spark.createDataFrame([(999, None)], "k long, v array<double>"))
    told = []
    got = {tuple(r) for r in links.nearest_by_pivots(df, "k", "v", 4, 6, least, told=told.append).collect()}
    assert got == {tuple(r) for r in links.nearest_centroids(df.filter("v IS NOT NULL"), "k", "v", 4, 6, least).collect()}
    if least == 90:
        assert told[0]["compared"] < told[0]["of"] / 3, told
    assert links.nearest_by_pivots(df.limit(0), "k", "v", 4).collect() == []
    assert links.nearest_by_pivots(df.filter("k = 3"), "k", "v", 4).collect() == []


def test_pairs_of_evenly_spread_vectors_stay_in_their_blocks(spark, monkeypatch):
    kept, real = [], links.written

    def spied(d, name="table"):
        out = real(d, name)
        if name == "met":
            kept.append(out.count())
        return out

    monkeypatch.setattr(links, "TILE_ROWS", 100)
    monkeypatch.setattr(links, "written", spied)
    r = np.random.default_rng(11)
    v = r.normal(size=(400, 24))
    v[:150] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "k long, v array<double>")
    got = {tuple(x) for x in links.nearest_by_pivots(df, "k", "v", 3, 6, 1, told=lambda t: None).collect()}
    assert got == {tuple(x) for x in links.nearest_centroids(df, "k", "v", 3, 6, 1).collect()}
    assert kept[0] <= 400 * 3 + 40, kept  # all pairs are 159,600; a row a task tells how many were compared


def test_sims_at_a_half_and_keys_of_words(spark, monkeypatch):
    monkeypatch.setattr(links, "TILE_ROWS", 30)
    r = np.random.default_rng(12)
    rows = [(f"k{i:03d}é"[: 3 + i % 3] + str(i), x.tolist()) for i, x in enumerate(r.choice([-0.125, 0.125], size=(120, 64)))]  # sims are multiples of 1/32
    df = spark.createDataFrame(rows, "k string, v array<double>")
    for least in (None, 5):
        got = {tuple(x) for x in links.nearest_by_pivots(df, "k", "v", 5, 4, least).collect()}
        assert got == {tuple(x) for x in links.nearest_centroids(df, "k", "v", 5, 4, least).collect()}, least


def test_a_component_that_is_no_number_costs_no_other_row_its_links(spark):
    rows = [(i, v) for i, v in enumerate(unit_rows(4, 60, 8, 3))]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    odd = spark.createDataFrame([(100, [float("nan")] * 8), (101, [None] * 8)], "k long, v array<double>")
    got = {tuple(x) for x in links.nearest_by_pivots(df.unionByName(odd), "k", "v", 2, 6, 40).collect()}
    assert got == {tuple(x) for x in links.nearest_centroids(df, "k", "v", 2, 6, 40).collect()}


def test_kmeans_samples_keys_of_one_remainder(spark):
    rows = [(i * 1000 + 1, v) for i, v in enumerate(unit_rows(5, 900, 6, 3))]
    got = links.kmeans(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v")
    assert got.select("cluster").distinct().count() > 1


# Neighbours


@pytest.mark.parametrize(("radius", "size"), [(0, 3), (1, 1), (2, 7), (5, 5), (3, 1000)])
def test_neighbours_in_parts_equal_the_window(spark, radius, size):
    r = random.Random(radius)
    rows = [("hot" if r.random() < 0.6 else f"s{r.randrange(40)}", i, r.random() < 0.1) for i in range(400)] + [("lonely", 1000, True), (None, 1001, None)]
    df = spark.createDataFrame(rows, "source string, ord long, hit boolean")
    got = rank.neighbours_in_parts(df, F.col("hit"), "source", ["ord"], radius, size)
    want = rank.neighbours(df, F.coalesce(F.col("hit"), F.lit(False)), "source", ["ord"], radius)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert rank.neighbours_in_parts(df.limit(0), F.col("hit"), "source", ["ord"], radius, size).collect() == []


# Versions


def test_two_writers_one_wins_and_readers_keep_their_version(spark):
    at = folder(spark)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, at)
    rows = lambda n: spark.range(n).withColumnRenamed("id", "n")
    assert versions.publish(rows(3), at) == 1
    pinned = versions.read(spark, at)
    assert versions.publish(rows(5), at, expected=1) == 2
    with pytest.raises(versions.Conflict):
        versions.publish(rows(7), at, expected=1)
    assert versions.read(spark, at).count() == 5 and pinned.count() == 3 and versions.read(spark, at, 1).count() == 3
    calls = []

    def slow(df):
        if not calls:
            versions.publish(rows(9), at)  # another writer comes first
        calls.append(df.count())
        return df.filter("n % 2 = 0")

    assert versions.updated(spark, at, slow) == 4 and calls == [5, 9]
    assert versions.read(spark, at).count() == 5
    assert versions.rolled_back(spark, at, 2) == 5 and versions.read(spark, at).count() == 5
    assert versions.read(spark, at).agg(F.max("n")).first()[0] == 4
    gone = versions.vacuum(spark, at, keep=1)
    assert len(gone) == 3 and versions.read(spark, at).count() == 5 and versions.Log(spark, at).numbers() == [5]


def test_many_writers_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    at = folder(spark)
    log = versions.Log(spark, at)
    add = lambda i: log.committed(lambda p: {"seen": [*(p or {"seen": []})["seen"], i]}, tries=50)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(12)))
    assert sorted(log.payload(log.current())["seen"]) == list(range(12)) and log.current() == 12


def test_prefilter_from_the_index_equals_the_scan(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=32)], i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v array<double>, label int")
    at = folder(spark)
    signs.build(df, "k", "v", at)
    for rescue in (None, F.col("label") == 2):
        got = signs.prefiltered(spark.read.parquet(at), df, rows[0][1], "k", "v", 30, 5, rescue).collect()
        assert got == retrieve.prefiltered(df, rows[0][1], "k", "v", 30, 5, rescue).collect()


def test_kmeans_over_the_table_equals_plain_numpy(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = e.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "embedding", "label").collect()
    unit = np.array([r.embedding[:96] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    points = unit[:400]
    centre = [points[0]]
    while len(centre) < min(7, max(2, int((len(points) / 2) ** 0.5) + 1)):
        centre.append(points[max(range(len(points)), key=lambda i: (min(1 - points[i] @ c for c in centre), -i))])
    centre, before = np.array(centre), None
    for turn in range(12):
        of = [int(np.argmax(centre @ p)) for p in points]
        if turn and of == before:
            break
        before = of
        for j in range(len(centre)):
            mine = [p for p, o in zip(points, of, strict=True) if o == j]
            if mine and np.linalg.norm(np.mean(mine, axis=0)) > 0:
                centre[j] = np.mean(mine, axis=0) / np.linalg.norm(np.mean(mine, axis=0))
    want = {r.vec_id: int(np.argmax(centre @ u)) for r, u in zip(rows, unit, strict=True)}
    got = links.kmeans(e, "vec_id", "embedding")
    assert {r.vec_id: r.cluster for r in got.collect()} == want
    votes = Counter((r.label, want[r.vec_id]) for r in rows)
    best = {s: max((n, -c) for (t, c), n in votes.items() if t == s) for s, _ in votes}
    of_source = links.majority(got.join(e.select("vec_id", F.col("label").alias("source")), "vec_id"), "source", "cluster").collect()
    assert {r.source: (r.cluster, r.votes) for r in of_source} == {s: (-c, n) for s, (n, c) in best.items()}

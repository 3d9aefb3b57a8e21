"""Collocations, source divergence and the grid join against brute force and defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessel.llm import collocations, divergence, grid_join
from tessel.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, phrase int, depth string, n double, term string, seq int"


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, i, "x", 0.5, None, 3) for i, r in enumerate(rows)], DOCS)


# Collocations


def brute_phrases(rows, least, first):
    counts, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in cands.items():
            for s in {p[i:j] for i in range(len(p)) for j in range(i + 1, len(p) + 1)} - {p}:
                longer[s] = max(longer[s], a)
        found = []
        for p, a in cands.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:first]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "über", "d\x01e", "d", "x" * 40, "a-b", "naïve", "zz\x1f", "日本", "#", "$1"]
    weights = [30, 5, 20, 8, 8, 6, 3, 2, 2, 1, 1, 2, 1, 2, 1, 1]
    rows = [(None, "en", "s"), ("", None, None), (" \t ", "en", "s"), ("...", "de", "s"), ("word", "", "s")]
    for i in range(n):
        text = "".join(r.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "!"]) + w for w in r.choices(words, weights, k=r.randrange(120)))
        rows.append((text, r.choice(["en", "en", "de", None, "und", ""]), r.choice("ab")))
    return rows + rows[5:9] * 3


@pytest.mark.parametrize("per_range", [200, 3000, 10**6])
def test_phrases_equal_brute_force_however_many_ranges(spark, per_range):
    rows = prose(1, 150)
    got = collocations.phrases(documents(spark, rows), least=12, first=25, per_range=per_range)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 12, 25)


def test_tries_closed_early_and_very_long_texts(spark, monkeypatch):
    rows = [("alpha beta gamma " * 4000 + "x" * 100 + " alpha beta " * 300, "en", "s"), ("y" * 5000, "en", "s"), *prose(2, 20)]
    want = brute_phrases(rows, 5, 50)
    held = collocations.Shard()
    monkeypatch.setattr(collocations, "CHUNK", 1000)
    parts = [c for c in collocations.chunks(rows[0][0].encode())]
    assert b"".join(parts).decode() == rows[0][0] and len(parts) > 50
    for lang in ("en",):
        held.open[lang] = collocations.words_of(rows[0][0].encode())
        while len(held.open[lang]) > collocations.STEP:
            held.name(lang, False)
        held.name(lang, True)
    ((_, words, keys, n),) = held.closed()
    blob = collocations.serialised(collocations.columns(keys), n, words)
    back, cols, m = collocations.restored(blob)
    assert [[back[i] for i in c] for c in cols] == [[words[i] for i in c] for c in collocations.columns(keys)] and m.tolist() == n.tolist()
    got = collocations.phrases(documents(spark, rows), least=5, first=50, per_range=500)
    assert sorted(map(tuple, got.collect())) == want


def test_no_phrases(spark):
    assert collocations.phrases(documents(spark, [(None, None, None)]).limit(0)).collect() == []
    assert collocations.phrases(documents(spark, [("a b c", "en", "s"), (None, None, None)])).collect() == []


# Divergence


def brute_audit(rows):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= 3)
        v = len(kept)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        all_ = {t: sum(of[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (of[s][t] + 1) // (sum(of[s].values()) + v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (all_[t] + 1) // (sum(all_.values()) + v) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if of[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijkäöé日") for _ in range(r.randrange(1, 6))) for _ in range(700)]
    rows = [(None, None, None), ("", "en", "empty"), ("1 2 3", "xx", "only"), ("Hi! ", "xx", "other"), ("a[b]c`d@E", "en", None)]
    for _ in range(400):
        text = "".join(r.choice([" ", "9", "_", "~"]) + r.choice(vocabulary[: r.choice([5, 50, 700])]) for _ in range(r.randrange(60)))
        rows.append((text.title() if r.random() < 0.2 else text, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "ü", None])))
    rows += rows[10:14] * 5
    got = divergence.audit(documents(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows)


def test_audit_in_blocks_of_sources_and_without_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "CELLS", 8)
    rows = [(f"{'a ' * (i % 3)} b c{'d' * (i % 4)}", "en", f"s{i % 7}") for i in range(40)]
    assert sorted(map(tuple, divergence.audit(documents(spark, rows)).collect())) == brute_audit(rows)
    rows = [("x", "en", "a"), ("y", "en", "b")]
    assert sorted(map(tuple, divergence.audit(documents(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(documents(spark, rows).limit(0)).collect() == []


def test_partial_rows_of_an_audit_do_not_grow_with_partitions(spark, monkeypatch):
    rows = [(f"a b c{'d' * (i % 4)} e{'f' * (i % 9)}", "en", f"s{i % 3}") for i in range(60)]
    tables = {}
    monkeypatch.setattr(divergence, "written", lambda df, name: tables.setdefault((name, spark.conf.get("spark.sql.shuffle.partitions")), written(df, name)))
    held, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, divergence.audit(documents(spark, rows)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == [brute_audit(rows)] * 2
    assert tables["parts", "2"].count() == tables["parts", "40"].count()
    monkeypatch.setattr(divergence, "ROWS", 5)
    assert sorted(map(tuple, divergence.audit(documents(spark, rows)).collect())) == got[0]


def test_shares_of_large_counts_are_exact():
    r = random.Random(4)
    for _ in range(200):
        whole = r.randrange(1, 9 * 10**15)
        n = r.randrange(whole)
        assert divergence.share(np.array([n]), whole)[0] == 1 + 10**9 * (n + 1) // whole


# Grid join


def brute_groups(rows, least=0.95):
    valid = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = defaultdict(set)
    for i, a in valid.items():
        for j, b in valid.items():
            if i < j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                near[i].add(j), near[j].add(i)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()] - group:
                group.add(j)
                stack.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (rows[j][0], len(near[j]), min(ids) if ids else None)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    return sorted(out.values(), key=key)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, 1, "x", 2.0) for k, v in rows], f"vec_id long, embedding array<{kind}>, seq int, cls string, links double")


def grouped(df):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) or r.component_id is None for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=key)


def clustered(seed, n, dim):
    r = np.random.default_rng(seed)
    hot = r.normal(size=dim)
    rows = []
    for i in range(n):
        m = r.integers(5)
        if m == 0:
            v = hot + 0.02 * r.normal(size=dim)
        elif m == 1:
            v = hot
        elif m == 2 and rows:
            v = np.array(rows[int(r.integers(len(rows)))][1]) * 3 + 0.2 * r.normal(size=dim)
        else:
            v = r.normal(size=dim)
        rows.append((int(i), [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize(("block", "dim"), [(16, 16), (7, 3), (1024, 12)])
def test_groups_equal_brute_force(spark, block, dim):
    rows = clustered(5, 400, dim)
    rows += [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [float("nan")] * dim), (1004, [1.0, None]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [float("inf")] * dim), (3, rows[0][1]), (None, rows[1][1]), (None, [5.0])]
    for kind in ("float", "double"):
        got = grid_join.groups(table(spark, rows, kind), block=block)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert grouped(got) == brute_groups(rows)


def test_far_clusters_are_skipped_and_tight_ones_linked_whole(spark):
    r = np.random.default_rng(6)
    centres = np.eye(8)
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.01 * r.normal(size=8)]) for i in range(640)]
    df = table(spark, rows)
    eps, kind = float(np.sqrt(0.1)), grid_join.kind_of(df, "embedding")
    classes = grid_join.vectors_of(df, "vec_id", "embedding").groupBy("cls").agg({"v": "first", "id": "min", "*": "count"}).toDF("cls", "v", "id", "n")
    fitted = grid_join.directions(classes, kind)
    cut = grid_join.blocks(grid_join.in_order(classes, fitted, eps, kind), fitted, 16, kind).cache()
    held = cut.orderBy("part", "at").collect()
    boxes = spark.createDataFrame([(i, b.size, b.size, b.lo, b.hi) for i, b in enumerate(held)], "seq long, size_lo int, size_hi int, lo array<double>, hi array<double>")
    pairs = {tuple(p) for p in grid_join.joined_intervals(boxes, len(held), eps).collect()}
    assert len(pairs) < len(held) * len(held) / 4
    gap = lambda a, b: sum(max(0.0, x - w, z - y) ** 2 for x, y, z, w in zip(a.lo, a.hi, b.lo, b.hi, strict=True))
    assert pairs == {(i, j) for i, a in enumerate(held) for j, b in enumerate(held) if i <= j and gap(a, b) <= 0.1 + grid_join.SLACK}
    assert grouped(grid_join.groups(df, block=16)) == brute_groups(rows)


def test_groups_of_nothing(spark):
    assert grid_join.groups(table(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert grouped(grid_join.groups(table(spark, [(2, None), (1, [0.0])]))) == [(1, 0, 1), (2, 0, 2)]

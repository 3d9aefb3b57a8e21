"""The join against brute force over all pairs."""

import random
from itertools import combinations

from tessel.llm import ngram_join

D = "/root/testdata/sf0.001"


def sets(texts):
    out = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(texts):
    s = sets(texts)
    root = {k: k for k in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(s), 2):
        if s[a] and s[b] and 5 * min(len(s[a]), len(s[b])) >= 4 * max(len(s[a]), len(s[b])):
            both = len(s[a] & s[b])
            if 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in s}


def families(n, size, words, edits, seed=3):
    """Families of copies with a few edited words each, some edits on top of others."""
    r = random.Random(seed)
    out = []
    for f in range(n):
        base = [f"{f}w{r.randrange(10**6)}" for _ in range(words)]
        made = [base]
        for _ in range(size - 1):
            w = list(r.choice(made[:5]))
            for _ in range(r.randrange(edits + 1)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.2:
                w = w[: len(w) - r.randrange(len(w) // 3)]
            made.append(w)
        out += [" ".join(w) for w in made]
    r.shuffle(out)
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = ngram_join.components(df).collect()
    assert {r.doc_id: r.n_shingles for r in rows} == {k: len(v) for k, v in sets(texts).items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(texts)


def test_documents(spark):
    check(spark, {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()})


def test_families_short_texts_and_shared_passages(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = families(3, 40, 120, 4) + families(4, 20, 12, 1, 5) + [passage + f" own {i} tail" for i in range(30)] + [passage + " " + " ".join(f"u{i}x{j}" for j in range(80)) for i in range(30)]
    texts += ["", None, " \t\n", "a b c", "A B\tc", "a b c d e", "a b c d e f", "x", "X", "É x", "é x", "a b c d"]
    check(spark, dict(enumerate(texts)))


def test_null_keys_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (9, "A b c d e f g"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.components(df).collect()), key=str)
    assert got == sorted([(True, 0, 3, None), (True, 0, 0, None), (False, 7, 3, 7), (False, 7, 3, 7), (False, 9, 3, 7)], key=str)
    assert ngram_join.components(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in ngram_join.keep(df).collect()) == [0, 0, 7]


def test_keep_leaves_one_row_of_each_group_where_keys_repeat(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in ngram_join.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept([(2, x), (5, x), (5, y)]) == [(2, x), (5, y)]
    assert kept([(5, y), (5, y), (5, z), (5, " "), (5, None), (5, None)]) == sorted([(5, y), (5, z), (5, " "), (5, None)], key=str)
    near = [(5, y), (5, y + " more"), (5, y + " again"), (5, z)]
    got = kept(near)
    assert len(got) == 2 and (5, z) in got and got == kept(near[::-1])


def test_keep_with_a_hot_key_equals_brute_force(spark):
    texts = dict(enumerate(families(6, 12, 60, 3, 8) + families(8, 1, 60, 0, 9)))
    key = lambda i: 1000 if i % 3 == 0 else i
    rows = [(key(i), t) for i, t in texts.items()]
    groups = {}
    for i, root in brute_components(texts).items():
        groups.setdefault(root, []).append((key(i), texts[i]))
    got = [(r.doc_id, r.text) for r in ngram_join.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(groups)
    for g in groups.values():
        mine = [r for r in got if r in g]
        assert len(mine) == 1 and mine[0][0] == min(k for k, _ in g)

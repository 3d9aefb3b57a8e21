"""Every query with a SQL twin equals it on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tessel.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        import os

        p = f"{D}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T", " ").removesuffix(" 00:00:00")
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(catalog.ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-4)) for a, b in zip(g, w, strict=True))]
    assert not bad, bad[:5]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_checked_answers_has_its_figure(spark, db):
    df = catalog.QUERIES["checked_answers"](spark, D)
    assert df.columns == [c[0] for c in db.execute(catalog.ORACLE["checked_answers"]).description] == ["conv_id", "turn", "answer", "figure"]
    assert df.filter("figure = 12").count() == db.execute("SELECT count(*) FROM conversations").fetchone()[0]


def test_authors_and_sources_says_which_are_named(spark):
    rows_ = catalog.QUERIES["authors_and_sources"](spark, D).select("event_id", "named").collect()
    assert len(rows_) > 100 and all(r.named == (r.event_id % 2 == 0) for r in rows_)


def test_exact_boosts_reads_the_length(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the Apache License", 18), (2, "apache", None), (3, "", -1)], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["exact_boosts"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 6.0, True), (2, 3.0, None), (3, 0.0, False)]

"""The pipeline against plain Python, stage by stage and whole."""

import corpus_pipeline
from test_ngram_join import brute_components
from test_pii_secrets import loose_texts, pii_base, plain_added

from tessel.llm.packing import CAPACITY
from tessel.llm.quality import Bands
from tessel.llm.vocab import byte_bpe, public_path

D = "/root/testdata/sf0.001"


def masked(t, added=()):
    spans, at, out = sorted((s, e, k) for k, s, e in [*pii_base(t), *added]), 0, []
    for s, e, k in spans:
        if s >= at:
            out += [t[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + t[at:]


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    judge, encode = Bands(), byte_bpe(public_path("byte_bpe_50k.json"))
    kept = {k: t for k, t in texts.items() if judge.row(t or "")[6]}
    first = brute_components(kept)
    kept = {k: t for k, t in kept.items() if first[k] == k}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, D)
        assert docs.columns == columns
        if i == 1:
            assert {r.doc_id for r in docs.collect()} == set(kept)
    keys = sorted(kept)
    added = {keys[i]: v for i, v in plain_added([kept[k] for k in keys]).items()}
    out = {r.doc_id: r.text for r in docs.collect()}
    assert set(out) == set(kept)
    for k, t in out.items():
        assert t == masked(kept[k], added.get(k, ()))
    rows = corpus_pipeline.run(spark, D).collect()
    tokens = {k: len(encode(t)) + 1 for k, t in out.items()}
    assert sum(r.length for r in rows) == sum(tokens.values())
    assert {r.doc_id: r.doc_tokens for r in rows} == tokens
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= CAPACITY


def test_personal_data_stage_masks_what_the_method_adds(spark):
    values, _ = loose_texts(150, 3)
    added = plain_added(values)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(values)], "doc_id long, text string, lang string")
    out = corpus_pipeline.STAGES[2][1](spark, docs, D).collect()
    assert sum(map(len, added.values())) > 100
    assert {r.doc_id: r.text for r in out} == {i: masked(t, added.get(i, ())) for i, t in enumerate(values)}


def test_stages_take_nulls_empty_tables_and_other_columns(spark):
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text, "en", 1), (1, text, "en", 1), (2, None, None, 2), (None, text + " more", "x", 3), (3, "", "en", None)], "doc_id long, text string, lang string, kept int")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, D)
            assert table.columns == docs.columns
        n = len(table.collect())
        assert n in (0, 2)
        assert corpus_pipeline.STAGES[-1][1](spark, table, D).count() >= n

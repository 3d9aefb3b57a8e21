"""The queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_kind(kind: str) -> Column:
    """How many of the base spans are of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii
    from .spans import joined

    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[of_kind(k).alias(f"n_{k}") for k in pii.BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.components(table(spark, sf_dir, "documents"))


def op3_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.measure(table(spark, sf_dir, "documents"))


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts
    from .common import written
    from .vocab import public_path

    tokenizer = public_path("byte_bpe_50k.json")
    kept = written(token_counts.trees(table(spark, sf_dir, "documents"), tokenizer), "trees")
    return token_counts.edited(kept, tokenizer, token_counts.usual_edits())


def op5_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing
    from .vocab import public_path

    return packing.sequences(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op7_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_codec
    from .vocab import public_path

    return piece_codec.round_trip(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets
    from .spans import joined

    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [of_kind(k).alias(f"n_{k}") for k, _ in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    placed = sharding.assign(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_grid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import grid_join

    return grid_join.groups(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weak_pii": op1_weak_pii,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_bands": op3_quality_bands,
    "op4_edit_counts": op4_edit_counts,
    "op5_dimension_scan": op5_dimension_scan,
    "op6_cost_packing": op6_cost_packing,
    "op7_url_models": op7_url_models,
    "op8_piece_codec": op8_piece_codec,
    "op9_linked_secrets": op9_linked_secrets,
    "op10_bounded_ring": op10_bounded_ring,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_grid_dedup": op13_grid_dedup,
}

NGRAM_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), l AS (
    SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), r(doc_id, root) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""

SECRETS_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), k(kind, rank, role, pattern) AS (VALUES
    ('assign', 0, 'secret', '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
    ('access', 1, 'identifier', 'AKIA[A-Z0-9]+'),
    ('hex', 2, 'secret', '[0-9a-f]{16,}'),
    ('id', 3, 'identifier', '(?:(?i:client_?id|access_?key(?:_?id)?|account|user(?:name)?|login))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}'),
    ('key', 4, 'secret', '[A-Za-z0-9+/_=-]{16,}'),
    ('short', 5, 'secret', '(?:(?i:password|passwd|pwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
    ('endpoint', 6, 'endpoint', '(?:(?i:(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://|(?:host|endpoint|server)["'']?\x20*[:=]\x20*["'']?))[A-Za-z0-9_.:@-]{3,}')
), f AS (
    SELECT row, kind, rank, role, regexp_extract_all(t, pattern) AS m, list_transform(string_split_regex(t, pattern), lambda x: length(x)) AS gaps FROM d, k WHERE regexp_matches(t, pattern)
), g AS (
    SELECT row, kind, rank, role, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS start FROM f
), v AS (
    SELECT row, kind, rank, role, start::BIGINT AS start, (start + length(m))::BIGINT AS stop, m, length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) AS value FROM g
), b AS (
    SELECT * FROM v WHERE kind = 'assign' AND value >= 12 OR kind = 'access' AND length(m) >= 18 OR kind = 'hex' AND length(m) >= 16
), w AS (
    SELECT * FROM v WHERE (kind IN ('id', 'endpoint') OR kind = 'short' AND value BETWEEN 4 AND 11
        OR kind = 'key' AND length(m) >= 16 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]'))
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.row = v.row AND b.start < v.stop AND v.start < b.stop)
), p AS (
    SELECT * FROM b UNION ALL SELECT * FROM w
), n AS (
    SELECT w.row, w.start, w.rank, w.stop, w.kind, w.role, bool_or(p.role = 'identifier') AS i, bool_or(p.role = 'secret') AS s, bool_or(p.role = 'endpoint') AS e
    FROM w JOIN p ON w.row = p.row AND w.role <> p.role AND abs(w.start - p.start) <= 240 GROUP BY ALL
), a AS (
    SELECT row, start, rank, stop, kind FROM n WHERE role = 'identifier' AND s OR role = 'secret' AND (i OR e) OR role = 'endpoint' AND i AND s
    UNION ALL SELECT row, start, rank, stop, kind FROM b
), o AS (
    SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM a GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (row)
"""

COLLOCATION_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), s AS (
    SELECT row_number() OVER () AS piece, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), w AS (
    SELECT piece, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM s
), x AS (
    SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)
), g AS (
    SELECT lang, 1 AS k, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL
), n AS (
    SELECT lang, count(*)::BIGINT AS n FROM w GROUP BY lang
), f AS MATERIALIZED (
    SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 30
), c AS (
    SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), halves AS (
    SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM (SELECT c.*, unnest(range(1, k)) AS i FROM c)
), cut AS (
    SELECT h.lang, h.phrase, h.a, l.f AS l, r.f AS r, ((2000000::HUGEINT * h.a) // (l.f + r.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY h.lang, h.phrase ORDER BY (2000000::HUGEINT * h.a) // (l.f + r.f), h.i) AS best
    FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.phrase = h.tail
), longer AS (
    SELECT lang, array_to_string(w[s.i:s.i + m.m - 1], ' ') AS phrase, max(a) AS a
    FROM c, (VALUES (2), (3)) AS m(m), (VALUES (1), (2), (3)) AS s(i) WHERE m.m < k AND s.i + m.m - 1 <= k GROUP BY ALL
), kept AS (
    SELECT cut.lang, row_number() OVER (PARTITION BY cut.lang ORDER BY score DESC, cut.a DESC, cut.phrase) AS rank, cut.phrase, cut.a, l, r, score
    FROM cut LEFT JOIN longer x ON x.lang = cut.lang AND x.phrase = cut.phrase WHERE best = 1 AND (x.a IS NULL OR 100 * x.a::HUGEINT < 80 * cut.a)
)
SELECT lang, rank, phrase, a, l, r, n.n AS n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""

DIVERGENCE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), t AS (
    SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
    SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), v AS (
    SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), total AS (
    SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(total.n, 0) + v.v) AS p
    FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
), q AS (
    SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.c + 1)) // (y.n + v.v) AS q
    FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY lang, term) x JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM total GROUP BY lang) y ON x.lang = y.lang JOIN v ON v.lang = x.lang
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

GRID_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings
), l AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.valid AND b.valid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(vec_id, root) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.root FROM r JOIN l ON r.vec_id = l.x
), c AS (
    SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id
), n AS (
    SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x
)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""

ORACLE: dict[str, str] = {"op13_grid_dedup": GRID_SQL, "op2_ngram_join": NGRAM_SQL, "op9_linked_secrets": SECRETS_SQL, "op11_collocations": COLLOCATION_SQL, "op12_source_divergence": DIVERGENCE_SQL}

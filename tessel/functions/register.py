"""register(spark): the engine's functions for SQL. All but fnv1a64, mock_embedding, chunk_text, vector_sum and vector_sums are SQL expressions that the optimizer inlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T_
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessel.functions import text as T
from tessel.functions.python import fnv, mock_embedding
from tessel.operators.ingest import windows


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t") + "'"


FUNCTIONS = {
    "norm_search(s STRING) RETURNS STRING": f"translate(s, {_quoted(T.FOLD_FROM)}, {_quoted(T.FOLD_TO)})",
    "compact(s STRING) RETURNS STRING": "replace(norm_search(s), ' ', '')",
    "norm_hash(s STRING) RETURNS STRING": r"trim(BOTH ' ' FROM regexp_replace(replace(s, '\r\n', '\n'), '[ \t]+', ' '))",
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(a) = size(b) AND size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) ELSE 0D END",
    "hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT": "aggregate(zip_with(a, b, (x, y) -> CAST(bit_count(x ^ y) AS INT)), 0, (s, x) -> s + x)",
    "unit(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "CASE WHEN exists(v, x -> x <> 0) THEN transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y))) END",
    "occurrences(s STRING, k STRING) RETURNS BIGINT": "CAST((length(s) - length(replace(s, k, ''))) / length(k) AS BIGINT)",
    "key_weight(n INT) RETURNS DOUBLE": f"pow(least(n, {T.KEY_LENGTH}), {T.KEY_POWER})",
    "exp_level(e BIGINT) RETURNS BIGINT": "CAST(floor(sqrt(e / 100D)) AS BIGINT) + 1",
    "formula_safe(s STRING) RETURNS STRING": r"CASE WHEN substring(s, 1, 1) IN ('=', '+', '-', '@', '\t', '\r') THEN concat('\'', s) ELSE s END",
    "csv_safe(s STRING) RETURNS STRING": r"""CASE WHEN formula_safe(s) RLIKE '[,"\r\n]' THEN concat('"', replace(formula_safe(s), '"', '""'), '"') ELSE formula_safe(s) END""",
}


@udtf(returnType="seq int, start int, stop int, text string")
class ChunkText:
    """Windows of a text: target and overlap in characters."""

    def eval(self, text: str, target: int, overlap: int):  # noqa: ANN201
        for i, (a, b) in enumerate(windows(text or "", target, overlap)):
            yield i, a, b, text[a:b]


@udtf
class VectorSums:
    """Of each partition of a table with vectors: its value of a column, the number of its vectors, and their sum. Rows without a vector, or with one of another length than the first's, don't count."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, vector: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or key.value not in rows.dataType.names or vector.value not in rows.dataType.names:
            raise ValueError("vector_sums(TABLE(..) PARTITION BY .., key column, vector column)")
        kind = rows.dataType[key.value].dataType
        return AnalyzeResult(T_.StructType([T_.StructField(key.value, kind), T_.StructField("n", T_.LongType()), T_.StructField("total", T_.ArrayType(T_.DoubleType()))]))

    def __init__(self) -> None:
        self.key, self.n, self.total = None, 0, None

    def eval(self, row: Row, key: str, vector: str):  # noqa: ANN201
        self.key, v = row[key], row[vector]
        if v is None or any(x is None for x in v):
            return
        if self.total is None:
            self.total = np.zeros(len(v))
        if len(v) == len(self.total):
            self.n += 1
            self.total += v

    def terminate(self):  # noqa: ANN201
        if self.total is not None:
            yield self.key, self.n, self.total.tolist()


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL in this session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @pandas_udf("string")
    def fnv1a64(s: pd.Series) -> pd.Series:
        return s.map(fnv, na_action="ignore")

    @pandas_udf("array<double>")
    def mock(s: pd.Series, dims: pd.Series) -> pd.Series:
        return pd.Series([mock_embedding(x or "", int(d)) for x, d in zip(s, dims, strict=True)])

    @pandas_udf("array<double>")
    def vector_sum(v: pd.Series) -> list[float]:
        """The sum of a group's vectors; nulls don't count. A group is one task's: sum large ones in parts first, as vector_sums does."""
        held = [np.asarray(x, float) for x in v if x is not None]
        return np.sum(held, axis=0).tolist() if held else None

    spark.udf.register("fnv1a64", fnv1a64)
    spark.udf.register("vector_sum", vector_sum)
    spark.udtf.register("vector_sums", VectorSums)
    spark.udf.register("mock_embedding", mock)
    spark.udtf.register("chunk_text", ChunkText)
    return [h.split("(")[0] for h in FUNCTIONS] + ["fnv1a64", "mock_embedding", "chunk_text", "vector_sum", "vector_sums"]

"""Functions without a column form, in plain Python; Arrow functions wrap them."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Rows in an Arrow batch of whole texts: batches of the usual 10,000 rows hold tens of megabytes each, and several times that as Python strings.
ROWS = "500"


def small_batches(df: DataFrame) -> DataFrame:
    """df; Python functions over its texts get small batches from now on, unless the session sets their size."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    return df


def given_back() -> None:
    """Gives memory that Python no longer needs back to the machine: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, after which the worker gives its memory back."""

    def all_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            given_back()

    return all_rows


def fnv(s: str) -> str:
    """FNV-1a over UTF-16LE, 64 bits, as 16 hex digits."""
    h = 0xCBF29CE484222325
    for b in s.encode("utf-16-le", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & MASK
    return f"{h:016x}"


def fnv1a64(s: Column, upper: bool = False) -> Column:
    """fnv of a text column; an Arrow function, as unsigned products of 64 bits have no column form."""

    @F.pandas_udf("string")
    def hashed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in series:
            yield v.map(fnv, na_action="ignore")
        given_back()

    return F.upper(hashed(s)) if upper else hashed(s)


def mock_embedding(text: str, dims: int) -> list[float]:
    """A unit vector that depends on the text alone: a linear congruential sequence seeded by its hash, in [-1, 1)."""
    #: Multiplier, increment and modulus of the sequence.
    x = float(int(fnv(text)[:13], 16))
    out = []
    for _ in range(dims):
        x = (1664525.0 * x + 1013904223.0) % 4294967296.0
        out.append(x / 2147483648.0 - 1.0)
    n = math.sqrt(sum(v * v for v in out))
    return [v / n for v in out] if n else out

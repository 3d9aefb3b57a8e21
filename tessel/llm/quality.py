"""Quality rules by compression bands.

The zstandard ratio (compressed bytes over bytes) of a whole document and of its fixed chunks says how repetitive
or how random it is. A ratio is only comparable among texts of like length, as a compressor learns while it reads:
hence limits by length. BANDS holds (bytes below which the row holds, lowest and highest whole ratio); a document
outside its band goes, and so does one of which more than MAX_BAD of the chunks lie outside CHUNK_BAND. The
limits stand well off the range that plain prose in several languages takes, so that clean documents stay.

Base rules beside it: at least 50 words, and at most half of the words in three-word windows that recur.

Defined cases: a null text is empty, has no words and fails the base; documents are judged whole, one by one, so
ties and repeated rows need no rule; an empty table gives an empty result; other columns pass through keep()
untouched whatever they are called, and are not read by measure().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import batch, ready, texts, trimmed

LEVEL = 3
CHUNK = 2048
#: Limits of the whole document's ratio, by its bytes.
BANDS = ((512, 0.45, 0.84), (1024, 0.42, 0.76), (2048, 0.37, 0.70), (4096, 0.34, 0.66), (8192, 0.31, 0.62), (float("inf"), 0.28, 0.60))
#: Limits of a chunk's ratio, and the share of chunks that may lie outside.
CHUNK_BAND = (0.34, 0.70)
MAX_BAD = 0.2
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

MEASURES = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64())])


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids)
    keys = (a[:-2] * k + a[1:-1]) * k + a[2:] if k < 2_000_000 else np.unique(np.stack([a[:-2], a[1:-1], a[2:]], 1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


class Bands:
    """Judges texts; one compressor for many of them."""

    def __init__(self) -> None:
        self.z = zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, b: bytes) -> float:
        return len(self.z.compress(b)) / len(b) if b else 0.0

    def verdict(self, b: bytes) -> tuple[float, int, bool]:
        """Ratio of the whole, number of chunks outside the chunk band, and whether the text stays."""
        whole = self.ratio(b)
        low, high = next((low, high) for below, low, high in BANDS if len(b) < below)
        chunks = [b[i : i + CHUNK] for i in range(0, len(b), CHUNK)]
        if len(chunks) > 1 and len(chunks[-1]) < CHUNK // 2:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        bad = sum(not CHUNK_BAND[0] <= self.ratio(c) <= CHUNK_BAND[1] for c in chunks) if len(chunks) > 1 else 0
        return whole, bad, low <= whole <= high and bad <= MAX_BAD * len(chunks)

    def row(self, text: str) -> tuple:
        b = text.encode("utf-8", "replace")
        words = b.split()
        n = len(words)
        chars = len(text) - (len(b) - len(b.translate(None, SPACES)))
        lines = [x for x in b.split(b"\n") if x.strip()]
        repeat = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeat > 50 * n
        whole, bad, good = self.verdict(b)
        return n, chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, good and not failed, whole, bad


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the measures of every row."""
    keyed = ready(docs).select(docs[key].alias("k"), docs[text].alias("t"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Bands()
        for b in batches:
            found = [judge.row(t) for t in texts(b.column(1))]
            yield batch(pa.schema([b.schema.field(0), *MEASURES]), [b.column(0), *(list(c) for c in zip(*found, strict=True))] if found else [b.column(0)] + [[]] * len(MEASURES))

    kind = keyed.schema[0].dataType.simpleString()
    return keyed.mapInArrow(trimmed(rows), f"k {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long").withColumnRenamed("k", key)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    at = ready(docs).columns.index(text)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Bands()
        for b in batches:
            yield b.filter(pa.array([judge.row(t)[6] for t in texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(trimmed(rows), docs.schema)

"""Cost-balanced packing of token sequences.

The cost of a document of n tokens is LINEAR * n + QUADRATIC * n * n: projections and attention within the
document. Documents are cut into pieces of at most `capacity` tokens; a piece that fills a sequence is one. The
rest are dealt into blocks of about BLOCK documents and packed there: in descending order of length, each goes
to the sequence of lowest cost that has room for it, among as many sequences as the block's tokens need. A piece
that fits nowhere is cut to fill the rooms that are left, so a block pads less than one sequence.

Tokens are made once, in the first stage; only the rests carry their ids (16 bits each, 32 where the vocabulary has more than 65,536) into the one shuffle. Blocks
are dealt by a hash of key and row number, so neither a frequent key nor copies crowd a block.

Defined cases: a null text is empty and gives one piece, its end token; repeated rows are packed one by one; ties
go by key, then start, then the lowest sequence; an empty table gives an empty result; other columns are not read.
Strings of the file's added tokens inside a text are those tokens, as tokenizers has it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, ready, texts, trimmed
from .vocab import byte_bpe, encoding

CAPACITY = 1024
BLOCK = 512
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
END = 0
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(piece, its first token, tokens, sequence, offset there), for pieces in descending order of length."""
    n = -(-sum(lengths) // capacity)
    spent, room = np.zeros(n), np.full(n, capacity)
    out = []

    def put(piece: int, first: int, tokens: int, s: int) -> None:
        out.append((piece, first, tokens, s, capacity - int(room[s])))
        room[s] -= tokens
        spent[s] += cost(tokens)

    for piece, tokens in enumerate(lengths):
        s = int(np.argmin(np.where(room >= tokens, spent, np.inf)))
        if room[s] >= tokens:
            put(piece, 0, tokens, s)
            continue
        first = 0
        while first < tokens:
            s = int(np.argmax(room))
            take = min(tokens - first, int(room[s]))
            put(piece, first, take, s)
            first += take
    return out


def id_kind(tokenizer: str) -> str:
    """The type in which ids of a vocabulary travel."""
    return "<u2" if encoding(tokenizer).max_token_value < 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Cut documents: key, start, length, checksum, the document's tokens, ids (null for a piece that fills a sequence), block."""
    blocks = max(1, -(-docs.count() // block))
    dealt = ready(docs).select(F.col(key).alias("k"), F.col(text).alias("t"), F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = byte_bpe(tokenizer), id_kind(tokenizer)
        for b in batches:
            at, cols = [], [[] for _ in range(5)]
            for i, t in enumerate(texts(b.column(1))):
                ids = np.append(encode(t), END).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    at.append(i)
                    for c, v in zip(cols, (start, len(part), zlib.crc32(part.tobytes()), len(ids), None if len(part) == capacity else part.astype(kind).tobytes()), strict=True):
                        c.append(v)
            take = pa.array(at, pa.int32())
            yield batch(pa.schema([b.schema.field(0), b.schema.field(2), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]), [b.column(0).take(take), b.column(2).take(take), *cols])

    return dealt.mapInArrow(trimmed(rows), f"k {dealt.schema[0].dataType.simpleString()}, block int, {PIECES}")


def sequences(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = pieces(docs, tokenizer, key, text, capacity, block)

    def packed(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        n = len(t["start"])
        rows, nth = [], 0
        for i in range(n):
            if t["ids"][i] is None:
                rows.append((i, t["start"][i], capacity, t["ids_crc32"][i], nth, 0))
                nth += 1
        order = sorted((i for i in range(n) if t["ids"][i] is not None), key=lambda i: (-t["length"][i], t["k"][i] is None, t["k"][i] if t["k"][i] is not None else 0, t["start"][i]))
        for piece, first, tokens, s, offset in pack([t["length"][i] for i in order], capacity):
            i = order[piece]
            ids = np.frombuffer(t["ids"][i], id_kind(tokenizer))[first : first + tokens]
            rows.append((i, t["start"][i] + first, tokens, t["ids_crc32"][i] if tokens == t["length"][i] else zlib.crc32(ids.astype("<u4").tobytes()), nth + s, offset))
        at, start, length, crc, seq, offset = ([*c] for c in zip(*rows, strict=True))
        base = t["block"][0] << 24
        take = pa.array(at, pa.int32())
        schema = pa.schema([table.schema.field("k"), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
        cols = [table["k"].combine_chunks().take(take), start, length, crc, [t["doc_tokens"][i] for i in at], [base + s for s in seq], offset]
        return pa.Table.from_batches([batch(schema, [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols])])

    kind = cut.schema[0].dataType.simpleString()
    return cut.groupBy("block").applyInArrow(packed, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("k", key)

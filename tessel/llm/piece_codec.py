"""SentencePiece encoding and decoding: exact merge encoding by backtracking.

Merge encoding is what joining, again and again, the adjacent pair that makes the best scored piece ends with. It is
found here without doing those merges over the text: an Aho-Corasick automaton gives the longest piece at every
position; tokens are laid from left to right; a token may follow another only if merging the two of them anew would
keep the border between them; where none fits, the longest proper prefix is tried, and positions from which the
rest could not be encoded are struck from a bitfield, so no position is tried twice.

Text is cut where no piece reaches across: before each space mark, and at characters outside the vocabulary, which
become bytes. Segments are remembered in a bounded table, as words recur. Runs of two or more space marks hold
pieces of equal score, where the order of merges decides: those segments alone are merged step by step.

Defined cases: null is empty and encodes to no ids; very long texts are whole; pieces that tie in score go as the library has
them; repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import batch, ready, texts, trimmed

MARK = "▁"
REMEMBERED = 400_000


class Memory(dict):
    """Ids of segments, worked out when first asked for; bounded."""

    def __init__(self, work: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, text: str) -> list[int]:
        ids = self.work(text)
        if len(text) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


class PieceCodec:
    def __init__(self, path: str) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = lib.normalize
        size = lib.get_piece_size()
        self.surface = [lib.id_to_piece(i) for i in range(size)]
        self.is_byte = [lib.is_byte(i) for i in range(size)]
        self.silent = [lib.is_control(i) or lib.is_unused(i) for i in range(size)]
        self.unknown = lib.unk_id()
        self.byte_id = {int(self.surface[i][3:5], 16): i for i in range(size) if self.is_byte[i]}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        normal = [i for i in range(size) if not (self.is_byte[i] or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {self.surface[i]: lib.get_score(i) for i in normal}
        self.id_of = {self.surface[i]: i for i in normal}
        self.known = {s for s in self.id_of if len(s) == 1}
        if any(MARK in s.lstrip(MARK) for s in self.id_of) or any(c not in self.known for s in self.id_of for c in s):
            raise ValueError("pieces hold inner space marks or letters that are no pieces")
        self._build()
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if "\n" in self.known else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        self.memory = Memory(self.segment)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _build(self) -> None:
        """Order of merges, the last merge of every piece, the automaton, longest proper prefixes."""
        long = sorted((s for s in self.id_of if len(s) > 1), key=lambda s: (-self.score[s], self.id_of[s]))
        self.rank = {s: i for i, s in enumerate([*sorted(self.known), *long])}
        self.text_of = [*sorted(self.known), *long]
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.known))]
        self.joined: dict[tuple[int, int], int] = {}
        reached = []
        for s in long:
            r = self.rank[s]
            parts, last = self.merge(s)
            if len(parts) == 1:
                pair = self.rank[last[0]], self.rank[last[1]]
                self.halves.append(pair)
                self.joined[pair] = r
                reached.append(s)
            else:
                self.halves.append((r, r))
        usable = {*self.known, *reached}
        self.automaton = ahocorasick.Automaton()
        for s in usable:
            self.automaton.add_word(s, self.rank[s])
        self.automaton.make_automaton()
        self.whole = {s: self.rank[s] for s in usable}
        self.shorter = [-1] * len(self.text_of)
        for s in usable:
            self.shorter[self.rank[s]] = next((self.rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), -1)
        self.length = [len(s) for s in self.text_of]
        self.ids = [self.id_of[s] for s in self.text_of]

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Merging step by step, best score first, then the leftmost: the pieces, and the last pair joined."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (s := parts[a] + parts[b]) in self.score:
                heapq.heappush(queue, (-self.score[s], a, b, s))

        for i in range(n - 1):
            offer(i, i + 1)
        last = ("", "")
        while queue:
            _, a, b, s = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != s:
                continue
            last = (parts[a], parts[b])
            parts[a], parts[b] = s, None
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None], last

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the texts of two pieces side by side would leave just those two."""
        limit = len(self.text_of) + 1
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def backtrack(self, text: str) -> list[int]:
        """Ranks of the pieces of a text of known letters."""
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        longest = [-1] * len(text)
        lengths = self.length
        for end, r in self.automaton.iter(text):  # ends ascend, so the last match from a start is its longest
            longest[end + 1 - lengths[r]] = r
        open_ = bytearray(b"\x01") * (len(text) + 1)
        laid: list[int] = []
        length, shorter, pairs = self.length, self.shorter, self.pairs
        at, token, size = 0, longest[0], len(text)
        while at < size:
            last = laid[-1] if laid else -1
            while True:
                end = at + length[token]
                if open_[end]:
                    good = last < 0 or pairs.get((last, token))
                    if good is None:
                        if len(pairs) >= REMEMBERED:
                            pairs.clear()
                        good = pairs[last, token] = self.fits(last, token)
                    if good:
                        laid.append(token)
                        at = end
                        token = longest[at] if at < size else -1
                        break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                open_[at] = 0
                laid.pop()
                at -= length[last]
                token = last
                break
        return laid

    def segment(self, text: str) -> list[int]:
        """Ids of a segment: one run of space marks at most, at its start."""
        if not text.startswith(MARK * 2) and self.known.issuperset(text):
            return [self.ids[r] for r in self.backtrack(text)]
        out: list[int] = []
        start = 0
        for i in range(len(text) + 1):
            if i == len(text) or text[i] not in self.known:
                if start < i:
                    part = text[start:i]
                    if part.startswith(MARK * 2):
                        out.extend(self.id_of[p] for p in self.merge(part)[0])
                    else:
                        out.extend(self.ids[r] for r in self.backtrack(part))
                if i < len(text):
                    out.extend(self.byte_id[b] for b in text[i].encode("utf-8", "replace"))
                start = i + 1
        return out

    def segments(self, text: str) -> list[str]:
        """The normalised text, cut before each run of space marks."""
        return self.cut(self.normalize(text))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.segments(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces side by side make characters, or one replacement character each where they can't."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if self.is_byte[i]:
                run.append(int(self.surface[i][3:5], 16))
                continue
            if run:
                out.append(characters(bytes(run)))
                run.clear()
            if not self.silent[i]:
                out.append(" ⁇ " if i == self.unknown else self.surface[i])
        if run:
            out.append(characters(bytes(run)))
        text = "".join(out)
        if ids and text.startswith(MARK) and not self.is_byte[ids[0]]:
            text = text[1:]
        return text.replace(MARK, " ")


def characters(run: bytes) -> str:
    """Bytes as UTF-8; each byte that belongs to no character is U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every row."""
    keyed = ready(docs).select(docs[key].alias("k"), docs[text].alias("t"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield batch(pa.schema([b.schema.field(0), ("ids", pa.list_(pa.int32()))]), [b.column(0), [c.encode(t) for t in texts(b.column(1))]])

    return keyed.mapInArrow(trimmed(rows), f"k {keyed.schema[0].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def decode(coded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of every row of ids; null ids are none."""
    keyed = ready(coded).select(coded[key].alias("k"), coded[ids].alias("i"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield batch(pa.schema([b.schema.field(0), ("text", pa.string())]), [b.column(0), [c.decode(i or []) for i in b.column(1).to_pylist()]])

    return keyed.mapInArrow(trimmed(rows), f"k {keyed.schema[0].dataType.simpleString()}, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number of ids, SHA-256 of the ids and of the text decoded from them; ids don't leave the worker."""
    keyed = ready(docs).select(docs[key].alias("k"), docs[text].alias("t"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            found = []
            for t in texts(b.column(1)):
                ids = c.encode(t)
                found.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest()))
            cols = [list(x) for x in zip(*found, strict=True)] or [[], [], []]
            yield batch(pa.schema([b.schema.field(0), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]), [b.column(0), *cols])

    return keyed.mapInArrow(trimmed(rows), f"k {keyed.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)

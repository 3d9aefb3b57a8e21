"""Edit-aware token counts: a segment tree of pre-tokens per document, kept as a table.

Merges never cross pre-tokens, so a document's count is the sum of its pre-tokens' counts. The tree keeps, per
subtree, characters and tokens. An edit walks down to the leaves it touches, splits anew only from a pre-token that
cannot have seen the edit (each depends on two characters past its end, and on whether an added token begins there) up to the first old border after the
edit that the new split meets again, and adds up the sums on the paths to the root. Everything else keeps its counts.

trees() makes the table: the text, and characters and tokens of each leaf (a run of up to LEAF pre-tokens). edited() and
updated() take trees from there; a leaf's pre-tokens are found and counted only when an edit touches the leaf, all others keep
their sums, and updated() gives the table for the next call. So a document is encoded whole once, whatever is
done to it later.

A log of edits may hold any number for one key: rows are dealt by document, sorted by order, and streamed past the one
tree that a task holds; copies of a document each get their edits.

Defined cases: the file's added tokens are one token each wherever a text has their string, also where an edit makes or breaks one, as tokenizers has
it; a null text is empty, 0 tokens; null edits are none; an edit's bounds are clipped to the text as it is
then, null ones are 0, and edits apply in order, ties by their bounds and text; a very long text is one tree; an empty table gives an empty result;
other columns are not read whatever they are called; repeated rows count each; a null key's edits are those of rows without a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, ready, texts, trimmed, written
from .vocab import SPLIT, encoding

LEAF = 32
REMEMBERED = 500_000
REACH = 2  # characters past its end on which a pre-token depends, besides added tokens
walk = regex.compile(SPLIT).finditer


class Splitter:
    """Cuts texts into pre-tokens: at the added tokens of a vocabulary, which are one each, and by its pattern between them."""

    def __init__(self, added: list[str]) -> None:
        self.added = frozenset(added)
        self.cut = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=lambda a: (-len(a), a)))) if added else None
        self.reach = REACH + max(map(len, added), default=0)

    def walk(self, text: str) -> Iterator[tuple[int, str]]:
        """(first character, pre-token) of each."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            for w in walk(text[at : m.start()]):
                yield at + w.start(), w.group()
            yield m.start(), m.group()
            at = m.end()
        for w in walk(text[at:] if at else text):
            yield at + w.start(), w.group()

    def split(self, text: str) -> list[str]:
        return [w for _, w in self.walk(text)]


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(sorted(encoding(path).special_tokens_set))


class Node:
    """A subtree: its sums, and either two subtrees, or a run of pre-tokens with their counts, or the text of a run not yet looked into."""

    __slots__ = ("left", "right", "words", "counts", "raw", "chars", "tokens")

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.fill(words, counts)

    def fill(self, words: list[str], counts: list[int]) -> None:
        self.raw = None
        if len(words) > LEAF:
            half = len(words) // 2
            self.left, self.right = Node(words[:half], counts[:half]), Node(words[half:], counts[half:])
            self.words = self.counts = None
            self.add()
        else:
            self.left = self.right = None
            self.words, self.counts = words, counts
            self.chars, self.tokens = sum(map(len, words)), sum(counts)

    @classmethod
    def folded(cls, leaves: list[tuple[str, int]]) -> Node:
        """A subtree over leaves of (text, tokens)."""
        node = cls([], [])
        if len(leaves) > 1:
            half = len(leaves) // 2
            node.left, node.right, node.words, node.counts = cls.folded(leaves[:half]), cls.folded(leaves[half:]), None, None
            node.add()
        elif leaves and leaves[0][0]:
            node.raw, node.tokens = leaves[0]
            node.words, node.counts, node.chars = None, None, len(node.raw)
        return node

    def add(self) -> None:
        self.chars = self.left.chars + self.right.chars
        self.tokens = self.left.tokens + self.right.tokens

    def text(self) -> str:
        return self.raw if self.raw is not None else "".join(self.words)


class Tree:
    def __init__(self, text: str, count: Callable[[str], int], cut: Splitter) -> None:
        self.count, self.cut = count, cut
        words = cut.split(text)
        self.root = Node(words, [count(w) for w in words])
        self.encoded = len(words)

    @classmethod
    def kept(cls, text: str, chars: np.ndarray, tokens: np.ndarray, count: Callable[[str], int], cut: Splitter) -> Tree:
        """The tree of a text with the sums of its leaves; nothing is encoded."""
        tree = cls("", count, cut)
        ends = np.cumsum(chars).tolist()
        tree.root = Node.folded([(text[end - n : end], t) for end, n, t in zip(ends, chars.tolist(), tokens.tolist(), strict=True)])
        return tree

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves that hold any."""
        found = [n for n in self.nodes() if n.chars]
        return np.array([n.chars for n in found], "<u4"), np.array([n.tokens for n in found], "<u4")

    def nodes(self) -> Iterator[Node]:
        stack = [self.root]
        while stack:
            n = stack.pop()
            if n.left is None:
                yield n
            else:
                stack += [n.right, n.left]

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def leaves(self, start: int, stop: int) -> list[tuple[list[Node], int]]:
        """The leaves that touch [start, stop], each with the path to it and its first character."""
        found: list[tuple[list[Node], int]] = []
        stack = [([self.root], 0)]
        while stack:
            path, at = stack.pop()
            node = path[-1]
            if at > stop or at + node.chars < start:
                continue
            if node.left is None:
                found.append((path, at))
            else:
                stack.append(([*path, node.right], at + node.left.chars))
                stack.append(([*path, node.left], at))
        return found

    def unfold(self, node: Node, end: int) -> None:
        """Finds and counts the pre-tokens of a leaf that ends at a character; the next characters tell its last one's border."""
        if node.raw is None:
            return
        after = "".join(path[-1].text() for path, at in self.leaves(end, end + self.cut.reach) if at >= end)[: self.cut.reach]
        words, left = [], node.chars
        for w in self.cut.split(node.raw + after):
            if left <= 0:
                break
            words.append(w[:left])
            left -= len(w)
        node.raw, node.words, node.counts = None, words, [self.count(w) for w in words]
        self.encoded += len(words)

    def edit(self, start: int, stop: int, text: str) -> int:
        """Replaces [start, stop) by text; returns how many pre-tokens were encoded anew."""
        start = min(max(start, 0), self.root.chars)
        stop = min(max(stop, start), self.root.chars)
        after = self.cut.reach
        reach = stop + after
        while True:
            touched = self.leaves(max(0, start - after), reach)
            base = touched[0][1]
            for path, at in touched:
                self.unfold(path[-1], at + path[-1].chars)
            words = [w for path, _ in touched for w in path[-1].words]
            counts = [c for path, _ in touched for c in path[-1].counts]
            end = base + sum(map(len, words))
            first, at = 0, base
            while first < len(words) and at + len(words[first]) + after <= start:
                at += len(words[first])
                first += 1
            old = "".join(words[first:])
            new = old[: start - at] + text + old[stop - at :]
            borders, b = {}, at
            for i in range(first, len(words)):
                borders[b + len(text) - (stop - start)] = i
                b += len(words[i])
            fresh, met = [], None
            whole = end == self.root.chars
            for p, w in self.cut.walk(new):
                p += at
                if p >= start + len(text) and p in borders:
                    met = borders[p]
                    break
                if not whole and p + len(w) + after > at + len(new):
                    break
                fresh.append(w)
            else:
                met = len(words) if whole else None
            if met is not None:
                break
            reach = end + 4 * LEAF
        made = [self.count(w) for w in fresh]
        touched[0][0][-1].fill(words[:first] + fresh + words[met:], counts[:first] + made + counts[met:])
        for path, _ in touched[1:]:
            path[-1].fill([], [])
        for path, _ in reversed(touched):
            for node in reversed(path[:-1]):
                node.add()
        self.encoded += len(fresh)
        return len(fresh)

    def text(self) -> str:
        return "".join(n.text() for n in self.nodes())


def counter(path: str) -> Callable[[str], int]:
    """Tokens of a pre-token, one for an added token, remembered in a bounded table."""
    encode, added = encoding(path).encode_ordinary, splitter(path).added
    memory: dict[str, int] = {}

    def count(word: str) -> int:
        n = memory.get(word)
        if n is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            n = 1 if word in added else len(encode(word))
            if len(word) < 64:
                memory[word] = n
        return n

    return count


TREE = "text string, chars binary, tokens binary, n_tokens long, n_pretokens long"


def trees(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of trees: key, text, characters and tokens of its leaves (32-bit numbers), tokens and pre-tokens of the whole. Write it to keep it."""
    keyed = ready(docs).select(docs[key].alias("k"), docs[text].alias("t"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(tokenizer), splitter(tokenizer)
        for b in batches:
            found = []
            for t in texts(b.column(1)):
                tree = Tree(t, count, cut)
                chars, tokens = tree.sums()
                found.append((t, chars.tobytes(), tokens.tobytes(), tree.tokens, tree.encoded))
            yield batch(pa.schema([b.schema.field(0), *tree_fields()]), [b.column(0), *([list(x) for x in zip(*found, strict=True)] or [[]] * 5)])

    return keyed.mapInArrow(trimmed(rows), f"k {keyed.schema[0].dataType.simpleString()}, {TREE}").withColumnRenamed("k", key)


def tree_fields() -> list[tuple[str, pa.DataType]]:
    return [("text", pa.string()), ("chars", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64())]


def loaded(text: str | None, chars: bytes, tokens: bytes, count: Callable[[str], int], cut: Splitter) -> Tree:
    return Tree.kept(text or "", np.frombuffer(chars, "<u4"), np.frombuffer(tokens, "<u4"), count, cut)


def edited(kept: DataFrame, tokenizer: str, edits: Column, key: str = "doc_id") -> DataFrame:
    """key, tokens before and after each row's own edits (array of struct start, stop, text), pre-tokens before, and those encoded for the edits; from a table of trees."""
    keyed = ready(kept).select(kept[key].alias("k"), *(kept[n].alias(n) for n, _ in tree_fields()), edits.alias("e"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(tokenizer), splitter(tokenizer)
        for b in batches:
            after, anew, n = [], [], []
            for t, c, k, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 6)), strict=True):
                tree = loaded(t, c, k, count, cut)
                for e in own or []:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                after.append(tree.tokens)
                anew.append(tree.encoded)
                n.append(len(own or []))
            yield batch(pa.schema([b.schema.field(0), *((x, pa.int64()) for x in ("n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_reencoded"))]), [b.column(0), b.column(4), b.column(5), n, after, anew])

    return keyed.mapInArrow(trimmed(rows), f"k {keyed.schema[0].dataType.simpleString()}, n_tokens long, n_pretokens long, n_edits long, n_tokens_after long, n_reencoded long").withColumnRenamed("k", key)


def updated(kept: DataFrame, tokenizer: str, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table of trees after a log of edits (key, seq, start, stop, text), in order of seq. Rows without edits pass through; n_pretokens of the others is null, as leaves no edit touched are not split."""
    names = [n for n, _ in tree_fields()]
    kind = dict(kept.dtypes)[key]
    rows = written(ready(kept).select(F.col(key).alias("k"), *names).withColumn("row", F.monotonically_increasing_id()), "trees")
    entries = log.select(F.col(key).cast(kind).alias("ek"), F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("text").alias("new"))
    asked = written(rows.select("row", "k").join(entries, F.col("k").eqNullSafe(F.col("ek"))).select("row", "seq", "start", "stop", "new"), "edits")
    some = asked.select("row").distinct()
    none = rows.join(some, "row", "left_anti").select("k", *names)
    blank = F.lit(None)
    first = rows.join(some, "row", "left_semi").select("row", F.lit(0).alias("part"), blank.cast("long").alias("seq"), blank.cast("long").alias("start"), blank.cast("long").alias("stop"), blank.cast("string").alias("new"), "k", *names)
    then = asked.select("row", F.lit(1).alias("part"), "seq", "start", "stop", "new", blank.cast(kind).alias("k"), *(blank.cast(first.schema[n].dataType).alias(n) for n in names))
    ordered = first.unionByName(then).repartition("row").sortWithinPartitions("row", "part", "seq", "start", "stop", "new")

    def applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(tokenizer), splitter(tokenizer)
        tree, k, schema = None, None, None

        def made() -> pa.RecordBatch:
            chars, tokens = tree.sums()
            return batch(schema, [[k], [tree.text()], [chars.tobytes()], [tokens.tobytes()], [tree.tokens], [None]])

        for b in batches:
            schema = schema or pa.schema([b.schema.field("k"), *tree_fields()])
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in (("k", *names) if b.column("part")[i].as_py() == 0 else ("start", "stop", "new"))}
                if "k" in r:
                    if tree is not None:
                        yield made()
                    tree, k = loaded(r["text"], r["chars"], r["tokens"], count, cut), r["k"]
                else:
                    tree.edit(r["start"] or 0, r["stop"] or 0, r["new"] or "")
        if tree is not None:
            yield made()

    return none.unionByName(ordered.mapInArrow(trimmed(applied), f"k {kind}, {TREE}")).withColumnRenamed("k", key)


def usual_edits(text: str = "text") -> Column:
    """Edits that any document can take: a sentence inserted at a third, a tenth rewritten in the middle, the last words cut."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    third, half, tenth = F.floor(n / 3), F.floor(n / 2), F.floor(n / 10)
    at = F.struct
    return F.array(
        at(third.alias("start"), third.alias("stop"), F.lit(" See also the revised note.").alias("text")),
        at(half.alias("start"), (half + tenth).alias("stop"), F.upper(F.substring(text, (half + 1).cast("int"), tenth.cast("int"))).alias("text")),
        at(F.greatest(n - 12, F.lit(0)).alias("start"), n.alias("stop"), F.lit("").alias("text")),
    )

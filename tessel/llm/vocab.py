"""Public vocabularies, loaded once per Python process from files whose paths are parameters."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: how byte-level BPE splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE in a tokenizers JSON file; its ids are the merge ranks, so the file's vocabulary is enough."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    return tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)


def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to the ids of tokenizers with add_special_tokens=False: the file's added tokens are matched inside texts."""
    e = encoding(path)
    return lambda text: np.array(e.encode(text, allowed_special="all", disallowed_special=()), dtype=np.uint32)


def public_path(name: str) -> str:
    """Where a public vocabulary file is; the default of the queries' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Encoding of texts with a public byte-level BPE vocabulary, merges found through a segment tree."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the public vocabulary files lie on every machine; a parameter of each function below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pre-tokens a worker remembers before it starts afresh; this bounds memory and has no part in the result.
REMEMBERED = 200_000

_NONE = 1 << 62
_LEFT = (1 << 32) - 1


@lru_cache(4)
def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte string -> id; the id is also the rank of the merge that makes the string."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    The leaves of a segment tree are the adjacent pairs, at the place of the pair's left part, each holding
    (rank, place) of the merge or infinity; the root is then the leftmost pair of lowest rank. A merge changes three leaves
    (the pair itself, the pair before it, the one swallowed), each renewed up to the root in logarithmic time, so a
    pre-token of n bytes takes n log n steps however long it is.
    """
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = (r << 32) | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        node = size + place
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a < b else b
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while tree[1] != _NONE:
        left = tree[1] & _LEFT
        right = after[left]
        end = after[right]
        after[left] = end
        if end < n:
            put(right, _NONE)
            before[end] = left
            r = rank(piece[left : after[end]])
            put(left, _NONE if r is None else (r << 32) | left)
        else:
            put(left, _NONE)
        if left:
            prior = before[left]
            r = rank(piece[prior:end])
            put(prior, _NONE if r is None else (r << 32) | prior)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Text -> ids, remembering the pre-tokens it has met."""

    def __init__(self, path: str = VOCABULARY):
        self.ranks = load_ranks(path)
        # White space is the Unicode property: Python adds four control characters to it.
        self.split = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for word in self.split(text):
            got = known.get(word)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = merge_piece(word.encode(), self.ranks)
                if len(word) <= 64:
                    known[word] = got
            ids += got
        return ids


@lru_cache(4)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def token_ids(text: Column | str, path: str = VOCABULARY) -> Column:
    """Ids of a text column without special tokens. Null and empty texts both give an empty list, never null."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(path).encode
        rows = [encode(x) if x else [] for x in texts.to_pylist()]
        offsets = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return ids(text)


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Number of ids of a text column; 0 for null and empty texts."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path).encode
        return pa.array([len(encode(x)) if x else 0 for x in texts.to_pylist()], pa.int64())

    return count(text)

"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Each pre-token is merged with a segment tree over its byte positions. Leaf ``i`` holds the rank of the pair that
starts at ``i``, inner nodes the minimum of their children; descending left-first from the root finds the leftmost
pair of the lowest rank, and a merge changes three leaves (the merged position, its swallowed neighbour and the live
position before it), each in logarithmic time. A pre-token of n bytes thus takes O(n log n) whatever its shape, also
where a text has no spaces at all.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of the operators.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_PAIR = 1 << 60
#: Distinct pre-tokens that a Python worker remembers; beyond it the memory starts afresh (results are the same).
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 text, a space and a number in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], longest: int) -> tuple[int, ...]:
    """Ids of one pre-token after all merges, by a segment tree over its byte positions."""
    n = len(piece)
    if n == 1:
        return (ranks[piece],)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [NO_PAIR] * (2 * leaves)
    find = ranks.get
    for i in range(n - 1):
        tree[leaves + i] = find(piece[i : i + 2], NO_PAIR)
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))  # the next live position, also the end of this position's token
    before = list(range(-1, n))

    def put(at: int, rank: int) -> None:
        at += leaves
        tree[at] = rank
        at //= 2
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a <= b else b
            if tree[at] == low:
                break
            tree[at] = low
            at //= 2

    while tree[1] < NO_PAIR:
        low, at = tree[1], 1
        while at < leaves:
            at *= 2
            if tree[at] != low:
                at += 1
        at -= leaves
        gone = after[at]
        end = after[at] = after[gone]
        if end < n:
            before[end] = at
        put(gone, NO_PAIR)
        put(at, find(piece[at : after[end]], NO_PAIR) if end < n and after[end] - at <= longest else NO_PAIR)
        if (last := before[at]) >= 0:
            put(last, find(piece[last:end], NO_PAIR) if end - last <= longest else NO_PAIR)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return tuple(ids)


class Encoder:
    """Text to ids by a rank file; remembers the ids of pre-tokens met before."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import regex

        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str, out: list[int]) -> None:
        """Appends the ids of ``text`` to ``out``."""
        known, extend = self.known, out.extend
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[piece] = merge_bytes(piece.encode(), self.ranks, self.longest)
            extend(ids)


def corpus_ids(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every document, without special tokens: a narrow map, so nothing is shuffled.

    Null and empty texts give an empty list; strings of special tokens inside a text are ordinary text; whole texts
    are encoded, whatever their length. Repeated rows stay repeated; other columns are never read; an empty table
    gives no rows. ``folder`` must hold ``<vocabulary>.tiktoken`` on every executor.
    """
    path = f"{folder}/{vocabulary}.tiktoken"
    kind = dict(documents.dtypes)[doc_id]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for value in batch.column(1).to_pylist():
                if value:
                    encoder.encode(value, flat)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype="int32")), pa.array(np.array(flat, dtype="int32")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[doc_id, "ids"])

    return documents.select(F.col(doc_id), F.col(text)).mapInArrow(encode, f"`{doc_id}` {kind}, ids array<int>")

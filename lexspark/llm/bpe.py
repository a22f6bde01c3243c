"""Byte-level BPE as a reduction over a tree: halves are encoded on their own and joined at their boundary.

A sequence of tokens is the encoding of its bytes exactly when each token and each adjacent pair of tokens is the
encoding of its own bytes. A join therefore re-encodes a window around the boundary and is done as soon as the pairs at
the window's two edges hold; otherwise the window grows on the side that fails, up to the whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import pairwise

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, table
from .pretokens import PieceCache

#: Inner nodes of up to so many bytes are kept.
KEPT = 16
#: Windows of more bytes are merged with a heap.
LONG = 128
_NONE = 1 << 60
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.nodes: dict[bytes, list[int]] = {}
        self.joins = 0
        self.single = [ranks[bytes([x])] for x in range(256)]
        #: Two tokens -> the token, and so the rank, of their bytes together.
        self.merged = {(ranks[k[:i]], ranks[k[i:]]): v for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > LONG:
            return self._merge_long(data)
        get = self.merged.get
        ids = [self.single[x] for x in data]
        near = [get((a, b), _NONE) for a, b in pairwise(ids)]
        while near:
            best = min(near)
            if best == _NONE:
                break
            i = near.index(best)
            ids[i : i + 2] = (best,)
            del near[i]
            if i:
                near[i - 1] = get((ids[i - 1], best), _NONE)
            if i < len(near):
                near[i] = get((best, ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and ends[i] < n:
                end = ends[ends[i]]
                r = ranks.get(data[i:end])
                if r is not None:
                    heapq.heappush(heap, (r, i, end))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
                continue
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                before[end] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            whole = self.merged.get((a, b))
            found = self.pairs[a, b] = [whole] if whole is not None else self.merge(self.bytes[a] + self.bytes[b])
        return found

    def holds(self, a: int, b: int) -> bool:
        return self.pair(a, b) == [a, b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a or b
        self.joins += 1
        window = self.pair(a[-1], b[0])
        if window == [a[-1], b[0]]:
            return a + b
        i = j = 1
        while True:
            left = i == len(a) or self.holds(a[-i - 1], window[0])
            right = j == len(b) or self.holds(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = min(i if left else 2 * i, len(a)), min(j if right else 2 * j, len(b))
            window = self.merge(b"".join(map(self.bytes.__getitem__, a[-i:] + b[:j])))

    def encode(self, data: bytes) -> list[int]:
        """Leaves are single bytes; results of short inner nodes are kept, as many pieces share them."""
        if len(data) <= 1:
            return [self.single[data[0]]] if data else []
        found = self.nodes.get(data)
        if found is None:
            half = len(data) // 2
            found = self.join(self.encode(data[:half]), self.encode(data[half:]))
            if len(data) <= KEPT:
                if len(self.nodes) > 500_000:
                    self.nodes.clear()
                self.nodes[data] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        """Bytes concatenated up the tree of the ids."""
        if len(ids) <= 2:
            return b"".join([self.bytes[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=2)  # for the life of a Python worker, not of a task
def piece_encoder(ranks_path: str, pattern: str) -> PieceCache:
    """Chunk -> (ids in decimal joined by commas, bytes that the ids decode to)."""
    bpe = TreeBpe(read_ranks(ranks_path))

    def encode(pieces: list[str]) -> list[tuple[str, bytes]]:
        out = []
        for p in pieces:
            ids = bpe.encode(p.encode())
            out.append((",".join(map(str, ids)), bpe.decode(ids)))
        return out

    return PieceCache(pattern, encode, lambda xs: (",".join([x[0] for x in xs]), b"".join([x[1] for x in xs])))


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs, null texts as empty (0 tokens).

    Rows are encoded one by one, so null or repeated ids and rows, ties and other columns do not matter; an empty
    table gives an empty result. Long pieces are encoded by the tree in bounded windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = piece_encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids, back = [], [], []
                for values in cache.texts(texts):
                    s = ",".join([v[0] for v in values])
                    n.append(s.count(",") + 1 if s else 0)
                    ids.append(hashlib.sha256(s.encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join([v[1] for v in values])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _SCHEMA)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs; null texts give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(read_ranks(ranks_path))
        cache = PieceCache(pattern, lambda ps: [bpe.encode(p.encode()) for p in ps], lambda xs: [i for x in xs for i in x])
        for batch in batches:
            got = cache.texts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[i for v in vs for i in v] for vs in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, data (binary) for rows of doc_id, ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(read_ranks(ranks_path))
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, data binary")


def op10_bpe(spark, sf_dir):
    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

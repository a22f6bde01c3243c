"""Packing of tokenized documents into sequences: Martello-Toth reduction, then best fit decreasing.

Lengths are integers up to the sequence length, so the whole instance is a histogram of bounded size whatever the number
of documents. The reduction and the packing work on counts of equal lengths at once and give patterns with
multiplicities; documents get their places from their rank among those of equal length.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, slices, spread, table
from .pretokens import UNUSUAL

Pattern = tuple[tuple[int, ...], int]


def reduce_instance(counts: dict[int, int], size: int) -> tuple[list[Pattern], dict[int, int]]:
    """Bins that some optimal packing has, and what is left: for an item, a set that dominates every other feasible set
    with it is fixed. counts: items by length. A set of the item and one more dominates if the one more is the largest
    that fits and either fills the bin, or no two others fit beside the item, or no pair that fits is larger (and no
    three fit)."""
    left = {w: n for w, n in counts.items() if n}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                partner = _dominating(w, left, size)
                if partner is None:
                    break
                changed = True
                if partner == 0:
                    fixed.append(((w,), left.pop(w)))
                    continue
                n = left[w] // 2 if partner == w else min(left[w], left[partner])
                fixed.append(((w, partner), n))
                for x in (w, partner):
                    left[x] -= n
                    if not left[x]:
                        del left[x]
    return fixed, left


def _dominating(w: int, left: dict[int, int], size: int) -> int | None:
    """Length of the one item that belongs beside w, 0 if none fits, None if no set is known to dominate."""
    room = size - w
    other = sorted(x for x, n in left.items() if n > (x == w) and x <= room)
    if not other:
        return 0
    have = lambda x: left[x] - (x == w)
    best = other[-1]
    if best == room:
        return best
    k, rest = 0, room
    for x in other:
        n = min(have(x), rest // x, 3 - k)
        k, rest = k + n, rest - n * x
        if k >= 3 or not n:
            break
    if k == 1:
        return best
    if k == 2:
        most = 0
        for i, x in enumerate(other):
            j = bisect_right(other, room - x) - 1
            while j >= i and other[j] == x and have(x) < 2:
                j -= 1
            if j >= i:
                most = max(most, x + other[j])
        if best >= most:
            return best
    return None


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best fit decreasing over counts: an item goes to the open bin that it leaves the least room in."""
    done: list[Pattern] = []
    open_bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(items: tuple[int, ...], n: int, room: int) -> None:
        if not n:
            return
        if room == 0:
            done.append((items, n))
            return
        if room not in open_bins:
            rooms.insert(bisect_left(rooms, room), room)
            open_bins[room] = []
        open_bins[room].append((items, n))

    for w in sorted(counts, reverse=True):
        m = counts[w]
        while m:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                items, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, items, n = size, (), -(-m // (size // w))
            each = room // w
            full = min(n, m // each)
            more = min(m - full * each, each) if full < n else 0
            put(items + (w,) * each, full, room - each * w)
            if more:
                put(items + (w,) * more, 1, room - more * w)
            if n - full - bool(more) and items:
                put(items, n - full - bool(more), room)
            m -= full * each + more
    for room in rooms:
        done += open_bins[room]
    return done


def plan(counts: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset): the items of a length with ranks from the first rank on, up to
    the next row's, go to sequences from the first one on; and the number of sequences."""
    fixed, left = reduce_instance(counts, size)
    rows, ranks, base = [], dict.fromkeys(counts, 0), 0
    for items, n in fixed + best_fit(left, size):
        offset = 0
        for w in items:
            rows.append((w, ranks[w], base, offset))
            ranks[w] += n
            offset += w
        base += n
    assert ranks == dict(counts)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4), base


@functools.lru_cache(maxsize=2)  # for the life of a Python worker, not of a task
def encoder(tokenizer_path: str) -> Callable[[str], list[int]]:
    """text -> ids as `tokenizers` gives them for the file, without added special tokens; the strings of special tokens
    within a text are read as those. Plain texts take a quicker engine: the file's ids stand in the order of its merges, so
    they serve as ranks. Texts with special strings or unusual characters are left to the library."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = json.load(f)
    model, special = content["model"], [x["content"] for x in content.get("added_tokens", [])]
    # byte-level files write bytes as printable characters: those of Latin-1 as themselves, the rest from 256 on, in order
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special and all(c in letters for c in word)}
    quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    library = Tokenizer.from_file(tokenizer_path)

    def encode(text: str) -> list[int]:
        if UNUSUAL.search(text) or any(s in text for s in special):
            return library.encode(text, add_special_tokens=False).ids
        return quick(text)

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit) for each row of docs.

    Null texts count as empty and are one piece, the end id. Longer ones than size are cut; all but the first piece have
    length size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in slices(batches):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                data, n = np.array(ids, dtype="<u4").tobytes(), len(ids)
                start, stop, k = 0, (n - 1) % size + 1, 0
                while start < n:
                    out.append((key, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                    start, stop, k = stop, stop + size, k + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """pieces (with a column length, 1 to size) plus sequence_id and offset, which replace columns of these names: no
    sequence is longer than size.

    Rows of equal length are interchangeable, repeated rows are separate items, nulls in other columns do not matter, and
    other columns pass through, whatever their names. An empty table stays empty. Only the histogram of lengths, at most
    `size` numbers, comes to the driver.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    fixed = materialize(pieces.select(own, F.col("length").cast("long").alias("length"), F.spark_partition_id().alias("src"), F.monotonically_increasing_id().alias("uid")))
    whole, rest = fixed.where(F.col("length") == size), fixed.where(F.col("length") < size)
    by_src = materialize(rest.groupBy("length", "src").agg(F.count(F.lit(1)).alias("n")))
    counts = {int(r["length"]): int(r["n"]) for r in by_src.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, sequences = plan(counts, size)
    before = by_src.select("length", "src", (F.sum("n").over(W.partitionBy("length").orderBy("src")) - F.col("n")).alias("before"))
    nth = F.row_number().over(W.partitionBy("length", "src").orderBy("uid")) - 1
    ranked = rest.withColumn("nth", nth).join(before, ["length", "src"]).select("row", "length", (F.col("nth") + F.col("before")).cast("long").alias("rank"))
    # bounded by the square of size, whatever the input
    shared = pieces.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        width = int(table[:, 1].max()) + 1 if len(table) else 1
        reach = max(width, int(rank.max()) + 1 if len(rank) else 1)
        at = np.searchsorted(table[:, 0] * reach + table[:, 1], length.to_numpy() * reach + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 2] + rank.to_numpy() - table[at, 1], "offset": table[at, 3]})

    placed = ranked.withColumn("at", place("length", "rank")).select("row", "at.sequence_id", "at.offset")
    alone = whole.select("row", (F.lit(sequences) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).select(*(F.col(f"row.`{c}`").alias(c) for c in names), "sequence_id", "offset")


def op5_packing(spark, sf_dir):
    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))

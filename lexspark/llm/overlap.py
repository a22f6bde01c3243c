"""Which pairs of texts may be near, by a bound that loses none: parities of their hashed words, by tiles of a bucket.

A text's mark has a bit for each of a number of places, a power of two of twice its words or more: whether an odd number of
its words, labelled with their occurrence, fall there. Where two marks differ, a word is in one text only, so the differing
bits are a lower bound of the words without a partner, and these of the edit distance. A mark is halved by xor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a mark at least; members of a tile's side, and tiles along a side of a bucket unless its marks take more bytes.
LEAST, TILE, TILES, TILE_BYTES = 256, 4096, 16, 1 << 24
#: Pairs that are compared at once, and members of one side among them.
CELLS, ROWS = 1 << 17, 128


def mark(labelled: np.ndarray) -> bytes:
    """The mark of a text's labelled words (64-bit hashes)."""
    places = max(LEAST, 1 << (2 * len(labelled) - 1).bit_length())
    odd = np.bincount((labelled % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class _Side:
    """Members of a tile in the order of their lengths. bits: by the width of the marks, which rises with the length, the
    first such member and the marks, a column for each."""

    def __init__(self, rows: dict[str, np.ndarray | list], some: np.ndarray):
        at = np.flatnonzero(some)
        at = at[np.argsort(rows["n"][at], kind="stable")]
        self.node, self.component, self.n = (rows[c][at] for c in ("node", "component", "n"))
        self.lower = [rows["lower"][i] for i in at]
        marks = [rows["mark"][i] for i in at]
        width = np.array([len(m) // 8 for m in marks], dtype=np.int64)
        self.bits: dict[int, tuple[int, np.ndarray]] = {}
        for w in np.unique(width).tolist():
            first, end = np.searchsorted(width, [w, w + 1]).tolist()
            self.bits[w] = first, np.ascontiguousarray(np.frombuffer(b"".join(marks[first:end]), dtype=np.uint64).reshape(-1, w).T)


def _meet(x: _Side, y: _Side, ties: bool, similarity: float) -> Iterator[tuple[int, int]]:
    """Nodes of x with those of y that are shorter (with ties: or as long; within one side: that come before), of another
    component, not shown to be too far, and in no lower bucket together."""
    most = np.floor(x.n * (1 - similarity) + 1e-9).astype(np.int64)
    low = np.searchsorted(y.n, x.n - most)
    high = np.arange(len(x.n)) if x is y else np.searchsorted(y.n, x.n, side="right" if ties else "left")
    for w, (start, own) in x.bits.items():
        # a near text has half the words or more, so its mark is as long or half as long
        for width, mine in ((w, own), (w // 2, own[: w // 2] ^ own[w // 2 :])):
            if width not in y.bits:
                continue
            first, theirs = y.bits[width]
            for i in range(start, start + own.shape[1], ROWS):
                rows = slice(i, min(i + ROWS, start + own.shape[1]))
                left, end = max(int(low[i]), first), min(int(high[rows.stop - 1]), first + theirs.shape[1])
                for at in range(left, end, CELLS // ROWS):
                    to = min(end, at + CELLS // ROWS)
                    apart = x.n[rows, None] - y.n[None, at:to]
                    for a, b in zip(mine[:, i - start : rows.stop - start], theirs[:, at - first : to - first], strict=True):
                        apart += np.bitwise_count(a[:, None] ^ b[None, :])
                    place = np.arange(at, to)[None, :]
                    ok = (apart <= 2 * most[rows, None]) & (x.component[rows, None] != y.component[None, at:to])
                    ok &= (place >= low[rows, None]) & (place < high[rows, None])
                    for j, k in zip(*(v.tolist() for v in np.nonzero(ok)), strict=True):
                        if x.lower[i + j].isdisjoint(y.lower[at + k]):
                            yield x.node[i + j], y.node[at + k]


def _tile(table: pa.Table, last: int, within: bool, similarity: float) -> pa.Table:
    """The pairs a > b of a tile that may be near, between block `last` and the other one or within its one."""
    rows = {c: table.column(c).to_numpy() for c in ("node", "component", "n", "block")} | {"mark": table.column("mark").to_pylist()}
    rows["lower"] = list(map(frozenset, table.column("lower").to_pylist()))
    values, counts = np.unique(rows["component"], return_counts=True)
    heavy = rows["component"] == values[counts.argmax()]  # needs no comparison within itself
    found: list[tuple[int, int]] = []
    if within:
        x = _Side(rows, ~heavy)
        found += _meet(x, x, True, similarity)
        pairs = [(x, _Side(rows, heavy))]
    else:
        second = rows["block"] == last
        a, b, ha, hb = (_Side(rows, s) for s in (~second & ~heavy, second & ~heavy, ~second & heavy, second & heavy))
        pairs = [(a, b), (a, hb), (ha, b)]
    for x, y in pairs:
        found += _meet(x, y, True, similarity)
        found += _meet(y, x, False, similarity)
    ends = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": ends.max(axis=1), "b": ends.min(axis=1)})


def possible(rows: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """a > b: all pairs of a bucket of different components but those whose marks or lengths show an edit similarity below
    `similarity`, which is 0.5 or more. A pair comes once, from the lowest of its buckets.

    rows: bucket, node, component; marks: node, n (words), mark; both written, no row twice. A bucket is compared by tiles of
    two blocks of its members, so a member is sent as often as its bucket has blocks, and a pair that is shown to be far costs
    some bit operations and no row.
    """
    lists = rows.groupBy("node", "component").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")).join(marks, "node")
    of = lists.select(F.explode("buckets").alias("bucket"), F.length("mark").alias("size")).groupBy("bucket")
    of = of.agg(F.greatest(F.least(F.ceil(F.count(F.lit(1)) / TILE), F.lit(TILES)), F.ceil(F.sum("size") / TILE_BYTES)).cast("int").alias("blocks"))
    dealt = lists.select("*", F.posexplode("buckets").alias("place", "bucket")).join(of, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("lower", F.slice("buckets", F.lit(1), F.col("place"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "n", "mark", "block", "lower")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(lambda key, t: _tile(t, key[2].as_py(), key[1].as_py() == key[2].as_py(), similarity), "a long, b long")

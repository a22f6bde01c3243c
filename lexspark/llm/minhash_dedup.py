"""Near duplicates by order MinHash (Marçais et al. 2019), verified by banded alignment.

Shingles of WORDS words are labelled with their occurrence number; a sketch is the hash of the LENGTH smallest under one
hash function, in the order in which they stand in the text. Texts of up to SHORT words, where a change can hit most
shingles, have SHORT_SKETCHES further ones of single words. Texts that share a sketch are candidates; a candidate pair is
near when its words' edit similarity, 1 - distance / longer length, is SIMILARITY or more. Groups are the connected
components of near pairs: whatever the size of a bucket, near texts that share it come into one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import within
from .common import components_of, discard, materialize, sized, slices, spread, table
from .linking import link_buckets
from .overlap import mark, possible

WORDS, SKETCHES, LENGTH, SIMILARITY = 5, 96, 2, 0.8
SHORT, SHORT_SKETCHES = 50, 24
#: Hashes that are held at once.
CELLS = 1 << 18
#: Sketches by which members of a large bucket are dealt anew, and the places in which pairs of words are counted for it.
FINER, SLOTS = 12, 1 << 18

_SEEDS = np.random.default_rng(17).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


_hash = _Hash()


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(own: list[str], size: int = WORDS) -> np.ndarray:
    """Hash of each run of size words (of all words if fewer), labelled with its occurrence."""
    ids = np.fromiter(map(_hash.__getitem__, own), dtype=np.uint64, count=len(own))
    k = min(size, len(ids))
    total = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for j in range(k):
        total = total * _ODD + ids[j : len(ids) - k + 1 + j]
    total = _mix(total)
    order = np.argsort(total, kind="stable")
    ranked = total[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    nth = np.empty(len(total), dtype=np.uint64)
    nth[order] = np.arange(len(total)) - np.repeat(first, np.diff(np.append(first, len(total))))
    return _mix(total + nth * _ODD)


def sketch(own: list[str]) -> np.ndarray:
    """SKETCHES signed 64-bit keys of a text's words, and SHORT_SKETCHES more of a short text."""
    keys = _ordered(shingles(own), _SEEDS)
    return np.concatenate([keys, _ordered(shingles(own, 1), _SEEDS[:SHORT_SKETCHES])]) if len(own) <= SHORT else keys


def _ordered(labelled: np.ndarray, seeds: np.ndarray, length: int = LENGTH, often: np.ndarray | None = None) -> np.ndarray:
    """For each seed the hash of the `length` least shingles in text order; with `often`, those that win a race of
    exponential times in which a shingle is as much slower as it is frequent."""
    least = np.empty((len(seeds), min(length, len(labelled))), dtype=np.int64)
    some = max(1, CELLS // len(labelled))  # memory in proportion to the text
    for at in range(0, len(seeds), some):
        hashed, most = labelled[None, :] * (seeds[at : at + some, None] | np.uint64(1)), np.iinfo(np.uint64).max
        if often is not None:
            hashed, most = -np.log((hashed >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) * often, np.inf
        rows = np.arange(len(hashed))
        for j in range(least.shape[1]):
            least[at : at + some, j] = first = hashed.argmin(axis=1)
            hashed[rows, first] = most
    least.sort(axis=1)
    key = np.zeros(len(seeds), dtype=np.uint64)
    for j in range(least.shape[1]):
        key = _mix(key * _ODD + labelled[least[:, j]])
    return key.view(np.int64)


def near(a: list[str], b: list[str]) -> bool:
    """Whether the words' edit similarity is SIMILARITY or more."""
    longer = max(len(a), len(b))
    limit = int(longer * (1 - SIMILARITY) + 1e-9)
    if longer - min(len(a), len(b)) > limit:
        return False
    return within(a, b, limit)


def _sketches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, tag) with the words of the text joined by blanks, their digest and the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [words(t) for t in part.column(1).to_pylist()]
            texts = [" ".join(w) for w in own]
            sha = [hashlib.sha256(t.encode()).digest() for t in texts]
            keys = [sketch(w) if w else np.zeros(0, dtype=np.int64) for w in own]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(sha, pa.binary()), pa.array(keys, pa.list_(pa.int64())), part.column(2)], ["doc_id", "text", "sha", "keys", "tag"])

    return docs.mapInArrow(run, "doc_id long, text string, sha binary, keys array<long>, tag long")


class _Texts:
    """The texts (node, text) that are still compared: in the finer buckets, those of the large ones alone, so that later
    rounds do not scan them all."""

    def __init__(self, rows: DataFrame):
        self.rows, self.written = rows, []

    def of(self, nodes: DataFrame) -> DataFrame:
        return materialize(self.rows.join(sized(nodes), "node", "left_semi").select("node", "text"))

    def narrow(self, nodes: DataFrame) -> None:
        self.rows = self.of(nodes)
        discard(*self.written[1:])
        self.written = [*self.written[:1], self.rows]

    def widen(self) -> None:
        """Back to the texts of the first narrowing."""
        self.rows = self.written[0]
        discard(*self.written[1:])
        self.written = self.written[:1]


def _verifier(texts: _Texts) -> Callable[[DataFrame], DataFrame]:
    """For pairs a, b of nodes: a, b, ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if y != last:  # pairs come by leader
                    last, own = y, y.split()
                ok.append(near(x.split(), own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        some = texts.of(nodes)
        discard(nodes)
        both = pairs.select("a", "b").join(some.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, ok boolean")

    return verify


def _refiner(texts: _Texts) -> Callable[[DataFrame, int], DataFrame]:
    """Order sketches for texts that share a large bucket without being near: passages that many of them have weigh little.

    Pairs of adjacent words, labelled with their occurrence, are drawn with a weight of 1 over the number of texts that have
    them (counted in SLOTS places). A sketch is the hash of the first few drawn, one more at each level, in text order.
    """

    def refine(nodes: DataFrame, level: int) -> DataFrame:
        texts.narrow(nodes)
        own = texts.rows

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SLOTS, dtype=np.int64)
            for part in slices(batches):
                each = [shingles(t.split(), 2) for t in part.column(1).to_pylist() if t]
                total += np.bincount((np.concatenate(each) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

        often = np.ones(SLOTS)
        # SLOTS rows at most
        for r in own.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").collect():
            often[r["slot"]] = r["n"]
        shared = own.sparkSession.sparkContext.broadcast(often.astype(np.float32))
        seeds = np.random.default_rng([29, level]).integers(1, 1 << 63, FINER, dtype=np.uint64)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = shared.value
            for batch in slices(batches):
                keys = []
                for text in batch.column(1).to_pylist():
                    pairs = shingles(text.split(), 2) if text else np.zeros(1, dtype=np.uint64)
                    keys.append(_ordered(pairs, seeds, LENGTH + level, often[(pairs % np.uint64(SLOTS)).astype(np.int64)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

        dealt = materialize(own.mapInArrow(deal, "node long, keys array<long>"))
        return dealt.select(F.posexplode("keys").alias("table", "key"), "node").select(F.xxhash64("table", "key").alias("bucket"), "node")

    return refine


def _comparer(texts: _Texts) -> Callable[[DataFrame], DataFrame]:
    """For bucket, node, component: the pairs a, b of different components that may be near."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [t.split() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, own), pa.int64()), pa.array([mark(shingles(w, 1)) for w in own], pa.binary())], ["node", "n", "mark"])

    def compare(rows: DataFrame) -> DataFrame:
        texts.widen()
        nodes = materialize(rows.select("node").distinct())
        own = texts.of(nodes)
        marked = materialize(own.mapInArrow(marks, "node long, n long, mark binary"))
        discard(nodes, own)
        texts.written.append(marked)
        return possible(rows, marked, SIMILARITY)

    return compare


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, tag) as written tables (doc_id, uid, component, tag) and (component, first, group_size)."""
    base = materialize(_sketches(docs).withColumn("uid", F.monotonically_increasing_id()))
    classes = materialize(base.groupBy("sha").agg(F.min("uid").alias("node")))
    copies = materialize(base.select("sha", "uid").join(classes, "sha").where("uid <> node").select("uid"))
    rows = base.select("uid", "keys").join(sized(copies), "uid", "left_anti").select(F.posexplode("keys").alias("table", "key"), F.col("uid").alias("node"))
    rows = rows.select(F.xxhash64("table", "key").alias("bucket"), "node")
    texts = _Texts(base.select(F.col("uid").alias("node"), "text"))
    found = link_buckets(rows, _verifier(texts), _refiner(texts), _comparer(texts))
    parts = components_of(found)
    groups = materialize(classes.join(parts, "node", "left").select("sha", F.coalesce("component", "node").alias("component")))
    placed = materialize(base.select("doc_id", "uid", "sha", "tag").join(groups, "sha").select("doc_id", "uid", "component", "tag"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("first")
    leaders = materialize(placed.groupBy("component").agg(first, F.count(F.lit(1)).alias("group_size")))
    discard(base, classes, copies, parts, groups, found, *texts.written)
    return placed, leaders


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its group), group_size, kept (one row of each).

    Texts equal up to case and blanks are one class before anything else, so copies cost one row each. Null texts count
    as empty, and texts without words form one group; texts of fewer than five words have one shingle. Very long texts are
    sketched and aligned whole. Null ids count as the largest; of repeated rows one is kept. Other columns are ignored. An
    empty table gives an empty result.
    """
    placed, leaders = _grouped(spread(docs.select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("long").alias("tag"))))
    return placed.join(leaders, "component").select("doc_id", F.col("first.doc_id").alias("class_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_groups keeps, one of each group, with the columns of docs, whatever their names."""
    rows = materialize(spread(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("uid")))
    placed, leaders = _grouped(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.text", F.col("uid").alias("tag")))
    gone = materialize(placed.join(leaders, "component").where(F.col("uid") != F.col("first.uid")).select(F.col("tag").alias("uid")))
    discard(placed, leaders)
    return rows.join(gone, "uid", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op1_minhash_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))

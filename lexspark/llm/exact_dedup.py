"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every partition sends each owner of a hash range the sorted, Golomb-Rice coded fingerprints of its documents. The owner
answers with one bitmap per message: the fingerprints that some other partition sent too. Documents so marked, or repeated
within their partition, are suspects; only their texts are shuffled, and grouping by the whole text verifies them byte for
byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, empty_if_null, materialize, partitions, table

#: Suspect fingerprints (8 bytes each) that are broadcast at most; beyond it the semi-join shuffles.
BROADCAST_FINGERPRINTS = 1 << 20
SPARE_BITS = 10


def normalized(text: Column) -> Column:
    return F.regexp_replace(empty_if_null(text), r"[\x20\x09-\x0D]+", " ")


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct unsigned integers as (parameter, unary quotients of the gaps, remainders of fixed width)."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = float(values[-1]) / len(values) if len(values) else 0.0
    k = max(0, int(math.log2(mean))) if mean >= 1 else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.uint8)
    unary[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    bits = ((gaps[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    remainders = (bits << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + remainders, dtype=np.uint64)


def _bounds(owners: int, bits: int) -> np.ndarray:
    """First short hash of each owner's range."""
    return np.array([-(-(o << bits) // owners) for o in range(owners)], dtype=np.uint64)


def suspect_prints(base: DataFrame, rows: int, bits: int, rows_per_owner: int = 1 << 22) -> DataFrame:
    """short: the distinct short hashes (the first `bits` of fp) that more than one row of base has. Never misses one.

    A partition codes its fingerprints where they lie, so that only coded messages are shuffled: to the owners with a
    bitmap of what is repeated within the partition, and back with a bitmap of what others sent too.
    """
    owners = max(partitions(base.sparkSession), -(-rows // rows_per_owner))
    low = _bounds(owners, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [x.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits) for x in batches if len(x)]
        if not parts:
            return
        hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.append(np.searchsorted(hashes, low), len(hashes))
        out = []
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[o], cuts[o + 1])
            out.append((o, cuts[o + 1] - cuts[o], *rice_encode(hashes[part] - low[o]), np.packbits(counts[part] > 1).tobytes()))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        source = pa.array([TaskContext.get().partitionId()] * len(out), pa.int32())
        yield pa.RecordBatch.from_arrays([source, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["src", "owner", "n", "k", "unary", "rest", "twice"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [rice_decode(*x) for x in zip(pdf["n"], pdf["k"], pdf["unary"], pdf["rest"], strict=True)]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[counts > 1]
        return pd.DataFrame({"src": pdf["src"], "owner": pdf["owner"], "bitmap": [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in parts]})

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for owner, n, k, unary, rest, twice, bitmap in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                bits_of = lambda b: np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n].astype(bool)  # noqa: B023, E731
                found.append(rice_decode(n, k, unary, rest)[bits_of(twice) | bits_of(bitmap)] + low[owner])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["short"])

    sent = materialize(base.select("fp").mapInArrow(send, "src int, owner int, n int, k int, unary binary, rest binary, twice binary"))
    answers = sent.select("src", "owner", "n", "k", "unary", "rest").groupBy("owner").applyInPandas(answer, "src int, owner int, bitmap binary")
    both = sent.join(answers, ["src", "owner"]).select("owner", "n", "k", "unary", "rest", "twice", "bitmap")
    out = materialize(both.mapInArrow(receive, "short long").distinct())
    discard(sent)
    return out


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of blanks (space, tab to carriage return) becomes one space; a null
    text counts as empty. Of equal texts the row with the smallest key stays (a null key counts as the largest); of
    repeated rows with the same key exactly one stays. Other columns of docs are ignored; an empty table gives an
    empty result.
    """
    norm = normalized(F.col(text))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), norm.alias("norm"))
    base = materialize(rows.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("uid")))
    n = base.count()
    bits = min(62, max(1, n).bit_length() + SPARE_BITS)
    prints = suspect_prints(base, n, bits)
    if prints.count() <= BROADCAST_FINGERPRINTS:
        prints = F.broadcast(prints)
    short = F.shiftrightunsigned("fp", 64 - bits).alias("short")
    marked = materialize(base.withColumn("short", short).join(prints.withColumn("suspect", F.lit(True)), "short", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False))))
    suspects = marked.where("suspect")
    same = rows.withColumn("short", F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits)).join(prints, "short", "left_semi").groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"))
    verified = same.where("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    first = suspects.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("first"))
    leaders = materialize(first.join(verified, "sha").select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "group_size"))
    discard(base)
    out = suspects.join(leaders, "sha", "left").select("doc_id", "uid", "sha", "keep_id", "keep_uid", "group_size")
    alone = marked.where("not suspect").select("doc_id", "uid", "sha", *(F.lit(None).cast("long").alias(c) for c in ("keep_id", "keep_uid", "group_size")))
    return out.unionByName(alone).select(
        "doc_id",
        F.when(F.col("keep_uid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

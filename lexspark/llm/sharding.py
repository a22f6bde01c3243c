"""A uniform shuffle into shards of exact size, by DataFrame operations alone.

The counts of the communication matrix (rows that each source sends to each shard) are drawn from the multivariate
hypergeometric distribution that a uniform permutation of all rows would give. Each source then permutes its own rows and
deals them out by those counts, and each shard permutes what it has received, in blocks of random places.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows that one block, the unit of the second permutation, holds about; sources, the units of the first, at most. The
#: driver draws one number for each source and shard.
BLOCK_ROWS = 1 << 22
SOURCES = 4096
#: Bytes of the matrix that are broadcast at most; a larger one is joined by a shuffle on the source.
BROADCAST_MATRIX = 32 << 20


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Good ones among the draws without replacement, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - peak
    up = down = peak
    a = b = mode
    while u > 0:
        moved = False
        if a < high:
            up *= (good - a) * (draws - a) / ((a + 1) * (bad - draws + a + 1))
            a, u, moved = a + 1, u - up, True
            if u <= 0:
                return a
        if b > low:
            down *= b * (bad - draws + b) / ((good - b + 1) * (draws - b + 1))
            b, u, moved = b - 1, u - down, True
            if u <= 0:
                return b
        if not moved or (up == 0 and down == 0):
            break
    return mode


def deal(total: int, capacities: list[int], rng: random.Random) -> list[int]:
    """How many of total rows go to each target when every place of the targets is as likely."""
    out, places = [], sum(capacities)
    for c in capacities:
        x = hypergeometric(c, places - c, total, rng)
        out.append(x)
        total, places = total - x, places - c
    return out


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> Iterator[list[int]]:
    """For each source in turn the rows that it sends to each shard; sums meet counts and sizes exactly."""
    rng, left = random.Random(seed), list(sizes)
    for n in counts:
        row = deal(n, left, rng)
        left = [c - x for c, x in zip(left, row, strict=True)]
        yield row


def even(total: int, parts: int) -> list[int]:
    return [total * (i + 1) // parts - total * i // parts for i in range(parts)]


def shard(base: DataFrame, n_shards: int = 24, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """base with shard (0 to n_shards - 1, sizes at most one apart) and slot (gapless from 0 within the shard), which replace
    columns of these names.

    Other columns pass through, whatever their names. Rows are told apart by their place in the input, so nulls, equal
    rows, very long texts and repeated keys are rows like any other. An empty table stays empty; with fewer rows than
    shards some shards stay empty.
    """
    names = [c for c in base.columns if c not in ("shard", "slot")]
    own = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    fixed = materialize(base.select(own, F.pmod(F.spark_partition_id(), F.lit(SOURCES)).cast("int").alias("src"), F.monotonically_increasing_id().alias("uid")))
    counts = sorted((r["src"], r["count"]) for r in fixed.groupBy("src").count().collect())  # SOURCES rows at most
    total = sum(c for _, c in counts)
    sizes = even(total, n_shards)
    ends = [(src, list(accumulate(row))) for (src, _), row in zip(counts, communication_matrix([c for _, c in counts], sizes, seed), strict=True)]
    plan = base.sparkSession.createDataFrame(ends, "src int, ends array<long>")
    nth = F.row_number().over(W.partitionBy("src").orderBy(F.xxhash64("uid", F.lit(seed)), "uid")) - F.lit(1)
    blocks = max(1, -(-total // (n_shards * block_rows)))
    sent = (
        fixed.withColumn("nth", nth.cast("long"))
        .join(F.broadcast(plan) if 8 * n_shards * len(ends) <= BROADCAST_MATRIX else plan, "src")
        .select("row", "uid", F.expr("size(filter(ends, e -> e <= nth))").alias("shard"), F.xxhash64("uid", F.lit(seed + 1)).alias("place"))
        # a block is a range of places, so that the blocks of a shard one after the other are in order of place
        .withColumn("block", F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * F.lit(blocks)).cast("int"))
    )
    if blocks > 1:
        sent = materialize(sent)
        # n_shards x blocks rows
        first = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
        first = first.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("first"))
        sent = sent.join(first, ["shard", "block"])
    else:
        sent = sent.withColumn("first", F.lit(0).cast("long"))
    again = F.row_number().over(W.partitionBy("shard", "block").orderBy("place", "uid")) - F.lit(1)
    return sent.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "shard", (again + F.col("first")).cast("long").alias("slot"))


def op4_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard(base, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

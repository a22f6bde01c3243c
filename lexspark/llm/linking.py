"""Linking all that is near within buckets, by rounds of leaders, without listing the pairs of what is linked already, and by
comparing all that the rounds leave apart in large buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components_of, discard, materialize, sized, together

#: Buckets with this many members or fewer have their pairs listed: at most eight pairs a member.
SMALL = 16
#: Rounds of leaders on the same buckets before their members are dealt into finer ones; levels of these at most.
ROUNDS, LEVELS = 2, 40


def link_buckets(
    rows: DataFrame, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame, int], DataFrame], possible: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """a, b: edges between near nodes that share buckets; near nodes that share a bucket are in one component of them.

    rows: bucket long, node long. In each round every member of a bucket meets one leader of it, unless they are linked
    already (verify: distinct pairs a, b -> a, b, ok). A bucket is done when its members are in one component; one of SMALL
    members or fewer has its pairs compared after the first round. The members of larger ones are dealt into finer buckets
    after ROUNDS rounds (refine: node, level from 0 on -> bucket, node), in which near ones should meet again and which
    should shrink from level to level; those alone in theirs are done, and so are all after LEVELS levels. So the rows of a
    round are in proportion to those of its buckets, however large a bucket is. Finer buckets may part what is near: last,
    of the large buckets that still hold several components, every pair of these is compared that has not met (possible:
    bucket, node, component -> pairs a > b with no near one left out; without it all such pairs are listed). A repeated row
    costs a comparison of its own; no rows give no edges.
    """
    spark = rows.sparkSession
    own = _shared(rows.select("bucket", "node"))
    links, met, large = [], [], None
    for k in range(ROUNDS * LEVELS):
        live = _live(own)
        if live.isEmpty():
            discard(live)
            break
        if k == ROUNDS:
            large = materialize(live.select("bucket", "node"))
        if k and k % ROUNDS == 0:
            nodes = materialize(live.select("node", "component").distinct())
            own = _shared(refine(nodes.select("node"), k // ROUNDS - 1).select("bucket", "node"), nodes)
            discard(live, nodes)
            live = _live(own)
        pairs = materialize(_unmet(_pairs(live, k), met))
        met.append(pairs)
        ok = materialize(verify(pairs).where("ok").select("a", "b"))
        links.append(ok)
        parts = components_of(pairs.join(ok, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        left = live.where(F.col("n") > SMALL) if k % ROUNDS else live
        left = left.join(parts.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        own = materialize(left.select("bucket", "node", F.coalesce("to", "component").alias("component")))
        discard(live, parts)
    else:
        discard(own)
    if large is not None:
        parts = components_of(together(links))
        live = _live(materialize(large.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))))
        left = possible(live.drop("n")) if possible else _listed(live).select("a", "b")
        left = materialize(_unmet(left.distinct(), met))
        links.append(materialize(verify(left).where("ok").select("a", "b")))
        discard(large, parts, live, left)
    discard(*met)
    return together(links) if links else spark.createDataFrame([], "a long, b long")


def _shared(rows: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """rows (bucket, node) of the buckets with several rows, and the component: by parts (node, component), or the node. Most
    finer buckets hold one node, so only what is left is joined with parts."""
    sizes = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    some = rows.join(sized(sizes), "bucket")
    some = some.join(parts, "node") if parts is not None else some.withColumn("component", F.col("node"))
    out = materialize(some.select("bucket", "node", "component"))
    discard(sizes)
    return out


def _unmet(pairs: DataFrame, met: list[DataFrame]) -> DataFrame:
    return pairs.join(together(met).select("a", "b"), ["a", "b"], "left_anti") if met else pairs


def _side(rows: DataFrame, node: str, part: str) -> DataFrame:
    return rows.select("bucket", F.col("node").alias(node), F.col("component").alias(part))


def _listed(rows: DataFrame) -> DataFrame:
    """All pairs a > b of the buckets of different components ca, cb."""
    return _side(rows, "a", "ca").join(_side(rows, "b", "cb"), "bucket").where("a > b and ca <> cb")


def _live(own: DataFrame) -> DataFrame:
    """own (bucket, node, component), which is deleted, with n, the number of the bucket's nodes, where the bucket holds
    several components."""
    state = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    state = materialize(state.where("low < high").select("bucket", "n"))
    live = materialize(own.join(state, "bucket"))
    discard(own, state)
    return live


def _pairs(live: DataFrame, k: int) -> DataFrame:
    """a > b of different components ca, cb: each member with the leader of its bucket, and from the second round on the
    buckets the pairs of the small ones."""
    listed = F.col("n") <= SMALL if k % ROUNDS else F.lit(False)  # at first leaders do, as most small buckets hold one group
    small, large = live.where(listed), live.where(~listed)
    # the same nodes lead in all buckets that they share, so that a pair is seldom met twice
    order = F.xxhash64("node", F.lit(k)) if k else F.col("node")
    leaders = materialize(large.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), order).alias("l")).select("bucket", F.col("l.node").alias("b"), F.col("l.component").alias("cb")))
    found = _side(large, "a", "ca").join(leaders, "bucket").where("ca <> cb and a <> b").unionByName(_listed(small))
    swap = F.col("a") < F.col("b")
    return found.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("ca"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("cb")
    ).distinct()

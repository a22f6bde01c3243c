"""Rows that joins by node make over a large bucket: a few for each member, however many buckets hold it."""

import random
import re

from pyspark.sql import functions as F

from lexspark.llm import overlap
from lexspark.llm.linking import link_buckets
from lexspark.llm.minhash_dedup import SIMILARITY, near, shingles

from .test_near_copies import changed

COMMON, FINER = 8, 12


def joined(spark, since):
    """Rows that the inner joins by node of the executions from `since` on have made, and the number after the last one."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, rows = store.executionsList(), 0
    ids = [runs.apply(i).executionId() for i in range(runs.size())]
    for run in (i for i in ids if i >= since):
        nodes, made = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[node#\d+L?\], \[node#\d+L?\], Inner", node.desc()):
                of = (node.metrics().apply(i) for i in range(node.metrics().size()))
                found = [made.get(m.accumulatorId()) for m in of if m.name() == "number of output rows"]
                rows += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return rows, max(ids, default=-1) + 1


def test_joins_by_node_make_a_few_rows_a_member(spark):
    """Members of COMMON large buckets, each alone in FINER finer ones; every pair is found all the same."""
    n = 60
    rng = random.Random(n)
    texts = []
    for _ in range(n // 2):
        own = [f"w{rng.randrange(3000)}" for _ in range(40)]
        texts += [own, changed(own, rng, 6)]
    rows = spark.createDataFrame([(b, i) for b in range(COMMON) for i in range(n)], "bucket long, node long")
    marks = spark.createDataFrame([(i, len(t), bytearray(overlap.mark(shingles(t, 1)))) for i, t in enumerate(texts)], "node long, n long, mark binary")

    def refine(nodes, level):
        return nodes.select(F.explode(F.sequence(F.col("node") * FINER, F.col("node") * FINER + FINER - 1)).alias("bucket"), "node")

    close = F.udf(lambda a, b: near(texts[a], texts[b]), "boolean")
    _, since = joined(spark, 0)
    found = link_buckets(rows, lambda pairs: pairs.select("a", "b", close("a", "b").alias("ok")), refine, lambda left: overlap.possible(left, marks, SIMILARITY))
    assert {(r.a, r.b) for r in found.collect()} == {(i + 1, i) for i in range(0, n, 2)}
    assert joined(spark, since)[0] <= 4 * n

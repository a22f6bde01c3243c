"""Links within buckets against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexspark.llm import embedding_dedup, queries
from lexspark.llm.common import components_of, edges_to_components
from lexspark.llm.linking import link_buckets


def components(nodes, linked):
    part = {n: n for n in nodes}

    def top(n):
        while part[n] != n:
            n = part[n]
        return n

    for x in nodes:
        for y in nodes:
            if x < y and linked(x, y):
                a, b = sorted((top(x), top(y)))
                part[b] = a
    return {n: top(n) for n in nodes}


def test_components_by_one_task_and_by_rounds(spark):
    """Random edges, a chain, a star, loops and repeated edges, contracted whole, in parts that one task finishes, and in
    parts that the rounds finish."""
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(90)] + [(700, 701 + i) for i in range(90)] + [(900, 900), (700, 701)]
    part = {}
    top = lambda n: n if part.get(n, n) == n else top(part[n])
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        part[y] = x
    wanted = {n: top(n) for a, b in edges if a != b for n in (a, b)}
    rows = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for alone in (1 << 20, 300, 40):
        got = components_of(rows, alone).collect()
        assert len(got) == len(wanted) and {r.node: r.component for r in got} == wanted
    assert components_of(rows.limit(0)).collect() == []


def test_buckets_are_linked_by_rounds(spark):
    """Chains: few members are near the leader, a near pair shares one bucket, and finer buckets hold near ones together."""
    rng = random.Random(3)
    where = {n: rng.randrange(2000) if n < 300 else 10_000 + 3 * n for n in range(600)}
    near = lambda a, b: abs(where[a] - where[b]) <= 9
    buckets = [(t, k) for t in range(2) for k in range(2)]
    members = {b: [n for n in range(600) if rng.random() < 0.5] for b in buckets}
    rows = spark.createDataFrame([(10 * t + k, n) for (t, k), own in members.items() for n in own], "bucket long, node long")
    place = F.udf(lambda n: where[n], "int")

    def refine(nodes, level):
        width = 40 >> min(level, 1)
        at = nodes.withColumn("x", place("node"))
        return at.select(F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.floor((F.col("x") + s) / width).alias("i")) for s in (0, width // 2)))).alias("k"), "node").select(F.xxhash64("k.s", "k.i").alias("bucket"), "node")

    found = link_buckets(rows, lambda pairs: pairs.select("a", "b", (F.abs(place("a") - place("b")) <= 9).alias("ok")), refine)
    got = {r["node"]: r["component"] for r in edges_to_components(found).collect()}
    together = {(x, y) for own in members.values() for x in own for y in own}
    wanted = components(range(600), lambda x, y: (x, y) in together and near(x, y))
    whole = components(range(600), near)
    # what shares a bucket is linked; finer buckets may link more, but only what is near
    assert all(got.get(n, n) == got.get(wanted[n], wanted[n]) for n in range(600))
    assert all(whole[n] == whole[got.get(n, n)] for n in range(600))


def test_vectors_in_stars_and_chains(spark):
    rng = np.random.default_rng(5)
    x = []
    for c in range(6):
        u, v = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        x += [np.cos(a) * u + np.sin(a) * v for a in np.arange(40) * 0.1]  # a chain
        x += [z / np.linalg.norm(z) for z in u + rng.normal(size=(60, 64)) * 0.035]  # a star
    x = np.array(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= embedding_dedup.COSINE
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(rows).collect()}
    wanted = components(range(len(x)), lambda a, b: close[a, b])
    assert {n: r["component_id"] for n, r in got.items()} == wanted
    assert [got[n]["n_links"] for n in range(len(x))] == (close.sum(axis=1) - 1).tolist()


def test_query_on_planted_pairs(spark, tmp_path):
    """Pairs at cosines of 0.93 to 0.99, equal vectors, scaled ones, invalid ones, a hot group of near copies."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v)
    rows, i = [], 0
    for c in (0.93, 0.949, 0.951, 0.955, 0.96, 0.97, 0.99):
        for _ in range(40):
            z = unit(rng.normal(size=64))
            n = rng.normal(size=64)
            y = c * z + np.sqrt(1 - c * c) * unit(n - (n @ z) * z)
            rows += [(i, z.tolist()), (i + 1, (3 * y).tolist())]
            i += 2
    center = unit(rng.normal(size=64))
    rows += [(10_000 + k, (center + rng.normal(size=64) * 0.012).tolist()) for k in range(700)]
    rows += [(20_000 + k, center.tolist()) for k in range(300)] + [(30_000, None), (30_001, [0.0] * 64), (30_002, [float("nan")] * 64), (30_003, [None] * 64), (30_004, [1e-200] + [0.0] * 63), (30_005, [0.0, 1e-200] + [0.0] * 62)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.queries()["op8_embedding_dedup"](spark, str(tmp_path)).collect()}
    own = {i: unit(np.array(v) / np.abs(v).max()) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(own)
    close = (x := np.array([own[i] for i in ids])) @ x.T >= embedding_dedup.COSINE
    want = dict(zip(ids, close.sum(axis=1) - 1, strict=True))
    assert sorted(got) == sorted(i for i, _ in rows)
    links = sum(want.values())
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= want.get(i, 0) for i in got) and found >= 0.98 * links
    planted = [i for i in want if i < 10_000 and want[i]]
    assert sum(got[i].n_links == want[i] for i in planted) >= 0.9 * len(planted)
    parts = components([i for i in ids if i >= 10_000], lambda a, b: own[a] @ own[b] >= embedding_dedup.COSINE)
    assert all(got[i].component_id == part and got[i].kept == (i == part) for i, part in parts.items())

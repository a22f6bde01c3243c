"""Near pairs that the finer buckets part, and the bound by which the pairs of large buckets are compared."""

import random

from pyspark.sql import functions as F

from lexspark.llm import minhash_dedup, overlap
from lexspark.llm.linking import link_buckets
from lexspark.llm.minhash_dedup import SIMILARITY, near, shingles, sketch

from .test_linking import components
from .test_near_copies import changed


def alone(nodes, level):
    return nodes.select(F.col("node").alias("bucket"), "node")


def passages(rng, n=90):
    """Texts with a passage of half their length; some have a near copy."""
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        own = [word() for _ in range(rng.randrange(40, 80))]
        texts.append(passage + own)
        if i % 4 == 0:
            texts.append(passage + changed(own, rng, len(own) // 5))
    return texts


def test_pairs_that_finer_buckets_part_are_linked(spark):
    rows = spark.createDataFrame([(1, n) for n in range(120)], "bucket long, node long")
    found = link_buckets(rows, lambda pairs: pairs.select("a", "b", (F.floor(F.col("a") / 2) == F.floor(F.col("b") / 2)).alias("ok")), alone)
    assert {(r.a, r.b) for r in found.collect()} == {(n + 1, n) for n in range(0, 120, 2)}


def test_groups_do_not_depend_on_the_finer_buckets(spark, monkeypatch):
    texts = passages(random.Random(4))
    keys = [set(enumerate(sketch(t).tolist())) for t in texts]
    wanted = components(range(len(texts)), lambda a, b: not keys[a].isdisjoint(keys[b]) and near(texts[a], texts[b]))
    monkeypatch.setattr(minhash_dedup, "_refiner", lambda texts: lambda nodes, level: (texts.narrow(nodes), alone(nodes, level))[1])
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_groups(docs).collect()}
    whole = components(range(len(texts)), lambda a, b: near(texts[a], texts[b]))
    assert len(set(wanted.values())) < len(texts) - 15
    assert all(got[n] == got[wanted[n]] for n in got) and all(whole[n] == whole[got[n]] for n in got)


def test_bound_loses_no_near_pair(spark, monkeypatch):
    """Texts of one word to a thousand, changed, cut and lengthened, in tiles of one block and of several."""
    rng = random.Random(6)
    texts = passages(rng, 60)
    for length in (1, 2, 4, 5, 6, 60, 127, 129, 150, 500, 1000):
        first = [f"w{rng.randrange(50 if length % 2 else 5000)}" for _ in range(length)]
        texts += [first, changed(first, rng, length // 5), first[: length - length // 5], first + ["x"] * (length // 4), changed(first, rng, length // 8) + ["y"] * (length // 9)]
    part = [n // 2 if n % 6 < 2 else n for n in range(len(texts))]  # some are linked already
    part = [1000 if n < 40 and n % 3 else p for n, p in enumerate(part)]
    buckets = {n: {b for b in range(3) if rng.random() < 0.7} for n in range(len(texts))}
    rows = spark.createDataFrame([(b, n, part[n]) for n in buckets for b in sorted(buckets[n])], "bucket long, node long, component long")
    marks = spark.createDataFrame([(n, len(t), bytearray(overlap.mark(shingles(t, 1)))) for n, t in enumerate(texts)], "node long, n long, mark binary")
    pairs = {(a, b) for a in buckets for b in range(a) if buckets[a] & buckets[b] and part[a] != part[b]}
    wanted = {(a, b) for a, b in pairs if near(texts[a], texts[b])}
    assert len(wanted) > 60
    for tile in (4096, 40):
        monkeypatch.setattr(overlap, "TILE", tile)
        got = [(r.a, r.b) for r in overlap.possible(rows, marks, SIMILARITY).collect()]
        assert len(got) == len(set(got)) and wanted <= set(got) <= pairs
        assert len(got) < 3 * len(wanted)

"""Groups of varied copies, and the recall of the sketches."""

import random

from lexspark.llm import minhash_dedup, stages
from lexspark.llm.minhash_dedup import near, sketch

from .test_linking import components


def changed(own, rng, n):
    out = list(own)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def copies():
    """One text and copies of it that are near to it, but seldom to each other."""
    rng = random.Random(7)
    first = [f"w{rng.randrange(4000)}" for _ in range(100)]
    return [first, *(changed(first, rng, 12) for _ in range(79))]


def test_varied_copies_are_the_groups_of_all_pairs_in_buckets(spark):
    texts = copies()
    keys = [sketch(t) for t in texts]
    wanted = components(range(len(texts)), lambda a, b: (keys[a] == keys[b]).any() and near(texts[a], texts[b]))
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_groups(docs).collect()} == wanted


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = copies()
    groups = components(range(len(texts)), lambda a, b: near(texts[a], texts[b]))
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in stages.near_dedup(spark, docs, "").collect()}
    assert kept == set(groups.values()) == {0}


def test_recall_at_the_similarity():
    rng = random.Random(1)
    for length in (10, 40, 100, 300):
        found = 0
        for _ in range(100):
            a = [f"w{rng.randrange(20000)}" for _ in range(length)]
            b = changed(a, rng, length // 5)
            assert near(a, b)
            found += (sketch(a) == sketch(b)).any() if len(sketch(a)) == len(sketch(b)) else 0
        assert found >= 90, length


def test_large_groups_and_a_common_passage(spark):
    """A large group of near copies, and a passage of half the length in a third of the texts, some of them near pairs."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    first, passage = [word() for _ in range(100)], [word() for _ in range(60)]
    texts = [changed(first, rng, rng.randrange(1, 12)) for _ in range(250)]
    for _ in range(150):
        own = [word() for _ in range(rng.randrange(40, 80))]
        texts.append(passage + own)
        if rng.random() < 0.4:
            texts.append(passage + changed(own, rng, len(own) // 5))
    texts += [[word() for _ in range(rng.randrange(30, 120))] for _ in range(200)]
    wanted = components(range(len(texts)), lambda a, b: near(texts[a], texts[b]))
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_groups(docs).collect()}
    second = [n for n in wanted if wanted[n] != n]
    assert len(second) > 280
    assert sum(got[n] == wanted[n] for n in second) >= 0.97 * len(second)
    assert all(wanted[n] == wanted[got[n]] for n in got)

"""Near duplicates, dedup, scores and the pipeline on a planted corpus, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import minhash_dedup, queries, stages, toxicity
from lexspark.llm.minhash_dedup import near, words

TOXIC = ["scumword", "trashword", "idiotword"]
LINE = "Subscribe to our newsletter and share this page with all of your friends today."


@pytest.fixture(scope="module")
def corpus():
    """doc_id, text, source, toxic, quality."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 7)))
    lexicon = [word() for _ in range(1500)]
    rows = []
    for i in range(400):
        own = [rng.choice(lexicon) for _ in range(rng.randrange(60, 160))]
        toxic, good = i % 6 == 5, i % 4 != 3
        if toxic:
            at = rng.randrange(len(own))
            for k in range(5):
                own.insert(at + 3 * k, rng.choice(TOXIC))
        text = " ".join(own) if good else " | ".join(own)
        if i % 7 == 0 and not toxic:
            text += "\n" + LINE
        rows.append((i, text, f"s{i % 12}", int(toxic), int(good)))
    clean = [r for r in rows if not r[3] and r[4]]
    for k in range(30):
        # near copies of a clean text, and one exact copy
        own = clean[k % 5][1].split("\n")[0].split()
        for _ in range(3):
            own[rng.randrange(len(own))] = word() + "x"
        rows.append((1000 + k, " ".join(own), f"s{k % 3}", 0, 1))
    rows.append((2000, clean[7][1], "s1", 0, 1))
    return rows


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(r[0], r[1], r[2]) for r in corpus], "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], r[4], r[3]) for r in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _groups(rows):
    """Smallest id of each row's component under the similarity of all pairs."""
    parent = {i: i for i, *_ in rows}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = [(r[0], words(r[1])) for r in rows]
    for n, (i, a) in enumerate(own):
        for j, b in own[:n]:
            if near(a, b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_groups(spark, corpus, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_groups(docs).collect()}
    assert got == _groups(corpus)


def test_exact_dedup(spark, corpus, folder):
    got = {r.doc_id: r.keep_id for r in queries.queries()["op3_exact_dedup"](spark, folder).collect()}
    first = {}
    for r in corpus:
        first.setdefault(exact_text(r[1]), r[0])
    assert got == {r[0]: first[exact_text(r[1])] for r in corpus}


def exact_text(t):
    return " ".join(t.replace("\n", " ").split(" "))


def test_line_dedup(spark, corpus, folder):
    got = {r.doc_id: r.text for r in queries.queries()["op9_line_dedup"](spark, folder).collect()}
    with_line = [r[0] for r in corpus if r[1].endswith("\n" + LINE) or LINE in r[1].split("\n")]
    assert len(with_line) > 30
    for r in corpus:
        want = r[1] if r[0] not in with_line[1:] else "\n".join(x for x in r[1].split("\n") if x != LINE)
        assert got[r[0]] == want


def test_held_out_accuracy(spark, corpus, folder):
    truth = {r[0]: r for r in corpus}
    for name, column in (("op2_toxicity", 3), ("op6_quality", 4)):
        rows = [r for r in queries.queries()[name](spark, folder).collect() if r.held_out]
        assert len(rows) > 60
        right = sum(r.predicted == truth[r.doc_id][column] for r in rows) / len(rows)
        assert right > 0.9, (name, right)


def test_pipeline_by_stage(spark, corpus, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "pii", "packing"]
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in stages.toxicity(spark, docs, folder).collect()}
    assert kept == {r[0] for r in corpus if model.probability(r[1]) < stages.TOXIC}
    toxic = {r[0] for r in corpus if r[3]}
    assert len(toxic & kept) <= 0.1 * len(toxic) and len(kept - toxic) >= 0.98 * (len(corpus) - len(toxic))
    cleaned = stages.line_dedup(spark, docs, folder).collect()
    assert sum(LINE in r.text for r in cleaned) == 1
    assert all(r.n_chars == len(r.text) for r in cleaned)
    assert {r.doc_id for r in stages.near_dedup(spark, docs, folder).collect()} == set(_groups(corpus).values())


def test_pipeline(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    loads = {}
    for r in rows:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 1024
    ids = {r.doc_id for r in rows}
    assert sum(1000 <= i < 1030 for i in ids) == 0 and 2000 not in ids and len(ids) > 300

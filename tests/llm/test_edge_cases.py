"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexspark.llm import bpe, embedding_dedup, exact_dedup, line_dedup, minhash_dedup, packing, pii, quality, sharding, stages, toxicity
from lexspark.llm.common import edges_to_components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_exact_dedup(odd, odd_rows):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(odd_rows)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for r in odd_rows:
        groups.setdefault(hashlib.sha256(norm(r[1]).encode()).hexdigest(), []).append(r[0])
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    for sha in groups:
        assert sum(r.kept for r in rows if r.text_sha256 == sha) == 1


def test_sharding(odd, odd_rows):
    rows = sharding.shard(odd, 5, block_rows=2).collect()
    assert sorted(str(r.text) for r in rows) == sorted(str(r[1]) for r in odd_rows)
    sizes = [sum(r.shard == s for r in rows) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_line_dedup(odd, odd_rows):
    rows = line_dedup.line_dedup(odd, min_sites=2).collect()
    assert len(rows) == len(odd_rows)
    assert {r.n_lines for r in rows if r.text is None} == {0}
    # the line stands on three sites; its first document, of which there are two equal rows, keeps it
    assert sorted((r.doc_id or 0, r.n_dropped) for r in rows if r.n_dropped) == [(0, 1), (7, 1), (9, 1)]
    assert all(r.n_dropped == 0 for r in rows if r.doc_id == 4)


def test_bpe(odd, odd_rows):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in odd_rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.bpe_digest(odd, RANKS).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    back = bpe.bpe_decode(bpe.bpe_encode(odd, RANKS), RANKS).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r[1] or "").encode() for r in odd_rows)


def test_packing(odd, odd_rows):
    rows = packing.pack(packing.token_pieces(odd, TOKENIZER)).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert {r.ids_crc32 for r in rows if r.doc_id == 1} == {zlib.crc32(b"\x02\0\0\0")}


def test_pii(odd, odd_rows):
    rows = pii.pii_spans(odd).collect()
    assert len(rows) == len(odd_rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert sorted(map(str, pii.redact(odd).toPandas()["text"])) == sorted(str(r[1]) for r in odd_rows)


def test_minhash(odd, odd_rows):
    rows = minhash_dedup.near_groups(odd).collect()
    assert len(rows) == len(odd_rows)
    same = [r for r in rows if r.class_id == 4]
    assert len(same) == 4 and {r.group_size for r in same} == {4} and sum(r.kept for r in same) == 1
    blank = [r for r in rows if r.class_id == 1]
    assert len(blank) == 4 and sum(r.kept for r in blank) == 1
    kept = minhash_dedup.near_dedup(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.kept for r in rows)


def test_scores(odd, odd_rows, labels):
    for module in (toxicity, quality):
        rows = module.score(odd, module.train(odd, labels)).collect()
        assert len(rows) == len(odd_rows)
        assert all(0 <= r.score <= 1 for r in rows)
        by_text = {}
        for r in rows:
            by_text.setdefault(r.text, set()).add(r.score)
        assert all(len(s) == 1 for s in by_text.values())


def test_vectors(spark):
    a, b = [1.0] + [0.0] * 7, [1.0, 0.1] + [0.0] * 6
    rows = [(1, a), (2, b), (2, b), (3, [0.0] * 8), (4, None), (5, [None] + a[1:]), (6, [float("nan")] + a[1:]), (7, [2.0, 0.0]), (8, [-x for x in a]), (None, a), (9, []), (10, [1e-200] + [0.0] * 7)]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, uid string, component long")).collect()
    assert len(got) == len(rows)
    near = {(r.vec_id, r.n_links, r.component_id) for r in got if r.n_links}
    assert near == {(1, 3, 1), (2, 3, 1), (None, 3, 1)}
    assert all(r.component_id == r.vec_id and r.kept for r in got if not r.n_links)


def test_empty_tables(empty, labels, spark):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert bpe.bpe_digest(empty, RANKS).count() == 0
    assert packing.pack(packing.token_pieces(empty, TOKENIZER)).count() == 0
    assert pii.pii_spans(empty).count() == 0
    assert minhash_dedup.near_groups(empty).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages(spark, request, labels, tmp_path, rows):
    docs = request.getfixturevalue(rows)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (stages.toxicity, stages.line_dedup, stages.near_dedup, stages.redaction):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{stage.__name__}")
        docs = spark.read.parquet(f"{tmp_path}/{stage.__name__}")
    packed = stages.best_fit(spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == docs.count()


CLASHES = ["_uid", "_src", "_ends", "_cuts", "_n", "_m", "_block", "_drop", "_d", "_k", "_before", "_p", "_rank", "row", "uid", "src", "place", "gone", "digest", "at", "length", "nth", "block", "first", "n_lines", "p", "a.b"]


def test_columns_of_any_name_pass_through(odd, odd_rows, labels, tmp_path, spark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    wide = odd.select("doc_id", "text", "source", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in CLASHES))
    ours = lambda df, skip=(): all(r[c] == f"{c}:{'' if r['doc_id'] is None else r['doc_id']}" for r in df.collect() for c in CLASHES if c not in skip)
    for stage in (stages.toxicity, stages.line_dedup, stages.near_dedup, stages.redaction):
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns and ours(out), stage
    out = sharding.shard(wide, 3, block_rows=2)
    assert out.columns == [*wide.columns, "shard", "slot"] and ours(out)
    out = line_dedup.line_dedup(wide, min_sites=2)
    assert ours(out, {"n_lines"}) and out.count() == len(odd_rows)
    pieces = packing.token_pieces(odd, TOKENIZER).select("doc_id", F.col("length"), *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in CLASHES if c != "length"))
    assert ours(packing.pack(pieces), {"length"})
    assert minhash_dedup.near_groups(wide).count() == exact_dedup.exact_dedup(wide).count() == pii.pii_spans(wide).count() == bpe.bpe_digest(wide, RANKS).count() == len(odd_rows)


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        edges_to_components(chain, rounds=1)
    assert {r.component for r in edges_to_components(chain).collect()} == {0}

"""Queries without SQL on whole tables against plain Python, null ids and texts included."""

import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lexspark.llm import pii, queries

from .test_methods import _base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    """The documents of a test table, and odd ones."""
    own = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text", "lang", "source"]).to_pylist()
    odd = [(900_001, None), (900_002, ""), (None, "mail a.b@c.org or 10.0.0.1"), (900_003, "x <|endoftext|> y 🔥 4111 1111 1111 1111"), (None, None), (900_004, own[0]["text"])]
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in own] + [(i, t, None, None) for i, t in odd]


@pytest.fixture(scope="module")
def folder(rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    ids, texts, langs, sources = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs, "source": sources}), path / "documents.parquet")
    labels = pq.read_table(f"{SF}/labels.parquet")
    pq.write_table(labels, path / "labels.parquet")
    return str(path)


def run(spark, folder, name):
    return [r.asDict() for r in queries.queries()[name](spark, folder).collect()]


def key(r):
    return tuple(map(str, r))


def test_sharding(spark, rows, folder):
    got = run(spark, folder, "op4_sharding")
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(want, key=key)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing(spark, rows, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if not k else start + 1024]
            want.append((i, k, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    got = run(spark, folder, "op5_packing")
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    loads = defaultdict(list)
    for r in got:
        loads[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in loads.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(loads) <= 1.02 * -(-sum(w[3] for w in want) // 1024) + 1


def test_pii(spark, rows, folder):
    want = []
    for i, t, *_ in rows:
        spans = _base(t or "")
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in spans)
        want.append((i, *(sum(x[2] == k for x in spans) for k in range(4)), hashlib.sha256(said.encode()).hexdigest()))
    got = run(spark, folder, "op7_pii")
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(sum(w[1:5]) for w in want) > 5
    texts = {(i, t) for i, t, *_ in rows}
    assert all(x.split(":")[0] in pii.KINDS for r in got for x in r["spans"].split(",") if x) and len(texts) > 100


@pytest.mark.parametrize("name, mod, rest, bound", [("op2_toxicity", 3, 1, 0.7), ("op6_quality", 5, 0, 0.3)])
def test_scores(spark, rows, folder, name, mod, rest, bound):
    got = run(spark, folder, name)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bound)
    # equal texts, ids apart, have one score
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[900_004] == by_id[rows[0][0]] and by_id[900_001] == by_id[900_002]

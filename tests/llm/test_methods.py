"""The methods' parts against their definitions."""

import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexspark.llm import bpe, embedding_dedup, packing, pii, sharding, toxicity
from lexspark.llm.alignment import within
from lexspark.llm.exact_dedup import rice_decode, rice_encode
from lexspark.llm.minhash_dedup import near, sketch

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TREE = bpe.TreeBpe(RANKS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=18), st.lists(st.sampled_from("abcd"), max_size=18), st.integers(0, 9))
def test_banded_alignment(a, b, limit):
    assert within(a, b, limit) == (distance(a, b) <= limit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the ing\n'sé漢🔥 1"), max_size=300))
def test_tree_reduction(text):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    cache = bpe.piece_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = ",".join(v[0] for v in cache.texts([text])[0])
    assert got == ",".join(map(str, library.encode_ordinary(text)))
    data = text.encode()
    assert TREE.encode(data) == TREE._merge_long(data) if data else TREE.encode(data) == []
    assert TREE.decode(TREE.encode(data)) == data


def test_every_piece_of_real_text_is_joined_up_the_tree():
    import pyarrow.parquet as pq

    texts = [t.as_py() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"] if t.as_py()]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    tree = bpe.TreeBpe(RANKS)
    cache = bpe.PieceCache(public_tokenizers.PATTERN, lambda ps: [tree.encode(p.encode()) for p in ps], lambda xs: [i for x in xs for i in x])
    for text, values in zip(texts, cache.texts(texts), strict=True):
        assert [i for v in values for i in v] == library.encode_ordinary(text)
    # at least one join for each distinct piece of two bytes or more
    pieces = {p for t in texts for p in cache.pattern.findall(t) if len(p.encode()) > 1}
    assert tree.joins >= len(pieces) > 1000


def test_splits_of_any_characters():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    cache = bpe.piece_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 32, 10, 0x1C, 0x85])) for _ in range(rng.randrange(25)))
        assert ",".join(v[0] for v in cache.texts([text])[0]) == ",".join(map(str, library.encode_ordinary(text)))


def test_long_alignment_in_memory_of_its_length():
    import tracemalloc

    rng = random.Random(1)
    a = [f"w{i}" for i in range(300_000)]
    b = list(a)
    for i in rng.sample(range(len(a)), 200):
        b[i] = f"x{i}"
    tracemalloc.start()
    assert near(a, b) and not near(a, [f"y{i}" for i in range(300_000)])
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_long_pieces():
    for data in (b"a" * 5000, b"the" * 3000, bytes(random.Random(1).choices(range(256), k=4000))):
        assert TREE.encode(data) == TREE._merge_long(data)


def test_ids_are_those_of_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    assert packing.encoder(path)("x <|endoftext|> y") == [87, 220, 50256, 331]
    alphabet = [chr(c) for c in [*range(32, 127), 10, 9, 0xE9, 0x4E2D, 0x1F600, 0xA0, 0x85]]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(120))) + rng.choice(["", "", "<|endoftext|>"])
        assert packing.encoder(path)(text) == library.encode(text, add_special_tokens=False).ids


def _optimum(items, size):
    """Fewest bins, by trying all placements."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - items[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, size - items[i]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(150):
        size = rng.choice([10, 16, 30])
        items = sorted((rng.randrange(1, size) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = {w: items.count(w) for w in items}
        fixed, left = packing.reduce_instance(counts, size)
        rest = sorted((w for w, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + _optimum(rest, size) == _optimum(items, size)
        rows, n = packing.plan(counts, size)
        assert n >= _optimum(items, size) and len(rows) <= len(items)


def _by_definition(scores):
    best = max(((i, j, sum(scores[i:j])) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (x[2], -x[0]), default=None)
    if not best or best[2] <= 0:
        return []
    i, j, s = best
    return _by_definition(scores[:i]) + [(i, j, s)] + [(i2 + j, j2 + j, s2) for i2, j2, s2 in _by_definition(scores[j:])]


def test_all_maximal_segments():
    rng = random.Random(2)
    for _ in range(1500):
        s = [rng.choice([-1.01, -0.5, 0.3, 1.2, 2.0]) + rng.random() * 1e-3 for _ in range(rng.randrange(14))]
        assert [x[:2] for x in toxicity.segments(s)] == [x[:2] for x in _by_definition(s)]


def test_rice_codes():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 8), (1, 40), (500, 24), (3000, 60)):
        values = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
        k, unary, rest = rice_encode(values)
        assert (rice_decode(len(values), k, unary, rest) == values).all()


def test_communication_matrix():
    counts, sizes = [7, 0, 13, 5], [8, 8, 9]
    draws = np.array([next(sharding.communication_matrix(counts, sizes, seed)) for seed in range(4000)])
    matrix = list(sharding.communication_matrix(counts, sizes, 1))
    assert [sum(row) for row in matrix] == counts
    assert [sum(r[i] for r in matrix) for i in range(len(sizes))] == sizes
    # mean and variance of the hypergeometric distribution
    assert np.allclose(draws.mean(axis=0), [7 * 8 / 25, 7 * 8 / 25, 7 * 9 / 25], atol=0.07)
    assert np.allclose(draws[:, 0].var(), 7 * (8 / 25) * (17 / 25) * (18 / 24), atol=0.1)


def test_e8_decoding():
    y = np.random.default_rng(0).normal(0, 2, (500, 8))
    p = embedding_dedup.decode(y)
    assert len(embedding_dedup._NEAR) == 240
    near_points = [((y - p - v) ** 2).sum(axis=1) for v in embedding_dedup._NEAR]
    assert (np.min(near_points, axis=0) >= ((y - p) ** 2).sum(axis=1) - 1e-9).all()


def test_recall_of_cells_at_the_threshold():
    rng = np.random.default_rng(5)
    z = rng.normal(0, 1, (1500, 64))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    n = rng.normal(0, 1, z.shape)
    n -= (n * z).sum(axis=1, keepdims=True) * z
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    y = 0.951 * z + np.sqrt(1 - 0.951**2) * n
    hit = np.zeros(len(z), bool)
    for t in range(embedding_dedup.TABLES):
        a, b = embedding_dedup.cells(z, t), embedding_dedup.cells(y, t)
        hit |= (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    assert hit.mean() > 0.95


def test_sketches_of_similar_texts():
    rng = random.Random(6)
    missed = 0
    for _ in range(100):
        a = [f"w{rng.randrange(5000)}" for _ in range(300)]
        b = list(a)
        for _ in range(6):
            b[rng.randrange(len(b))] = "x"
        assert near(a, b)
        missed += not (sketch(a) == sketch(b)).any()
    assert missed == 0
    assert not (sketch([f"a{i}" for i in range(300)]) == sketch([f"b{i}" for i in range(300)])).any()
    # the order counts: the halves of b stand the other way round
    a = [f"w{i}" for i in range(200)]
    assert (sketch(a) == sketch(a[100:] + a[:100])).mean() < 0.6


BASE = ("email", "ip", "card", "phone")


def _base(text):
    import re

    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans():
    rng = random.Random(5)
    for _ in range(6000):
        s = "".join(rng.choices("ab1.@-_ 0+(2)5", k=rng.randrange(40)))
        assert pii.base_spans(s)[0] == _base(s)
    assert pii.base_spans("4111 1111 1111 1111 and 10.0.0.1")[0] == [(0, 19, 2), (24, 32, 1)]


def test_added_spans():
    model = pii.trained()
    texts = ["write to jane [at] mail [dot] example [dot] com please", "host 10[.]1[.]2[.]3 is up", "call me at 555-123-4567 today", "on 2024-01-02 we met", "version 1.2.3 of 2020"]
    added = [len(s) - len(b) for b, s in pii.find_spans(texts, model)]
    assert added[:3] == [1, 1, 1] and added[3:] == [0, 0]
    x, y, k = pii._examples(1500, 77)
    p = model[0].probability(x)
    for kind in range(4):
        chosen = (k == kind) & (p >= model[1][kind])
        assert chosen.sum() > 20 and y[chosen].mean() > 0.94

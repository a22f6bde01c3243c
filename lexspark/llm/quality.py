"""Document quality: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing (Kanerva et al. 2000): every word has a sparse random index vector, given by its hash; a word's vector is
the sum of the index vectors of its neighbours over the whole corpus. Words share a fixed number of hash buckets, so the
vectors have one size whatever the corpus. A document is the mean vector of its tokens beside that of its distinct ones.
The network is trained in numpy on a bounded sample of labelled documents, and its temperature is fitted on a share of
them that it has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, table
from .toxicity import held_out, labelled

BUCKETS, SIZE, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Labelled documents that the network is trained on at most, about; the choice is by hash of the id.
MAX_LABELLED = 20_000
_BLOCK, _SALTS = 256, 64
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Bucket(dict):
    """Word -> bucket, kept for words met before; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = at = zlib.crc32(word.encode()) % BUCKETS
        return at


_bucket = _Bucket()


def buckets(text: str) -> np.ndarray:
    words = _TOKEN.findall(text)
    return np.fromiter(map(_bucket.__getitem__, words), dtype=np.int32, count=len(words))


def index_vectors(seed: int = 5) -> np.ndarray:
    """Per bucket NONZERO places of plus or minus one; the last row, of no word, is zero."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + 1, SIZE), dtype=np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, SIZE, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS).astype(np.float32)
    return out


def add_contexts(total: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
    """Adds to each bucket's row the index vectors of its neighbours within REACH; ids BUCKETS stand between documents."""
    own = index[ids]
    context = np.zeros_like(own)
    for d in range(1, REACH + 1):
        context[d:] += own[:-d]
        context[:-d] += own[d:]
    order = np.argsort(ids, kind="stable")
    kinds, first = np.unique(ids[order], return_index=True)
    total[kinds] += np.add.reduceat(context[order], first, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from the neighbours of every token of docs."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, total = index_vectors(), np.zeros((BUCKETS + 1, SIZE), dtype=np.float64)
        gap = np.full(REACH, BUCKETS, dtype=np.int32)
        for batch in batches:
            some, n = [], 0
            for text in batch.column(0).to_pylist():
                own = buckets(text or "")
                for at in range(0, len(own), 50_000):
                    some += [own[max(0, at - REACH) : at + 50_000] if at else own[:50_000], gap]
                    n += len(some[-2])
                    if n > 50_000:
                        add_contexts(total, np.concatenate(some), index)
                        some, n = [], 0
            if some:
                add_contexts(total, np.concatenate(some), index)
        salt = TaskContext.get().partitionId() % _SALTS
        data = total[:BUCKETS].astype(np.float32)
        blocks = range(BUCKETS // _BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([data[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "salt", "data"]
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(_BLOCK * SIZE, dtype=np.float64)
        for x in pdf["data"]:
            data += np.frombuffer(x, dtype=np.float32)
        return pd.DataFrame({"block": pdf["block"][:1], "salt": [0], "data": [data.astype(np.float32).tobytes()]})

    kind = "block int, salt int, data binary"
    sums = spread(docs.select("text")).mapInArrow(contexts, kind).groupBy("block", "salt").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind)
    # BUCKETS x SIZE numbers whatever the input
    out = np.zeros((BUCKETS, SIZE), dtype=np.float32)
    for r in sums.collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(bytes(r["data"]), dtype=np.float32).reshape(_BLOCK, SIZE)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    ids = buckets(text)
    if not len(ids):
        return np.zeros(2 * SIZE)
    counts = np.bincount(ids, minlength=BUCKETS)
    kinds = np.flatnonzero(counts)
    own = vectors[kinds]
    return np.concatenate([counts[kinds] @ own / len(ids), own.mean(axis=0)])


@dataclass
class Network:
    """tanh layer and logistic output in numpy; inputs are standardized, outputs divided by a fitted temperature."""

    hidden: int = 24
    rounds: int = 1500
    rate: float = 0.01
    ridge: float = 1e-4
    seed: int = 3
    temperature: float = 1.0
    weights: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(self.seed)
        self.center, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = rng.permutation(len(x))
        cut = len(x) // 5
        held, own = order[:cut], order[cut:]
        z = (x - self.center) / self.spread
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, self.rounds + 1):
            rows = own if len(own) <= 1024 else own[rng.integers(0, len(own), 1024)]
            h = np.tanh(z[rows] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            e = (p - y[rows]) / len(rows)
            back = np.outer(e, w[2]) * (1 - h * h)
            grads = [z[rows].T @ back + self.ridge * w[0], back.sum(axis=0), h.T @ e + self.ridge * w[2], np.array([e.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        if cut:
            logits = self.logits(x[held])
            loss = lambda t: float(np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logits / t).mean())
            self.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.center) / self.spread @ w[0] + w[1]) @ w[2] + w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all documents, the network from labelled ones that are not held out (None without both labels).

    Null texts count as empty, null ids and labels as unlabelled; of repeated labels the largest holds, and each row with a
    labelled id counts. Very long texts are read whole, other columns are ignored, an empty table gives zero vectors.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labelled(labels, "quality", mod, rest, MAX_LABELLED)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [pooled(t or "", shared.value).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    some = spread(docs.select(F.col("doc_id").cast("long").alias("_id"), "text")).join(F.broadcast(known), "_id").select("text", "y")
    got = some.mapInArrow(pool, "x array<double>, y int").orderBy(F.xxhash64("x")).collect()
    y = np.array([r["y"] for r in got], dtype=float)
    if not len(y) or y.min() == y.max():
        return vectors, None
    return vectors, Network().fit(np.array([r["x"] for r in got]), y)


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], name: str = "score") -> DataFrame:
    """docs plus the probability that label 1 holds, from the whole text of each row alone.

    Null and empty texts are the zero vector; without both labels every score is 0.5. Repeated rows, null ids and other
    columns do not matter; a column of that name is replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(c for c in docs.columns if c != name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if network is None or not texts:
                p = [0.5] * len(texts)
            else:
                p = network.probability(np.array([pooled(t or "", vectors) for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return spread(docs).mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema.fields), T.StructField(name, T.DoubleType())]))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds with an informative Dirichlet prior (Monroe et al. 2008): the prior is the corpus's own
distribution, counted over all documents. Tokens without a significant score of their own take that of their five, then
four first letters. All maximal scoring segments of a text are found in linear time (Ruzzo and Tompa 1999); their scores
become extreme-value statistics (Karlin and Altschul 1990) whose scale solves sum p exp(lambda s) = 1 over the corpus
and whose K is fitted on clean labelled texts; a logistic curve turns the aggregate into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, spread, table

#: Labelled documents that are learnt from at most, about; the choice is by hash of the id.
MAX_LABELLED = 60_000
#: Share of the labelled documents that calibrate and do not count for the token scores, by hash of the id.
CALIBRATE_MOD = 4
#: A token scores where its log-odds are STRONG or more and Z standard errors from none, in LEAST contexts or more.
Z, STRONG, LEAST, DRIFT, PRIOR = 3.5, 2.0, 5, 0.25, 0.05

_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def held_out(key: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % mod == rest, F.lit(False))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in linear time."""
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum at the end
    lower: list[int] = []  # for each of found, the last one before it with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        first, left = i, total
        total += s
        if s <= 0:
            continue
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                found.append((first, i + 1, left, total))
                lower.append(j)
                break
            # the segment from j on to here scores more than any part of it
            first, left = found[j][0], found[j][2]
            after = lower[j]
            del found[j:], lower[j:]
            j = after
    return [(a, b, r - l) for a, b, l, r in found]


@dataclass
class Toxicity:
    words: dict[str, float]
    scale: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (-2.0, 1.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, word: str) -> float:
        """Log-odds of the token, of its first five or of its first four letters, 0 where none is significant."""
        s = self.words.get(word)
        if s is None:
            s = self.words.get(word[:5] + "*")
        if s is None:
            s = self.words.get(word[:4] + "*", 0.0)
        return s

    def token_scores(self, words: list[str]) -> list[float]:
        get = self.cache.get
        out = list(map(get, words))
        if None in out:
            if len(self.cache) > 100_000:
                self.cache.clear()
            for i, s in enumerate(out):
                if s is None:
                    self.cache[words[i]] = out[i] = self.score(words[i])
        return out

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments (first token, end token, score); runs between scored tokens count as one step."""
        own = np.array(self.token_scores(words), dtype=np.float64)
        at = np.flatnonzero(own > 0)
        if not len(at):
            return []
        sums = np.concatenate([[0.0], np.cumsum(own - DRIFT)])
        steps: list[float] = []
        ends = np.append(at[1:], at[-1] + 1)
        for i, j in zip(at.tolist(), ends.tolist(), strict=True):
            steps += [own[i] - DRIFT, sums[j] - sums[i + 1]]
        return [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, s) for a, b, s in segments(steps)]

    def evidence(self, text: str) -> tuple[int, list[float]]:
        """Number of tokens, and the segments' normalized scores lambda S - ln(K n), largest first."""
        words = tokens(text)
        n = len(words)
        shift = math.log(max(self.k * n, 1e-9)) if n else 0.0
        return n, sorted((self.scale * s - shift for _, _, s in self.passages(words)), reverse=True)

    def features(self, found: list[float]) -> tuple[float, float]:
        """The best segment, and the sum over the significant ones, on a logarithmic scale."""
        best = max(found[0], 0.0) if found else 0.0
        return math.log1p(best), math.log1p(sum(x for x in found if x > 0))

    def probability(self, text: str) -> float:
        return self._probability(self.evidence(text)[1])

    def judged(self, text: str) -> tuple[float, int]:
        """The probability, and the number of significant segments."""
        _, found = self.evidence(text)
        return self._probability(found), sum(x > 0 for x in found)

    def _probability(self, found: list[float]) -> float:
        x = self.features(found)
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scale(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 where p of the mass has scores s and the rest the drift alone."""
    rest = max(0.0, 1 - p.sum())
    value = lambda x: float((p * np.exp(x * (s - DRIFT))).sum() + rest * math.exp(-x * DRIFT))
    low, high = 0.0, 1.0
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return max(low, 1e-3)


def labelled(labels: DataFrame, column: str, mod: int, rest: int, bound: int) -> DataFrame:
    """_id, y of about `bound` labelled documents at most, none of them held out; repeated labels count as the largest."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    n = max(1, rows.count())
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < bound)
    return rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(column).cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1) -> Toxicity:
    """The model from labelled documents (bounded by MAX_LABELLED) and the token counts of all documents.

    Null texts count as empty, null ids and labels as unlabelled; of repeated labels the largest holds, and each row with a
    labelled id counts. Other columns are ignored. Without documents of both labels no token scores.
    """
    known = labelled(labels, "toxic", mod, rest, MAX_LABELLED)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("_id"), "text"))
    # at most about MAX_LABELLED rows of 12 bytes
    joined = rows.join(F.broadcast(known), "_id", "left").select("text", F.when(F.pmod(F.xxhash64("_id"), F.lit(CALIBRATE_MOD)) > 0, F.col("y")).alias("y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere: Counter[str] = Counter()
        by_label: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(everywhere)
            columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (everywhere, *by_label))]
            for c in (everywhere, *by_label):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "clean", "toxic"])

        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text or "")
                everywhere.update(words)
                if y is not None:
                    by_label[y > 0].update(set(words))
                if len(everywhere) > 400_000:
                    yield flush()
        yield flush()

    by_word = joined.mapInArrow(count, "word string, n long, clean long, toxic long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "clean", "toxic")))
    by_word = materialize(by_word)
    total = by_word.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "clean", "toxic"))).first()
    if not total["toxic"] or not total["clean"]:
        return Toxicity({})
    seen = F.array("word", *(F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in (5, 4)))
    by_key = by_word.select(F.explode(seen).alias("key"), "n", "clean", "toxic").where("key is not null").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "clean", "toxic")))
    mass = PRIOR * (total["clean"] + total["toxic"])
    alpha = F.col("n") * F.lit(mass / total["n"])
    logit = lambda c: F.log((F.col(c) + alpha) / (F.lit(float(total[c]) + mass) - F.col(c) - alpha))
    significant = lambda df: (
        df.where(F.col("toxic") >= LEAST)
        .withColumn("delta", logit("toxic") - logit("clean"))
        .where((F.col("delta") >= STRONG) & (F.col("delta") / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha)) >= Z))
    )
    # bounded by the sample: every key stands in LEAST of its documents
    first = {r["key"]: r["n"] for r in significant(by_key).select("key", "n").collect()}
    found = significant(_contexts(rows, known, first)).select("key", "delta", "n").collect()
    model = Toxicity({r["key"]: float(r["delta"]) for r in found})
    own = [(r["n"], r["delta"]) for r in found if not r["key"].endswith("*")]
    p = np.array([n / total["n"] for n, _ in own])
    model.scale = _scale(p, np.array([s for _, s in own])) if own else 1.0
    _calibrate(model, rows, known)
    return model


def _contexts(rows: DataFrame, known: DataFrame, keys: dict[str, int]) -> DataFrame:
    """key, n, clean, toxic: in how many different contexts (word and the word before) the labelled documents have the
    keys. Unlike counts of documents these do not grow with copies of a text."""
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            seen: set[tuple[str, int, int]] = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = ""
                for w in tokens(text or ""):
                    for k in (w, w[:5] + "*", w[:4] + "*"):
                        if k in keys:
                            seen.add((k, zlib.crc32(f"{before} {w}".encode()), y))
                    before = w
            columns = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array([keys[k] for k in columns[0]], pa.int64())], ["key", "at", "y", "n"])

    some = rows.join(F.broadcast(known), "_id").where(F.pmod(F.xxhash64("_id"), F.lit(CALIBRATE_MOD)) > 0).select("text", "y")
    pairs = some.mapInArrow(run, "key string, at long, y int, n long").groupBy("key", "at").agg(F.max("y").alias("toxic"), F.max(1 - F.col("y")).alias("clean"), F.max("n").alias("n"))
    return pairs.groupBy("key").agg(F.max("n").alias("n"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _calibrate(model: Toxicity, rows: DataFrame, known: DataFrame) -> None:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, best, both = [], [], []
            for text in batch.column(0).to_pylist():
                words = tokens(text or "")
                found = [s for _, _, s in model.passages(words)]
                n.append(len(words))
                best.append(max(found, default=0.0))
                both.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(both, pa.list_(pa.float64()))], ["y", "n", "best", "all"])

    some = rows.join(F.broadcast(known), "_id").where(F.pmod(F.xxhash64("_id"), F.lit(CALIBRATE_MOD)) == 0).select("text", "y")
    got = some.mapInArrow(measure, "y int, n long, best double, all array<double>").collect()
    clean = [(r["n"], r["best"]) for r in got if not r["y"] and r["n"]]
    weight = sum(n * math.exp(-min(50.0, model.scale * b)) for n, b in clean)
    model.k = min(1.0, max(1e-6, len(clean) / weight)) if weight > 0 else 0.1
    x, y = [], []
    for r in got:
        shift = math.log(max(model.k * r["n"], 1e-9)) if r["n"] else 0.0
        found = [model.scale * s - shift for s in r["all"]]
        x.append((math.log1p(max([0.0, *found])), math.log1p(sum(v for v in found if v > 0))))
        y.append(r["y"])
    if 0 < sum(y) < len(y):
        model.weights = tuple(map(float, _logistic(np.array(x), np.array(y, dtype=float))))


def score(docs: DataFrame, model: Toxicity, name: str = "score") -> DataFrame:
    """docs plus the probability that label 1 holds, and n_passages, the number of significant segments.

    Null and empty texts score as texts without a scored token; very long ones are scored whole. Each row is scored on its
    own text alone, so repeated rows, null ids and other columns do not matter; columns of the two names are replaced. An
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = (name, "n_passages")
    docs = docs.select(*(c for c in docs.columns if c not in out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            p, n = [], []
            for text in batch.column(at).to_pylist():
                one, several = m.judged(text or "")
                p.append(one)
                n.append(several)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(n, pa.int64())], [*batch.schema.names, *out])

    return spread(docs).mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema.fields), T.StructField(name, T.DoubleType()), T.StructField("n_passages", T.LongType())]))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_passages")

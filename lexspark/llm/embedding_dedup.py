"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors at random to a few blocks of eight dimensions and decodes each block to the nearest point
of the E8 lattice (Conway and Sloane 1982); the points together are the cell. A vector stands in its own cell and in the
neighbouring cells that it is nearest to, in each of several tables. Vectors that share a cell are compared, in the first
cell that they share, by matrix products that give counts and a spanning forest, not pairs. Copies of a vector are one
class, and vectors within half the threshold's angle of a leader are a core: linked with each other without comparison.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components_of, discard, materialize, spread, table

COSINE, TABLES, BLOCKS, PROBES, SCALE = 0.95, 10, 2, 2, 1.6
#: Vectors of a cell that are compared at once.
TILE = 256


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_NEAR = _minimal_vectors()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    d = x[odd] - r[odd]
    k = np.abs(d).argmax(axis=1)
    r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of x."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
    h = np.full(len(points), salt, dtype=np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ doubled[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(x: np.ndarray, t: int, scale: float = SCALE, seed: int = 23) -> np.ndarray:
    """Keys of table t for unit rows of x: the own cell first, then PROBES neighbours in each block."""
    rng = np.random.default_rng([seed, t, x.shape[1]])
    keys, own, others = [], [], []
    for _ in range(BLOCKS):
        projection = rng.normal(0, 1, (x.shape[1], 8)) / scale
        y = x @ projection + rng.uniform(0, 1, 8)
        p = decode(y)
        own.append(p)
        gain = (y - p) @ _NEAR.T
        best = np.argpartition(-gain, PROBES - 1, axis=1)[:, :PROBES]
        others.append([p + _NEAR[best[:, i]] for i in range(PROBES)])
    salt = t * 1_000_003 + x.shape[1]
    keys.append(_key(np.hstack(own), salt))
    for b in range(BLOCKS):
        for q in others[b]:
            keys.append(_key(np.hstack([*own[:b], q, *own[b + 1 :]]), salt))
    return np.stack(keys, axis=1)


def units(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None for those that are null, empty, zero or hold null or non-finite
    numbers. The largest component becomes one first, so that no square overflows or vanishes."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = np.array(v, dtype=np.float64) if v and None not in v else None
        most = 0.0 if x is None else np.abs(x).max()
        if x is None or not np.isfinite(x).all() or not most > 0:
            out.append(None)
            continue
        x = x / most
        out.append(x / np.sqrt((x * x).sum()))
    return out


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and of y (of length one) have the cosine or more. Products near the threshold are summed exactly,
    so that the answer does not depend on the other rows."""
    dot = x @ y.T
    out = dot >= COSINE
    for i, j in zip(*np.nonzero(np.abs(dot - COSINE) < 1e-9), strict=True):
        out[i, j] = math.fsum(x[i] * y[j]) >= COSINE
    return out


def _rows(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1)


def _base(vectors: DataFrame) -> DataFrame:
    """vec_id, unit (binary, null where invalid), kind (digest of the unit) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                data = [None if x is None else (x + 0.0).tobytes() for x in units(part.column(1))]
                kind = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary()), pa.array(kind, pa.binary())], ["vec_id", "unit", "kind"])

    return spread(vectors).mapInArrow(run, "vec_id long, unit binary, kind binary")


def _cells(classes: DataFrame) -> DataFrame:
    """bucket, node: the cells of each class in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                ids, data = batch.column(0).slice(at, 1024).to_pylist(), batch.column(1).slice(at, 1024).to_pylist()
                for d in {len(x) for x in data}:
                    node = np.array([i for i, x in zip(ids, data, strict=True) if len(x) == d], dtype=np.int64)
                    x = np.frombuffer(b"".join(x for x in data if len(x) == d), dtype=np.float64).reshape(len(node), -1)
                    for t in range(TABLES):
                        k = cells(x, t)
                        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(node, k.shape[1]))], ["bucket", "node"])

    return classes.select("node", "unit").mapInArrow(run, "bucket long, node long")


def _cores(members: DataFrame, classes: DataFrame) -> DataFrame:
    """node, core: the least leader of the node's large cells within half the threshold's angle. Nodes of one core are linked
    with each other and need not be compared. members: bucket, node, n; the leader of a cell is its smallest node."""
    large = members.where(F.col("n") > TILE)
    leaders = materialize(large.groupBy("bucket").agg(F.min("node").alias("core")))
    met = materialize(large.join(leaders, "bucket").select("node", "core").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = math.cos(math.acos(COSINE) / 2) + 1e-9
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [len(u) == len(v) and float(np.frombuffer(u) @ np.frombuffer(v)) >= half for u, v in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["node", "core"]).filter(pa.array(ok, pa.bool_()))

    side = lambda node, name: classes.select(F.col("node").alias(node), F.col("unit").alias(name))
    near = met.join(side("node", "x"), "node").join(side("core", "y"), "core").select("node", "core", "x", "y").mapInArrow(run, "node long, core long")
    out = materialize(near.groupBy("node").agg(F.min("core").alias("core")))
    discard(leaders, met)
    return out


def _tiles(members: DataFrame) -> DataFrame:
    """members (bucket, node, n, core) plus i, j, t: a cell of up to TILE members is one group; a larger one has tiles t, and
    each pair i, j of its tiles is a group. A core with half a tile or more has tiles of its own, and pairs of these are
    left out."""
    few = members.where(F.col("n") <= TILE).select("bucket", "node", "core", *(F.lit(0).alias(c) for c in "ijt"))
    large = members.where(F.col("n") > TILE).select("bucket", "node", "core")
    sizes = large.groupBy("bucket", "core").agg(F.count(F.lit(1)).alias("m")).withColumn("own", F.when(F.col("m") * 2 >= TILE, F.col("core")))
    sizes = materialize(sizes)
    tiles = sizes.groupBy("bucket", "own").agg(F.ceil(F.sum("m") / TILE).cast("int").alias("tiles"))
    each = W.partitionBy("bucket")
    tiles = tiles.withColumn("first", (F.sum("tiles").over(each.orderBy("own")) - F.col("tiles")).cast("int")).withColumn("total", F.sum("tiles").over(each).cast("int"))
    tiles = materialize(tiles)
    other = tiles.select(F.col("bucket").alias("b2"), F.col("own").alias("o2"), "tiles", "first", "total")
    known = materialize(sizes.join(other, (F.col("bucket") == F.col("b2")) & F.col("own").eqNullSafe(F.col("o2"))).select(F.col("bucket").alias("b2"), F.col("core").alias("c2"), "own", "tiles", "first", "total"))
    placed = large.join(known, (F.col("bucket") == F.col("b2")) & F.col("core").eqNullSafe(F.col("c2")))
    placed = placed.withColumn("t", F.col("first") + F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    placed = placed.where(F.col("own").isNull() | (F.col("u") < F.col("first")) | (F.col("u") >= F.col("first") + F.col("tiles")))
    return few.unionByName(placed.select("bucket", "node", "core", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t"))


def _earlier(buckets: list[np.ndarray], here: int) -> np.ndarray:
    """Which pairs of members share a cell before this one, where they are compared."""
    own = [b[b < here] for b in buckets]
    at = np.repeat(np.arange(len(own)), [len(b) for b in own])
    kinds, column, count = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    if not shared.any():
        return np.zeros((len(own), len(own)), dtype=bool)
    _, column = np.unique(column[shared], return_inverse=True)
    has = np.zeros((len(own), int(column.max()) + 1), dtype=np.float32)
    has[at[shared], column] = 1
    return has @ has.T > 0


def _forest(close: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what close connects."""
    left = np.arange(len(close))
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            some = close[np.ix_(edge, left)]
            hit = some.any(axis=0)
            yield from zip(left[hit].tolist(), edge[some.argmax(axis=0)[hit]].tolist(), strict=True)
            edge, left = left[hit], left[~hit]


def _compare(group: dict[str, np.ndarray], buckets: list[np.ndarray], x: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of one group, with vectors x of one dimension: (node, rows that link with it here), and edges."""
    node, core, t = group["node"], group["core"], group["t"]
    close = linked(x, x)
    if group["i"][0] != group["j"][0]:  # pairs of one tile belong to that tile's own group
        close &= t[:, None] != t[None, :]
    np.fill_diagonal(close, False)
    if not close.any():
        return [], []
    edges = [(node[a], node[b]) for a, b in _forest(close)]
    new = close & ((core[:, None] != core[None, :]) | (core < 0)[:, None])
    some = np.flatnonzero(new.any(axis=1))
    if not len(some):
        return [], edges
    new = new[np.ix_(some, some)]
    new &= ~_earlier([buckets[k] for k in some], int(group["bucket"][0]))
    n = new @ group["rows"][some]
    return [(a, k) for a, k in zip(node[some], n, strict=True) if k], edges


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that come group by group (bucket, i, j): (node, n, null) with the rows that link with the node there, and
    edges (node, null, other). One group and one batch are held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not len(batch):
            continue
        held = held if batch is None else [*held, batch]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        flat = {c: whole.column(c).to_numpy() for c in ("bucket", "i", "j", "t", "node", "core", "rows")}
        changed = np.any([flat[c][1:] != flat[c][:-1] for c in ("bucket", "i", "j")], axis=0)
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist()]
        if batch is None:
            bounds.append(len(whole))
        held = whole.slice(bounds[-1]).to_batches()  # may go on in the next batch
        lists, data = whole.column("buckets").to_pylist() if bounds[-1] else [], whole.column("unit").to_pylist()
        counts, edges = [], []
        for low, high in itertools.pairwise(bounds):
            sizes = np.array([len(u) for u in data[low:high]])
            for d in np.unique(sizes):
                at = low + np.flatnonzero(sizes == d)
                found = _compare({c: v[at] for c, v in flat.items()}, [np.array(lists[k], dtype=np.int64) for k in at], _rows([data[k] for k in at]))
                counts += found[0]
                edges += found[1]
        node, n, other = [a for a, _ in counts] + [a for a, _ in edges], [int(k) for _, k in counts] + [None] * len(edges), [None] * len(counts) + [b for _, b in edges]
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["node", "n", "other"])


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id (smallest vec_id of its component), kept.

    Rows are linked when their cosine in double precision is COSINE or more, their dimensions agree and they share a cell or
    a core; vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Vectors of one direction
    are one class, compared once and counted as often as they stand. A null vec_id counts as the largest, and of repeated
    ids all rows with the component's id are kept. Other columns are ignored; an empty table gives an empty result.
    """
    base = materialize(_base(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))).withColumn("uid", F.monotonically_increasing_id()))
    named = materialize(base.where("kind is not null").groupBy("kind").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("least")))
    classes = materialize(base.select(F.col("uid").alias("node"), "unit").join(named.select("node", "rows"), "node"))
    own = _cells(classes).distinct()
    own = materialize(own)
    sizes = materialize(own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = materialize(own.join(sizes, "bucket"))
    discard(own, sizes)
    cores = _cores(members, classes)
    lists = materialize(members.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")))  # TABLES x cells at most
    full = materialize(lists.join(classes, "node").join(cores, "node", "left").select("node", "buckets", "unit", "rows", "core"))
    dealt = materialize(_tiles(members.join(cores, "node", "left").select("bucket", "node", "n", "core")))
    groups = dealt.drop("core").join(full, "node").withColumn("core", F.coalesce("core", F.lit(-1)))
    # cells are many and small: they stream through as sorted rows, without a pandas frame each
    groups = groups.select("bucket", "i", "j", "t", "node", "core", "rows", "unit", "buckets").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = materialize(groups.mapInArrow(compare, "node long, n long, other long"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(cores.select(F.col("node").alias("a"), F.col("core").alias("b")))
    parts = components_of(edges)
    cored = cores.join(named.select("node", "rows"), "node")
    whole = materialize(cored.groupBy("core").agg(F.sum("rows").alias("n")))
    inside = cored.join(whole, "core").select("node", (F.col("n") - F.col("rows")).alias("n"))
    n = materialize(found.where("n is not null").select("node", "n").unionByName(inside).groupBy("node").agg(F.sum("n").alias("n")))
    placed = named.join(parts, "node", "left").join(n, "node", "left").select("kind", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    placed = materialize(placed)
    first = materialize(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    placed = materialize(placed.join(first, "component").select("kind", "n_links", "component_id"))
    ids = materialize(base.select("vec_id", "kind"))
    discard(base, named, classes, members, cores, lists, full, dealt, found, parts, whole, n, first)
    component = F.coalesce("component_id", "vec_id")
    return ids.join(placed, "kind", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))

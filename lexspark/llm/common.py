"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary folder of our own only where that
    setting is absent (tests in local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"lexspark-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch at most while a table is written: both sides of a Python worker hold a batch of whole texts.
BATCH_ROWS = 1000


def materialize(df: DataFrame) -> DataFrame:
    """Writes df once into the shared folder and reads it back: the lineage ends there, so a lost executor costs a
    re-read, and random or order-dependent columns keep their values."""
    path = f"{shared_dir(df.sparkSession)}/lexspark-{uuid.uuid4().hex}"
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(conf.get(name))
    conf.set(name, str(BATCH_ROWS if before <= 0 else min(before, BATCH_ROWS)))
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, str(before))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = [path]
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of materialized tables of one schema, as one scan. Discarding it deletes them all."""
    paths = [path for df in tables for path in df._scratch]
    out = tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)
    out._scratch = paths
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that its path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of materialized tables whose readers are done."""
    for df in tables:
        for path in getattr(df, "_scratch", None) or ():
            remove(df.sparkSession, path)
        df._scratch = None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers each that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def sized(rows: DataFrame) -> DataFrame:
    """Written rows of a few numbers each, marked for a broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def empty_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a plain scan evenly over the cores where it has fewer splits: small files may hold many rows. A
    plan with a shuffle or a join stays as it is, as counting its splits would run it."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if re.search(r"Join|Aggregate|Window|Exchange|Sort|Group|Limit|Cartesian|Arrow|Pandas|Python|Generate", plan):
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def edges_to_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of edges (a long, b long): one row per node, (node, component), component = smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which need a number of rounds logarithmic in the
    diameter. Each round writes its edges; the minimum per node is a partial aggregate, and it is written before it is
    joined back, so that adaptive execution can split the partition of a node with very many neighbours. Raises if the
    edges have not settled after that many rounds. Null ends must not occur; loops and repeated edges do not matter.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"]:
            discard(now)
            return spark.createDataFrame([], "node long, component long")
        if mark == before:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        discard(low, now)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct())
        discard(low, large)
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a, b, sorted, and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while len(x):
        x, y = top[x], top[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
    return nodes, nodes[top]


def _contract(most: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every node of `most` edges or a batch more with its root there, roots themselves only if whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(map(len, held)) > most):
                rows = pa.Table.from_batches(held)
                node, root = _roots(rows.column(0).to_numpy(), rows.column(1).to_numpy())
                some = slice(None) if whole else node != root
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some])], ["node", "component"] if whole else ["a", "b"])
                held = []

    return run


def components_of(edges: DataFrame, alone: int = BROADCAST_ROWS) -> DataFrame:
    """What edges_to_components gives, written. Each task first contracts its edges to trees of height one, `alone` edges
    at a time. If `alone` edges or fewer are left in all (two numbers each), one task finishes them: the last rounds of a
    large table and all rounds of a small one have few. More are finished by the distributed rounds."""
    trees = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_contract(alone, False), "a long, b long"))
    if trees.count() > alone:
        out = materialize(edges_to_components(trees))
    else:
        out = materialize(trees.coalesce(1).mapInArrow(_contract(alone, True), "node long, component long"))
    discard(trees)
    return out

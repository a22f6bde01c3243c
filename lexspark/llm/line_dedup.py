"""Removal of lines that stand on many sites, by DataFrame operations alone.

A HyperLogLog sketch of the sites of each line is built by aggregation. Lines whose estimate is near the threshold get
an exact distinct count; lines clearly above it are boilerplate at once. Of a boilerplate line the first occurrence
(smallest document, then position) stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Distinct sites from which on a line counts as boilerplate.
MIN_SITES = 8
#: log2 of the sketch's buckets, and the relative error (over four standard errors) within which a line counts as near.
LG_K, NEAR = 12, 0.07
#: Line hashes, and documents with dropped lines, that are broadcast at most; more are joined by a shuffle.
BROADCAST_LINES = 1 << 19


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """lines (line long, site string, doc_id, pos) -> line, first: those on min_sites distinct sites or more."""
    sketched = (
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_sites)
        .select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - NEAR) - 1)
    )
    sketched = materialize(sketched)
    far = F.col("sites") > min_sites * (1 + NEAR) + 1
    near = sketched.where(~far)
    exact = (
        lines.join(_sized(near.select("line")), "line", "left_semi").select("line", "site").distinct()
        .groupBy("line").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return materialize(sketched.where(far).select("line", "first").unionByName(near.join(exact.select("line"), "line", "left_semi").select("line", "first")))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """docs with text cleaned, and n_lines and n_dropped (replaced where docs has columns of these names).

    Lines end at newlines and are compared by the 64-bit hash of their trimmed text; blank lines never count. A null
    site counts as none, a null text stays null (0 lines), an empty one has one blank line. Of a boilerplate line the
    first occurrence stays, a null doc_id counting as the largest; all rows equal in doc_id and text keep the same
    lines. No row is dropped: a text may become empty. Other columns pass through, whatever their names; an empty table
    stays empty.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    key, text, split = F.col("row.doc_id").cast("long"), F.col("row.text"), F.split("row.text", "\n")
    hashes = F.transform(split, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))
    lines = (
        docs.select(key.alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(f"row.`{site}`").cast("string").alias("site"), F.posexplode(hashes).alias("pos", "line"))
        .where("line is not null")
        .withColumn("at", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "digest", "pos"))
    )
    bad = boilerplate(lines, min_sites)
    drop = lines.join(_sized(bad), "line").where(~F.col("at").eqNullSafe(F.col("first"))).groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("gone"))
    drop = materialize(drop)
    # without a shuffle of the texts where the places of the lines are few
    met = docs.join(_sized(drop), key.eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("digest")), "left")
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    return met.select(
        *((cleaned if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names),
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")


SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT *, trim(line, ' ') AS k FROM l),
b AS (SELECT k, min((doc_id, pos)) AS f FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT t.*, b.k IS NOT NULL AND (t.doc_id, t.pos) <> b.f AS gone FROM t LEFT JOIN b ON t.k = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM m GROUP BY doc_id
"""

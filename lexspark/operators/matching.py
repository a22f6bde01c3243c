"""Multi-keyword search over tables: an automaton in Arrow batches, or windows and a broadcast join for few keywords."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidRequestError, LexsparkError
from ..functions import automaton as engine
from ..functions.search import quoted
from ..options import SearchOptions

MATCHES = "array<struct<start:int,end:int,keyword:string,value:string>>"
_MATCH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("keyword", pa.string()), ("value", pa.string())])
MATCH_LIST = pa.list_(_MATCH)
_TOKEN = pa.struct([("kind", pa.string()), ("text", pa.string()), ("value", pa.string())])
TOKENS = "array<struct<kind:string,text:string,value:string>>"


def dictionary(keywords: Mapping[str, str] | Iterable[str], options: SearchOptions = SearchOptions()) -> engine.Dictionary:
    return engine.Dictionary(keywords, options)


def dictionary_from(df: DataFrame, keyword: str = "keyword", value: str = "value", options: SearchOptions = SearchOptions(), limit: int = 1_000_000) -> engine.Dictionary:
    """A dictionary from a table of keywords, refused beyond `limit` of them: it is sent to every executor."""
    rows = df.select(F.col(keyword), F.col(value)).limit(limit + 1).collect()
    if len(rows) > limit:
        raise InvalidRequestError(f"more than {limit} keywords")
    if len({r[0] for r in rows}) < len(rows):
        raise InvalidRequestError("Normalization collision: two keywords are equal once prepared")
    return engine.Dictionary({r[0]: r[1] for r in rows}, options)


def balanced(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores where the scan gives fewer splits than there are cores."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if re.search(r"Join|Aggregate|Window|Exchange|Sort|Group|Limit|Arrow|Python|Generate", plan):
        return df  # counting its splits would run it
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _per_text(text: Column, kind: pa.DataType, schema: str, f: Callable[[str], object]) -> Column:
    """Column of f over the texts; nulls stay, and a text that f refuses becomes null."""

    def safe(t: str) -> object:
        try:
            return f(t)
        except LexsparkError:
            return None

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else safe(t) for t in texts.to_pylist()], kind)

    return run(text)


def _as_dict(m: engine.Match) -> dict:
    return m._asdict()


def parse(text: Column, d: engine.Dictionary) -> Column:
    """All matches of each text, made as Arrow columns; a text that is refused gives null."""

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        ends, rows = [0], []
        mask = []
        for t in texts.to_pylist():
            try:
                rows += engine.parse_rows(d, t) if t is not None else ()
                mask.append(t is None)
            except LexsparkError:
                mask.append(True)
            ends.append(len(rows))
        starts, stops, words = zip(*rows, strict=True) if rows else ((), (), ())
        kinds = {k: i for i, k in enumerate(d.values)}
        at = pa.array([kinds[w] for w in words], pa.int32())
        word, value = (pa.array(x, pa.string()).take(at) for x in (list(kinds), list(d.values.values())))
        items = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), word, value], fields=list(_MATCH))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(mask, pa.bool_()))

    return run(text)


def first(text: Column, d: engine.Dictionary) -> Column:
    return _per_text(text, _MATCH, MATCHES[6:-1], lambda t: (m := engine.first(d, t)) and _as_dict(m))


def contains(text: Column, d: engine.Dictionary) -> Column:
    return _per_text(text, pa.bool_(), "boolean", lambda t: engine.contains(d, t))


def tokenize(text: Column, d: engine.Dictionary) -> Column:
    return _per_text(text, pa.list_(_TOKEN), TOKENS, lambda t: [{"kind": k, "text": s, "value": m.value if m else None} for k, s, m in engine.tokenize(d, t)])


def replace_all(text: Column, d: engine.Dictionary, transform: Callable[[engine.Match], str] = lambda m: m.value) -> Column:
    return _per_text(text, pa.string(), "string", lambda t: engine.replace_all(d, t, transform))


def stream_matches(text: Column, d: engine.Dictionary, limit: int | None = None) -> Column:
    """Matches in raw order; the search of a text ends with its limit-th match."""
    from itertools import islice

    return _per_text(text, pa.list_(_MATCH), MATCHES, lambda t: [_as_dict(m) for m in islice(engine.stream(d, t), limit)])


def matches(df: DataFrame, d: engine.Dictionary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match: key, start, end, keyword, value. Texts without a match never leave the JVM for plain options."""
    rows = df.select(key, text)
    if d.values and d.options == SearchOptions() and len(d.values) <= 64:
        rows = rows.where(F.col(text).rlike("|".join(map(quoted, d.values))))
    return balanced(rows).select(key, F.explode(parse(F.col(text), d)).alias("m")).select(key, "m.*")


def native_matches(df: DataFrame, keywords: Iterable[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match (overlaps too): key, start, end, keyword, without Python.

    The text is cut before every place where a keyword starts; running lengths give the places, and each is compared with
    the keywords of a broadcast table over the following fragments.
    """
    words = sorted(set(keywords), key=lambda k: (-len(k), k))
    reach = max(map(len, words))
    cuts = F.split(text, f"(?=(?:{'|'.join(map(quoted, words))}))")
    parts = balanced(df.select(key, text)).select(key, F.posexplode(cuts).alias("i", "part"))
    w = W.partitionBy(key).orderBy("i")
    head = F.concat_ws("", *(F.lead("part", n).over(w) if n else F.col("part") for n in range(reach)))
    placed = parts.select(key, (F.coalesce(F.sum(F.length("part")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("int").alias("start"), F.substring(head, 1, reach).alias("head"))
    table = df.sparkSession.createDataFrame([(k,) for k in words], "keyword string")
    return placed.join(F.broadcast(table), F.col("head").startswith(F.col("keyword"))).select(key, "start", (F.col("start") + F.length("keyword") - 1).alias("end"), "keyword")


def without_overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of spans (key, start, end inclusive, ...) those that longest-first selection keeps."""
    own = [c for c in spans.columns if c != key]

    @F.arrow_udf("array<int>")
    def survivors(start: pa.Array, end: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(start.to_pylist(), end.to_pylist(), strict=True):
            out.append([i for _, _, i in engine.longest_first([(x, y, i) for i, (x, y) in enumerate(zip(a, b, strict=True))])])
        return pa.array(out, pa.list_(pa.int32()))

    rows = F.array_sort(F.collect_list(F.struct("start", "end", *(c for c in own if c not in ("start", "end")))))
    grouped = spans.groupBy(key).agg(rows.alias("_all"))
    kept = survivors(F.col("_all.start"), F.col("_all.end"))
    return grouped.select(key, "_all", F.explode(kept).alias("_i")).select(key, F.get("_all", F.col("_i")).alias("_k")).select(key, *(F.col(f"_k.{c}").alias(c) for c in own))


def overlapping_pairs(a: DataFrame, b: DataFrame, key: str = "doc_id", width: int = 256) -> DataFrame:
    """Pairs of intervals (key, start, end inclusive) that overlap: an equi-join on the key and on blocks of `width`
    characters, so that a long text with many intervals does not meet all of its pairs."""
    block = lambda df, a, b: df.withColumn("_x", F.explode(F.sequence((F.col(a) / width).cast("int"), (F.col(b) / width).cast("int"))))
    x = block(a.select(key, "start", "end"), "start", "end")
    y = block(b.select(key, F.col("start").alias("other_start"), F.col("end").alias("other_end")), "other_start", "other_end")
    met = x.join(y, [key, "_x"]).where((F.col("start") <= F.col("other_end")) & (F.col("end") >= F.col("other_start")))
    return met.where(F.col("_x") == (F.greatest("start", "other_start") / width).cast("int")).select(key, "start", "end", "other_start", "other_end")

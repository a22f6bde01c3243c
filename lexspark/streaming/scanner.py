"""The chunk scanner as a stateful operator: chunks of many texts in order, matches as they become certain."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import automaton as engine
from ..operators.matching import MATCH_LIST, MATCHES

_OUT = "stream_id string, start long, end long, keyword string, value string"
_STATE = "tail string, offset long, done string"


def _resume(d: engine.Dictionary, tail: str, offset: int, done: str) -> engine.Scanner:
    s = engine.Scanner(d)
    s.tail, s.offset = tail, offset
    s.done = {(int(a), int(b), k) for a, b, k in (x.split(":", 2) for x in done.split("\x00") if x)}
    return s


def _saved(s: engine.Scanner) -> tuple[str, int, str]:
    return s.tail, s.offset, "\x00".join(f"{a}:{b}:{k}" for a, b, k in sorted(s.done))


def _rows(key: str, found: Iterable[engine.Match]) -> list[tuple]:
    return [(key, *m) for m in found]


def scan_stream(chunks: DataFrame, d: engine.Dictionary) -> DataFrame:
    """Matches of a stream of (stream_id, seq, chunk, is_last). The chunks of a text must come in order of seq, within a
    batch in any order; the last one flushes and drops the state, which is a tail of twice the longest keyword."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanner = _resume(d, *state.get) if state.exists else engine.Scanner(d)
        rows = pd.concat(list(frames)).sort_values("seq")
        out: list[tuple] = []
        last = False
        for text, is_last in zip(rows["chunk"], rows["is_last"], strict=True):
            out += _rows(key[0], scanner.scan(text or ""))
            last = last or bool(is_last)
        if last:
            out += _rows(key[0], scanner.finish())
            state.remove()
        else:
            state.update(_saved(scanner))
        yield pd.DataFrame(out, columns=["stream_id", "start", "end", "keyword", "value"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def scan_table(chunks: DataFrame, d: engine.Dictionary) -> DataFrame:
    """The same over a table: one group per text, its chunks in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scanner = engine.Scanner(d)
        rows = pdf.sort_values("seq")
        key = rows["stream_id"].iloc[0]
        out = [r for text in rows["chunk"] for r in _rows(key, scanner.scan(text or ""))]
        return pd.DataFrame(out + _rows(key, scanner.finish()), columns=["stream_id", "start", "end", "keyword", "value"])

    return chunks.groupBy("stream_id").applyInPandas(run, _OUT)


def chunks(text: Column, size: int) -> Column:
    """The text cut every `size` characters in one pass; an empty text is one empty chunk."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def chunked(texts: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """stream_id, seq, chunk, is_last of texts cut every `size` characters; native."""
    cut = texts.select(F.col(key).cast("string").alias("stream_id"), chunks(F.col(text), size).alias("cut"))
    return cut.select("stream_id", F.size("cut").alias("n"), F.posexplode("cut").alias("seq", "chunk")).select("stream_id", "seq", "chunk", (F.col("seq") == F.col("n") - 1).alias("is_last"))


def scan_chunks(cut: Column, d: engine.Dictionary) -> Column:
    """The same for texts whose chunks stand in one array each: no shuffle. Null arrays stay null, null chunks are empty."""

    def scan(own: list[str | None]) -> list[dict]:
        scanner = engine.Scanner(d)
        return [m._asdict() for c in own for m in scanner.scan(c or "")] + [m._asdict() for m in scanner.finish()]

    @F.arrow_udf(MATCHES)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else scan(v) for v in values.to_pylist()], MATCH_LIST)

    return run(cut)

"""Pipelines over document tables, made of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import search
from ..functions.requests import status
from ..operators import language, redaction
from ..operators.matching import balanced
from ..options import MAX_TEXT_LENGTH, SearchOptions


def moderate(docs: DataFrame, keywords: Sequence[str], model: DataFrame | None = None, limit: int = MAX_TEXT_LENGTH) -> DataFrame:
    """doc_id, status, n_keywords, n_email, n_phone, masked_length, and with a model the detected language (422 where there
    is none). Counts of refused texts are null."""
    text, ok = F.col("text"), F.col("status") == 200
    rows = balanced(docs.select("doc_id", "text", status(text, limit).alias("status")))
    if model is not None:
        rows = rows.join(language.detect(rows.where(ok), model), "doc_id", "left").withColumn("status", F.when(ok & (F.col("detected") == language.UNKNOWN), 422).otherwise(F.col("status")))
    only = lambda c: F.when(ok, c)
    # texts without the sign are spared the pattern
    mailed = text.contains("@")
    masked = redaction.native_mask(F.when(mailed, redaction.native_mask(text, redaction.EMAIL)).otherwise(text), redaction.PHONE)
    return rows.select(
        "doc_id", "status", only(search.count_matches(text, keywords)).alias("n_keywords"), only(F.when(mailed, F.regexp_count(text, F.lit(redaction.EMAIL))).otherwise(0)).alias("n_email"),
        only(F.regexp_count(text, F.lit(redaction.PHONE))).alias("n_phone"), only(F.length(masked) - F.length(F.replace(masked, F.lit("*"), F.lit("")))).alias("n_masked"),
        *(["detected"] if model is not None else []),
    )


def risk_alerts(docs: DataFrame, codes: Mapping[str, str]) -> DataFrame:
    """code, n, first_doc: texts by the risk code of their first keyword."""
    table = docs.sparkSession.createDataFrame(list(codes.items()), "keyword string, code string")
    first = docs.select("doc_id", search.first_match(F.col("text"), codes).alias("m")).where("m is not null").select("doc_id", F.col("m.keyword").alias("keyword"))
    return first.join(F.broadcast(table), "keyword").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def mixed_language_counts(docs: DataFrame) -> DataFrame:
    """doc_id, language, runs, letters: runs of letters of each script."""
    return docs.select("doc_id", F.explode(language.script_segments(F.col("text"))).alias("s")).groupBy("doc_id", F.col("s.kind").alias("language")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.length("s.text")).alias("letters"))


def corpus_quality(cases: DataFrame, detected: DataFrame) -> DataFrame:
    """id, passed of cases (id, expected array) and detected (id, languages array): every expected language was found."""
    return cases.join(detected, "id", "left").select("id", (F.size(F.array_except("expected", F.coalesce("languages", F.array().cast("array<string>")))) == 0).alias("passed"))


def request_statuses(docs: DataFrame, limit: int = MAX_TEXT_LENGTH) -> DataFrame:
    return docs.groupBy(status(F.col("text"), limit).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def mask_words(docs: DataFrame, words: Sequence[str], mask: str = "*") -> DataFrame:
    """Longest words first, whatever their case."""
    return docs.select("doc_id", search.mask_matches(F.col("text"), words, mask, SearchOptions(ignore_case=True)).alias("masked"))

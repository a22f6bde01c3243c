"""The stages of the corpus pipeline: each takes documents and returns documents but for the last."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup as lines
from . import minhash_dedup, packing, pii
from . import toxicity as tox
from .common import table

#: Probability from which on a document counts as toxic and goes.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are toxic with a probability of TOXIC or more, learnt from the table labels.

    Null and empty texts have no toxic token and stay, long ones are judged whole. Equal texts meet one fate, whatever their
    ids; rows with null or repeated ids are rows like any other. Columns keep their names, any of them. No rows give none.
    """
    model = tox.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = f"p_{uuid.uuid4().hex}"
    return tox.score(docs.select(_others(docs), "text"), model, name).where(F.col(name) < TOXIC).select(*(F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with boilerplate lines cut from the texts, as line_dedup.line_dedup says; n_chars follows the text.

    Every row stays, null texts as null; columns n_lines and n_dropped of docs keep their values.
    """
    whole = docs.select(_others(docs), "doc_id", "text", "source")
    return _with_text(lines.line_dedup(whole), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group of docs, as minhash_dedup.near_dedup says."""
    return minhash_dedup.near_dedup(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind, as pii.redact says; n_chars follows the text."""
    return _with_text(pii.redact(docs.select(_others(docs), "text")), docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences, as packing.token_pieces and packing.pack say: null texts are one end id each, repeated
    rows are separate items, long texts are cut into whole sequences, no rows give none."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def _others(docs: DataFrame) -> Column:
    """The columns but text as one struct, so that no name of theirs can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")


def _with_text(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` of the struct row, but text as it stands beside it, and n_chars, if any, as its length."""
    kinds = {f.name: f.dataType for f in docs.schema["row"].dataType.fields}
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(kinds.get("n_chars", "long"))}
    return docs.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))

"""Dictionary files and versioned dictionaries.

A dictionary is a table. Its versions are Parquet folders under one root; a small table of pointers names the current
revision, so that a failed reload leaves the current one, and a rollback only moves the pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequestError


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """word: trimmed lines of text files, compressed ones too. Blank lines stay; a missing file is an error."""
    return spark.read.text(list(paths)).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("word"))


def read_words(spark: SparkSession, *paths: str) -> DataFrame:
    """The distinct words of all files."""
    return read_lines(spark, *paths).where(F.col("word") != "").distinct()


def read_frequencies(spark: SparkSession, *paths: str) -> DataFrame:
    """word, freq from lines of word, tab, number, of which the first six characters count. Other lines are left out."""
    parts = F.split("word", "\t", 2)
    return read_lines(spark, *paths).where(F.col("word").contains("\t")).select(parts[0].alias("word"), F.substring(parts[1], 1, 6).cast("float").alias("freq"))


def read_map(spark: SparkSession, *paths: str) -> DataFrame:
    """key, value from lines with a space."""
    parts = F.split("word", " ", 2)
    return read_lines(spark, *paths).where(F.col("word").contains(" ")).select(parts[0].alias("key"), parts[1].alias("value"))


def typo_table(pairs: DataFrame) -> DataFrame:
    """len, typo, fix of pairs (key, value)."""
    return pairs.select(F.length("key").alias("len"), F.col("key").alias("typo"), F.col("value").alias("fix"))


def words_in(df: DataFrame, words: DataFrame, column: str = "word", small: int = 1_000_000) -> DataFrame:
    """Rows of df whose word is in the dictionary: a semi-join, by broadcast where the dictionary is small."""
    return df.join(F.broadcast(words) if words.limit(small + 1).count() <= small else words, column, "left_semi")


def words_out(df: DataFrame, words: DataFrame, column: str = "word", small: int = 1_000_000) -> DataFrame:
    return df.join(F.broadcast(words) if words.limit(small + 1).count() <= small else words, column, "left_anti")


def cumulative_tiers(words: DataFrame) -> DataFrame:
    """threshold, word of words (word, tier): LOW holds all tiers, MIDDLE its own and HIGH, HIGH its own. A word of several
    tiers has its highest."""
    rank = F.array_position(F.array(*map(F.lit, ("LOW", "MIDDLE", "HIGH"))), F.col("tier"))
    highest = words.groupBy("word").agg(F.max(rank).alias("rank"))
    return highest.select(F.explode(F.slice(F.array(*map(F.lit, ("LOW", "MIDDLE", "HIGH"))), 1, F.col("rank").cast("int"))).alias("threshold"), "word")


class VersionedDictionary:
    """Revisions of one dictionary. history: revisions before the current one that rollback() can return to."""

    def __init__(self, spark: SparkSession, root: str, name: str, history: int = 1):
        self.spark, self.root, self.name, self.history = spark, root.rstrip("/"), name, history
        self.stack: list[tuple[int, str]] = []

    @property
    def revision(self) -> int:
        if not self.stack:
            raise InvalidRequestError("the dictionary has no revision")
        return self.stack[-1][0]

    def snapshot(self) -> DataFrame:
        """The current revision: a plan made of it keeps it whatever is reloaded later."""
        return self.spark.read.parquet(self.stack[-1][1]) if self.stack else self._none()

    def _none(self):
        raise InvalidRequestError("the dictionary has no revision")

    def reload(self, name: str, revision: int, load: Callable[[], DataFrame]) -> DataFrame:
        """Writes the loaded table and then moves to it; the name must be the same and the revision larger. What fails in
        between leaves the current revision as it is."""
        if name != self.name:
            raise InvalidRequestError("a reload must keep the dictionary's name")
        if revision < 0 or (self.stack and revision <= self.revision):
            raise InvalidRequestError("a reload must have a larger revision")
        path = f"{self.root}/name={self.name}/revision={revision}-{uuid.uuid4().hex}"
        load().write.parquet(path)
        self.stack = [*self.stack, (revision, path)][-(self.history + 1) :]
        return self.snapshot()

    def rollback(self) -> DataFrame:
        if len(self.stack) < 2:
            raise InvalidRequestError("no earlier revision is kept")
        self.stack = self.stack[:-1]
        return self.snapshot()

    def add(self, words: DataFrame) -> DataFrame:
        return self.reload(self.name, self.revision + 1, lambda: self.snapshot().unionByName(words).distinct())

    def remove(self, words: DataFrame, on: Sequence[str] = ("word",)) -> DataFrame:
        return self.reload(self.name, self.revision + 1, lambda: self.snapshot().join(words.select(*on).distinct(), list(on), "left_anti"))

    def clear(self) -> DataFrame:
        return self.reload(self.name, self.revision + 1, lambda: self.snapshot().limit(0))

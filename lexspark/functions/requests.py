"""Validation of requests as a native status: 413 for a text beyond the limit (checked first), 400 for a blank one, 200."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..options import MAX_TEXT_LENGTH


def status(text: Column, limit: int = MAX_TEXT_LENGTH) -> Column:
    return F.when(F.length(text) > limit, 413).when(text.isNull() | ~text.rlike(r"[^\p{IsWhite_Space}]"), 400).otherwise(200)


def checked(text: Column, limit: int = MAX_TEXT_LENGTH) -> Column:
    """The text, or an error that names its length alone."""
    return F.when(status(text, limit) == 200, text).otherwise(F.raise_error(F.concat(F.lit(f"invalid text: limit {limit}, length "), F.coalesce(F.length(text), F.lit(0)).cast("string"))).cast("string"))


def check_length(text: str, limit: int = MAX_TEXT_LENGTH) -> None:
    if len(text) > limit:
        raise InvalidRequestError(f"text of {len(text)} characters exceeds {limit}")

"""Keyword search as native columns: one alternation, longer keywords first, inside whole-stage code generation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..options import SearchOptions, WordBoundary

_SPECIAL = re.compile(r"[.*+?^${}()|\[\]\\/&~#\-]")
#: Look-behind and look-ahead of each boundary.
_EDGES = {
    WordBoundary.NONE: ("", ""),
    WordBoundary.LATIN_ALPHA: (r"(?<!\p{IsAlphabetic})", r"(?!\p{IsAlphabetic})"),
    WordBoundary.WHITESPACE_SEPARATED: (r"(?<![^\p{IsWhite_Space}])", r"(?![^\p{IsWhite_Space}])"),
}


def quoted(keyword: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m.group(), keyword)


def pattern(keywords: Iterable[str], options: SearchOptions = SearchOptions()) -> str:
    """A Java pattern that matches, at each place, the longest keyword that stands as the boundary asks."""
    words = sorted(set(keywords), key=lambda k: (-len(k), k))
    if not words or any(not k.strip() for k in words):
        raise InvalidRequestError("keywords must be there and not blank")
    behind, ahead = _EDGES[options.boundary]
    flags = "(?iu)" if options.ignore_case else ""
    return f"{flags}{behind}(?:{'|'.join(map(quoted, words))}){ahead}"


def contains_any(text: Column, keywords: Iterable[str], options: SearchOptions = SearchOptions()) -> Column:
    words = list(keywords)
    if options == SearchOptions() and len(words) == 1:
        return text.contains(words[0])
    return text.rlike(pattern(words, options))


def count_matches(text: Column, keywords: Iterable[str], options: SearchOptions = SearchOptions()) -> Column:
    """Leftmost-longest matches that do not overlap."""
    return F.regexp_count(text, F.lit(pattern(keywords, options)))


def count_overlapping(text: Column, keyword: str) -> Column:
    """All occurrences of one keyword, those that overlap each other too."""
    return F.regexp_count(text, F.lit(f"(?={quoted(keyword)})"))


def first_match(text: Column, keywords: Iterable[str], options: SearchOptions = SearchOptions()) -> Column:
    """struct(start, end, keyword) of the leftmost-longest match, null if none: start from 0, end inclusive, keyword as it
    stands in the text."""
    p = pattern(keywords, options)
    at = F.regexp_instr(text, F.lit(p))
    found = F.regexp_substr(text, F.lit(p))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at + F.length(found) - 2).alias("end"), found.alias("keyword")))


def replace_matches(text: Column, keywords: Iterable[str], replacement: str, options: SearchOptions = SearchOptions()) -> Column:
    return F.regexp_replace(text, F.lit(pattern(keywords, options)), F.lit(replacement.replace("\\", "\\\\").replace("$", "\\$")))


def tokens(text: Column, keywords: Iterable[str], options: SearchOptions = SearchOptions()) -> Column:
    """array of struct(kind, text): fragments and matches in turn, empty fragments left out; they join to the text."""
    p = pattern(keywords, options)
    parts = F.split(text, p, -1)
    found = F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))
    kind = lambda c, k: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("text")))
    both = F.flatten(F.zip_with(kind(parts, "FRAGMENT"), kind(found, "MATCH"), lambda a, b: F.array(a, b)))
    return F.filter(both, lambda t: t.isNotNull() & (F.length(t["text"]) > 0))


def mask_matches(text: Column, keywords: Iterable[str], mask: str = "*", options: SearchOptions = SearchOptions()) -> Column:
    """Every character of the matches becomes the mask, so the length stays."""
    return F.array_join(F.transform(tokens(text, keywords, options), lambda t: F.when(t["kind"] == "MATCH", F.repeat(F.lit(mask), F.length(t["text"]))).otherwise(t["text"])), "")


def trace_summary(text: Column) -> Column:
    """What may be logged of a text: its length, digest, and counts of kinds of characters."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    letters, digits, spaces = n(r"\p{L}"), n(r"\p{Nd}"), n(r"\p{IsWhite_Space}")
    return F.struct(
        F.length(text).alias("length"), F.sha2(text, 256).alias("sha256"), letters.alias("letters"), digits.alias("digits"), spaces.alias("spaces"),
        (F.length(text) - letters - digits - spaces).alias("others"),
    )

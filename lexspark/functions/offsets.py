"""Texts as they are searched (normalized, lower case) with maps back to the offsets of their source."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from ..errors import InvalidRequestError
from ..options import Normalization, SearchOptions

#: Characters that one segment of composing characters may hold.
MAX_SEGMENT = 1024


@dataclass(frozen=True)
class Prepared:
    text: str
    starts: list[int] | None  # source offset of each character; None: the same
    ends: list[int] | None  # source offset of the character's last source character

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Inclusive offsets in the source of the inclusive offsets in the prepared text."""
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end])


def _joins(c: str) -> bool:
    """Whether the character may compose with the one before it."""
    return unicodedata.combining(c) > 0 or unicodedata.category(c) in ("Mn", "Mc") or "ᅠ" <= c <= "ᇿ" or c in "ﾞﾟ"


def _segments(text: str):
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not _joins(text[i]):
            if i - start > MAX_SEGMENT:
                raise InvalidRequestError(f"a segment of {i - start} composing characters exceeds {MAX_SEGMENT}")
            yield start, i
            start = i


def prepare(text: str, options: SearchOptions) -> Prepared:
    starts = ends = None
    if options.normalization is not Normalization.NONE and not text.isascii():
        form, parts, starts, ends = options.normalization.value, [], [], []
        for a, b in _segments(text):
            part = unicodedata.normalize(form, text[a:b])
            parts.append(part)
            same = part == text[a:b]
            starts += range(a, b) if same else [a] * len(part)
            ends += range(a, b) if same else [b - 1] * len(part)
        text = "".join(parts)
    if options.ignore_case:
        lower = text.lower()
        if len(lower) != len(text):
            sizes = [len(c.lower()) for c in text]
            starts = [s for s, n in zip(starts or range(len(text)), sizes, strict=True) for _ in range(n)]
            ends = [e for e, n in zip(ends or range(len(text)), sizes, strict=True) for _ in range(n)]
        text = lower
    return Prepared(text, starts, ends)


def prepare_keyword(keyword: str, options: SearchOptions) -> str:
    return prepare(keyword, options).text


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)

"""Options fixed when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class WordBoundary(str, Enum):
    NONE = "NONE"
    #: Neither neighbour is alphabetic in the sense of Unicode (not of the Latin script alone).
    LATIN_ALPHA = "LATIN_ALPHA"
    WHITESPACE_SEPARATED = "WHITESPACE_SEPARATED"


class Normalization(str, Enum):
    NONE = "NONE"
    NFC = "NFC"
    NFKC = "NFKC"


@dataclass(frozen=True)
class SearchOptions:
    ignore_case: bool = False
    allow_overlaps: bool = True
    boundary: WordBoundary = WordBoundary.NONE
    normalization: Normalization = Normalization.NONE
    stop_on_first: bool = False


class Severity(str, Enum):
    LOW = "LOW"
    MIDDLE = "MIDDLE"
    HIGH = "HIGH"

    @property
    def rank(self) -> int:
        return ["LOW", "MIDDLE", "HIGH"].index(self.value)


@dataclass(frozen=True)
class BlockwordOptions:
    mask: str = "*"
    locale: str = "ko"
    severity: Severity = Severity.LOW


#: Longest text, in characters, that the tokenizers and block-word operators take.
MAX_TEXT_LENGTH = 100_000

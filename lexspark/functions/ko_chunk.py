"""Chunks of mixed text by kind: patterns claim what no earlier one has claimed; the rest is foreign."""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import regex

from .ko_lexicon import ORDINAL


class Token(NamedTuple):
    text: str
    pos: str
    offset: int
    length: int
    stem: str | None = None
    unknown: bool = False


#: The patterns in the order in which they claim text. Punctuation, letters and digits are those of ASCII.
PATTERNS = {
    "URL": r"(\(?(?:https?://|ftp://|www\.)|(?<![^ \t\n\x0b\f\r])(?=[a-zA-Z0-9])(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,})[a-zA-Z0-9\-._~:/?#\[\]@!$&'(*+,;=%-]*",
    "Email": r"[A-Za-z0-9.\-_]+@[A-Za-z0-9.]+",
    "ScreenName": r"([^A-Za-z0-9_!#$%&*@＠]|^)(@[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)?)",
    "Hashtag": r"([ \t\n\x0b\f\r]|^)(#[\p{L}0-9_]+)",
    "CashTag": r"([ \t\n\x0b\f\r]|^)(\$[A-Za-z]{1,6}(?:\.[A-Za-z]{1,2})?)",
    "Number": r"\$?[0-9]+(,[0-9]{3})*([/~:\.-][0-9]+)?(천|만|억|조)*(%|원|달러|위안|옌|엔|유로|등|년|월|일|회|시간|시|분|초)?",
    "Korean": r"[가-힣]+",
    "KoreanParticle": r"[ㄱ-ㅣ]+",
    "Alpha": r"[A-Za-z]+",
    "Punctuation": r"[!-/:-@\[-`{-~·…’]+",
}
_COMPILED = {k: regex.compile(p) for k, p in PATTERNS.items()}
_PARTS = regex.compile(r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+")


def find_all(text: str, pos: str) -> list[Token]:
    """Matches of one pattern, last first."""
    return [Token(m.group(), pos, m.start(), m.end() - m.start()) for m in _COMPILED[pos].finditer(text)][::-1]


def _claim(part: str) -> list[tuple[int, int, str]]:
    # of white space only that which starts with a space character is one; line breaks and tabs are foreign
    if part[0] in "   　" or regex.match(r"\p{Z}", part[0]):
        return [(0, len(part), "Space")]
    claimed: list[tuple[int, int, str]] = []
    left = len(part)
    for pos, p in _COMPILED.items():
        if not left:
            break
        for m in p.finditer(part):
            s, e = m.span()
            i = bisect_left(claimed, (s,))
            if (i and claimed[i - 1][1] > s) or (i < len(claimed) and e > claimed[i][0]) or s == e:
                continue
            claimed.insert(i, (s, e, pos))
            left -= e - s
    out, at = [], 0
    for s, e, pos in [*claimed, (len(part), len(part), "")]:
        if s > at:
            out.append((at, s, "Foreign"))
        if pos:
            out.append((s, e, pos))
        at = e
    return out


def chunk(text: str) -> list[Token]:
    """Chunks that join to the text."""
    return [Token(m.group()[s:e], pos, m.start() + s, e - s) for m in _PARTS.finditer(text) for s, e, pos in _claim(m.group())]


def chunks_by_pos(text: str, pos: str) -> list[Token]:
    return [t for t in chunk(text) if t.pos == pos]


def chunk_texts(text: str, keep_space: bool = True) -> list[str]:
    return [t.text if keep_space else t.text.strip() for t in chunk(text)]


assert set(PATTERNS) <= set(ORDINAL)

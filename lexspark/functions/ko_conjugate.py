"""Surface forms of predicate stems, from how their last syllable takes endings.

Open stems follow one rule: the syllable stands alone, takes the finals of endings, or merges with the vowel of the past.
Closed stems keep their final but for the changing ones, which a table names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from .hangul import compose, decompose, has_coda

#: Syllables that may follow a stem, by group.
COMMON = "게겠고구기긴길네다더던도든면자잖재져죠지진질"
WITH_HAE = "야서써도준"
EO, A, WO, YEO = "어었", "아았", "워웠", "여였"
NO, REO, EU, EUN, NEUN, UN = "노느니냐", "러려며", "으", "은", "는", "운"
POLITE = "세시실신셔습셨십"
VOWEL = COMMON + NO + REO + POLITE
#: Finals that a stem without one may take.
FINALS, CONTRACTED, NOT_PAST = "ㅂㅆㄹㄴㅁ", "ㅆㄹㅁ", "ㅂㄹㄴㅁ"
#: Forms of verbs that read better as something else.
EDGE = frozenset(["아니", "입", "입니", "나는"])
#: Vowels that an open stem's vowel contracts to with the past's, and what may follow it uncontracted.
MERGED = {"ㅗ": "ㅘ", "ㅜ": "ㅝ", "ㅡ": "ㅝㅓㅏ", "ㅣ": "ㅕ"}
OPEN = {"ㅗ": VOWEL + A + NEUN, "ㅜ": VOWEL + EO + NEUN, "ㅡ": NO + NEUN, "ㅣ": EO + NO + NEUN, "ㅟ": NO + NEUN} | dict.fromkeys("ㅞㅚㅙ", NO + NEUN)


class Syllable(NamedTuple):
    onset: str
    vowel: str
    coda: str
    alone: bool  # the stem's only syllable
    adjective: bool


class Form(NamedTuple):
    """Last syllables, by vowel and finals, and what may follow each of them ("": nothing)."""

    vowel: str
    finals: str
    followers: str = ""


def _open(s: Syllable) -> Iterator[Form]:
    """Stems without a final: they take the finals of endings, and merge with the past's vowel where theirs does."""
    if s.onset + s.vowel == "ㅎㅏ":
        yield Form("ㅏ", " ", VOWEL + YEO + NEUN)
        yield Form("ㅏ", NOT_PAST)
        yield Form("ㅐ", " ㅆ")
        yield Form("ㅐ", " ", WITH_HAE)
        if s.adjective:
            yield Form("ㅏ", " ")
            yield Form("ㅣ", " ")
        return
    merged = "ㅕ" if s.onset + s.vowel == "ㄱㅟ" else MERGED.get(s.vowel, "")
    yield Form(s.vowel, " ")
    yield Form(s.vowel, " ", OPEN.get(s.vowel, VOWEL + WITH_HAE + NEUN))
    yield Form(s.vowel, NOT_PAST if merged or s.vowel == "ㅟ" else FINALS)
    for v in merged:
        yield Form(v, " ㅆ")
    if s.vowel == "ㅣ":
        yield Form("ㅣ", "ㅂ", "니")


#: Closed stems whose final changes, as (onsets, vowels, finals, adjectives only) -> forms beside the stem
#: itself; "" stands for any, a blank vowel for the stem's own, "=" for its own final. The first that fits counts.
CHANGING = [
    ("", "ㅡㅏㅜ", "ㄹ", False, [(" ", "=", EO + REO), (" ", " ", NO + NEUN + POLITE), (" ", "ㄻㄴ", "")]),
    ("ㅁ", "ㅓ", "ㄹ", False, [(" ", "=", EO + REO), (" ", " ", NO + NEUN + POLITE), (" ", "ㄻㄴ", "")]),
    ("", "ㅏ", "ㅅ", False, [(" ", "=", NO + NEUN), (" ", " ", EU + EUN)]),
    ("ㅁ", "ㅜ", "ㄷ", False, [(" ", "=", NO + NEUN), (" ", "ㄹ", "")]),
    ("", "ㅜ", "ㄷ", False, [(" ", "=", NO + NEUN), (" ", " ", EO + WO + EU + EUN), (" ", "ㄹ", "")]),
    ("", "ㅜ", "ㅂ", False, [(" ", "=", NO + NEUN), (" ", " ", WO + EU + EUN)]),
    ("", "ㅓ", "ㅂ", True, [(" ", " ", WO + UN), (" ", " ㄴ", "")]),
    ("", "", "ㅂ", True, [(" ", " ", WO + UN), (" ", " ", "")]),
    ("", "ㅗ", "ㅎ", False, [(" ", "=", NO + NEUN), (" ", FINALS + " ", ""), ("ㅘ", " ", "")]),
    ("", "", "ㅎ", True, [(" ", FINALS + " ", ""), ("ㅐ", CONTRACTED + " ", "")]),
]


def _closed(s: Syllable) -> Iterator[Form]:
    yield Form(s.vowel, s.coda)
    for onsets, vowels, finals, adjective, forms in CHANGING:
        if s.coda in finals and (not onsets or s.onset in onsets) and (not vowels or s.vowel in vowels) and (s.adjective or not adjective):
            for vowel, coda, followers in forms:
                yield Form(s.vowel if vowel == " " else vowel, s.coda if coda == "=" else coda, followers)
            return
    if s.alone or (s.adjective and s.coda == "ㅆ"):
        yield Form(s.vowel, s.coda, COMMON + EO + A + NO + EU + EUN + NEUN)


def _last(s: Syllable) -> set[str]:
    """Surface forms of a stem's last syllable."""
    found = _open(s) if s.coda == " " else _closed(s)
    return {compose(s.onset, f.vowel, c) + x for f in found for c in f.finals for x in f.followers or ("",)}


def conjugate(stems: Iterable[str], adjective: bool = False) -> set[str]:
    """All forms of stems (without 다)."""
    out: set[str] = set()
    for stem in stems:
        head, last = stem[:-1], stem[-1]
        onset, vowel, coda = decompose(last)
        if vowel == " ":
            out.add(stem)
            continue
        own = Syllable(onset, vowel, coda, not head, adjective)
        out |= {head + f for f in _last(own)}
        if last == "르" and head and not has_coda(head[-1]) and decompose(head[-1])[1] != " ":
            # 고르다 -> 골라
            o, v, _ = decompose(head[-1])
            out |= {head[:-1] + compose(o, v, "ㄹ") + f for f in _last(own)}
    return out if adjective else out - EDGE

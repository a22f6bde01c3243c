"""Noun phrases of Korean tokens."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple

from .hangul import decompose
from .ko_chunk import Token
from .ko_lexicon import Lexicon
from .ko_tokenize import grammar

#: Grammars of phrases, and the limits of a phrase.
RULES = {"D0m*N1s0": "Noun", "n*a+n*": "Noun", "n+": "Noun", "v*V1r*e0": "Verb", "v*J1r*e0": "Adjective"}
NOUN_RULES = {"D0m*N1s0": "Noun", "n*a+n*": "Noun", "n+": "Noun"}
MIN_CHARS, MAX_CHARS, MIN_PHRASES = 2, 30, 3
_NOUNS = frozenset(["Noun", "ProperNoun"])
_HEADS = frozenset(["Adjective", "Noun", "ProperNoun", "Alpha", "Number"])
_TAILS = frozenset(["Noun", "ProperNoun", "Alpha", "Number"])


class Phrase(NamedTuple):
    tokens: tuple[Token, ...]
    pos: str = "Noun"

    @property
    def text(self) -> str:
        return "".join(t.text for t in self.tokens)

    @property
    def offset(self) -> int:
        return self.tokens[0].offset if self.tokens else -1

    @property
    def length(self) -> int:
        return sum(t.length for t in self.tokens)


@dataclass(frozen=True)
class Mode:
    rules: dict[str, str]
    most: int  # phrases in a result
    keeps_space: bool
    joins_particles: bool
    lone_nouns: bool  # nouns of one token count if the lexicon has them


FULL = Mode(RULES, 8, True, True, False)
NOUNS = Mode(NOUN_RULES, 3, False, False, True)


def collapse(tokens: Iterable[Token], rules: dict[str, str] = RULES) -> list[Phrase]:
    """Tokens as phrases of the grammar; a token outside of it is a phrase of its own."""
    steps, starts = grammar(tuple(rules.items()))
    out: list[Phrase] = []
    at = starts
    for t in tokens:
        found = next((i for i in at if steps[i].pos == t.pos), None)
        opening = found is None or at is starts
        if found is None:
            found = next((i for i in starts if steps[i].pos == t.pos), None)
        if found is None:
            out.append(Phrase((t,), t.pos))
            at = starts
            continue
        made = steps[found].final or "Noun"
        if opening:
            out.append(Phrase((t,), made))
        else:
            out[-1] = Phrase((*out[-1].tokens, t), made)
        at = steps[found].follow
    return out


def _strip(tokens: tuple[Token, ...], left: bool = True, right: bool = True) -> tuple[Token, ...]:
    a, b = 0, len(tokens)
    while left and a < b and tokens[a].pos == "Space":
        a += 1
    while right and b > a and tokens[b - 1].pos == "Space":
        b -= 1
    return tokens[a:b]


def _trim(group: list[Phrase]) -> list[Phrase]:
    a, b = 0, len(group)
    while a < b and group[a].pos not in _HEADS:
        a += 1
    while b > a and group[b - 1].pos not in _TAILS:
        b -= 1
    group = group[a:b]
    last = len(group) - 1
    return [Phrase(_strip(p.tokens, i == 0, i == last), p.pos) if i in (0, last) else p for i, p in enumerate(group)]


def _modifies(p: Phrase, mode: Mode) -> bool:
    """Whether the phrase may stand within a noun phrase: numbers, letters, modifying predicates, joining particles."""
    tokens = _strip(p.tokens)
    if p.pos in ("Alpha", "Number") or not tokens:
        return p.pos in ("Alpha", "Number")
    last = tokens[-1].text
    if p.pos in ("Verb", "Adjective"):
        return decompose(last[-1])[2] in ("ㄹ", "ㄴ") and last[-1] != "만"
    return mode.joins_particles and p.pos == "Josa" and last in ("와", "과", "의")


def _distinct(groups: Iterable[list[Phrase]]) -> list[list[Phrase]]:
    seen: dict[str, list[Phrase]] = {}
    for g in groups:
        seen.setdefault("".join(p.text for p in g), g)
    return list(seen.values())


def _candidates(phrases: list[Phrase], lex: Lexicon, mode: Mode, filter_spam: bool) -> list[list[Phrase]]:
    spam = lambda p: filter_spam and any(t.text in lex.spam for t in p.tokens)
    joined: list[Phrase] = []
    fresh = True
    for p in phrases:
        noun = p.pos in _NOUNS
        if noun and not fresh:
            joined[-1] = Phrase(joined[-1].tokens + p.tokens)
        else:
            joined.append(Phrase(p.tokens) if noun else p)
        fresh = not noun
    out: list[list[Phrase]] = []
    running: list[Phrase] = []
    for p in joined:
        inside = p.pos in _NOUNS or (mode.keeps_space and p.pos == "Space")
        if inside and not spam(p):
            running = [*running, p]
            if p.pos in _NOUNS:
                out.append(running)
        elif _modifies(p, mode):
            running = [*running, p]
        else:
            out.append(running)
            running = []
    out.append(running)
    single = [[Phrase(_strip(p.tokens), p.pos)] for p in phrases if p.pos in _NOUNS and not spam(p) and (sum(t.length for t in _strip(p.tokens)) >= MIN_CHARS or len(_strip(p.tokens)) >= MIN_PHRASES)]
    return _distinct([_trim(g) for g in out] + single)


def _proper(group: list[Phrase], lex: Lexicon, mode: Mode) -> bool:
    own = [p for p in group if p.pos != "Space"]
    chars = sum(p.length for p in own)
    if not own or not own[-1].tokens or len(own) > mode.most or chars > MAX_CHARS:
        return False
    last = group[-1].tokens[-1]
    if last.pos == "Suffix" and last.text == "적":
        return False
    if mode.lone_nouns and len(group) == 1 and len(group[0].tokens) == 1 and lex.has("Noun", group[0].tokens[0].text):
        return True
    return (len(own) >= MIN_PHRASES or chars >= MIN_CHARS) and any(p.length > 1 for p in own)


def extract(tokens: list[Token], lex: Lexicon, filter_spam: bool = False, hashtags: bool = True, mode: Mode = FULL) -> list[Phrase]:
    groups = _distinct(g for g in _candidates(collapse(tokens, mode.rules), lex, mode, filter_spam) if _proper(g, lex, mode))
    out = [Phrase(tuple(t for p in _trim(g) for t in p.tokens)) for g in groups]
    return out + ([Phrase((t,), t.pos) for t in tokens if t.pos in ("Hashtag", "CashTag")] if hashtags and mode is FULL else [])


def extract_nouns(tokens: list[Token], lex: Lexicon) -> list[Phrase]:
    return extract(tokens, lex, mode=NOUNS)

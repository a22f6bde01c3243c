"""Korean tokens: a beam over a lattice of words whose parts of speech follow a grammar, then stems."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from ..errors import InvalidRequestError
from .hangul import compose, decompose, has_coda
from .ko_chunk import Token, chunk
from .ko_lexicon import ORDINAL, Lexicon
from .requests import check_length

#: Letters of the grammar, sequences and what they make; quantifiers 1, 0 (maybe), * and +.
LETTERS = {
    "N": "Noun", "V": "Verb", "J": "Adjective", "A": "Adverb", "D": "Determiner", "E": "Exclamation", "C": "Conjunction", "j": "Josa", "e": "Eomi", "r": "PreEomi",
    "m": "Modifier", "v": "VerbPrefix", "s": "Suffix", "a": "Alpha", "n": "Number", "o": "Others",
}
SEQUENCES = {"D0m*N1s0j0": "Noun", "v*V1r*e0": "Verb", "v*J1r*e0": "Adjective", "A1": "Adverb", "C1": "Conjunction", "E+": "Exclamation", "j1": "Josa"}
NOUN_SEQUENCES = {"D0m*N1s0": "Noun", "C1": "Conjunction"}
BEAM, REACH = 5, 8
_SUFFIXES = frozenset(["Suffix", "Eomi", "Josa", "PreEomi"])
_BEFORE_HA = frozenset(["Noun", "ProperNoun", "VerbPrefix"])
PREDICATES = frozenset(["Verb", "Adjective"])


@dataclass(frozen=True)
class Profile:
    """Weights of an analysis's score; smaller scores are better."""

    token_count: float = 0.18
    unknown: float = 0.3
    word_count: float = 0.3
    freq: float = 0.2
    unknown_coverage: float = 0.5
    exact_match: float = 0.5
    all_noun: float = 0.1
    unknown_pos: float = 10.0
    determiner: float = -0.01
    exclamation: float = 0.01
    initial_suffix: float = 0.2
    ha_verb: float = 0.3
    preferred_pattern: float = 0.6
    space_guide_penalty: float = 3.0
    josa_mismatch: float = 3.0
    space_guide: frozenset[int] = frozenset()


@dataclass(frozen=True)
class Step:
    """A word class of the grammar with the steps that may follow it, and whether a word may end here."""

    pos: str
    follow: tuple[int, ...]
    final: str | None


@functools.lru_cache(maxsize=8)
def grammar(sequences: tuple[tuple[str, str], ...]) -> tuple[tuple[Step, ...], tuple[int, ...]]:
    """Steps, and those that a word may start with."""
    steps: list[Step] = []
    starts: list[int] = []
    for pattern, made in reversed(sequences):
        items = [(LETTERS[pattern[i]], pattern[i + 1]) for i in range(0, len(pattern), 2)]
        base = len(steps)

        def reachable(i: int, items=items, base=base) -> list[int]:
            out = []
            while i < len(items):
                out.append(base + i)
                if items[i][1] in "1+":
                    break
                i += 1
            return out

        for i, (pos, q) in enumerate(items):
            rest = all(r in "0*" for _, r in items[i + 1 :])
            steps.append(Step(pos, tuple([base + i] * (q in "*+") + reachable(i + 1)), made if rest else None))
        starts += reachable(0)
    return tuple(steps), tuple(starts)


@dataclass(frozen=True)
class Parse:
    tokens: tuple[Token, ...]
    words: int
    at: tuple[int, ...]
    final: bool


def is_name(word: str, lex: Lexicon) -> bool:
    if word in lex.full_names or word in lex.given_names:
        return True
    split = {3: 1, 4: 2}.get(len(word))
    return bool(split) and word[:split] in lex.family_names and word[split:] in lex.given_names


#: Numerals, and what may end one.
_NUMERALS, _NUMERAL_ENDS = frozenset("일이삼사오육칠팔구천백십해경조억만"), frozenset("일이삼사오육칠팔구천백십해경조억만원배분초")


def is_number(word: str) -> bool:
    return all(c in _NUMERALS for c in word[:-1]) and word[-1:] in (_NUMERAL_ENDS | {""})


def is_name_variation(word: str, lex: Lexicon) -> bool:
    """A name, or one whose last consonant moved over to a following 이: 우혀니 for 우현이."""
    if is_name(word, lex):
        return True
    if not 3 <= len(word) <= 5:
        return False
    onset, vowel, coda = decompose(word[-1])
    before = decompose(word[-2])
    # fixed value: consonants that can be final, but for the silent one
    if onset not in "ㄱㄲㄴㄷㄹㅁㅂㅅㅆㅈㅊㅋㅌㅍㅎ" or vowel != "ㅣ" or coda != " " or before[2] != " " or before[1] == " ":
        return False
    stem = word[:-2] + compose(before[0], before[1], onset)
    return is_name(stem + "이", lex) or is_name(stem, lex)


#: Particles by what they follow.
_AFTER_CODA, _AFTER_VOWEL = frozenset("은이을과아"), frozenset("는가를와야여라")


def josa_attachable(before: str, head: str) -> bool:
    return head not in (_AFTER_VOWEL if has_coda(before) else _AFTER_CODA)


def _mismatch(noun: str, josa: str) -> bool:
    last = noun[-1]
    if has_coda(last):
        return (decompose(last)[2] != "ㄹ" and josa[0] == "로") or josa in ("는", "를", "다")
    return josa[0] == "으" or josa in ("은", "을", "이")


def score(p: Parse, lex: Lexicon, profile: Profile) -> float:
    t, n = p.tokens, len(p.tokens)
    pos = [x.pos for x in t]
    unknown = [x for x in t if x.unknown]
    freq = sum(1.0 - lex.freq.get(x.text, 0.0) if x.pos in ("Noun", "ProperNoun") else 1.0 for x in t) / n if n else 0.0
    ha = n >= 2 and pos[0] in _BEFORE_HA and pos[1] == "Verb" and t[1].text[0] in "하해"
    off = sum(x.offset not in profile.space_guide for x in t if x.pos not in _SUFFIXES) if profile.space_guide else 0
    return round(
        n * profile.token_count + len(unknown) * profile.unknown + p.words * profile.word_count + sum(x.length for x in unknown) * profile.unknown_coverage + freq * profile.freq
        + pos.count("Unknown") * profile.unknown_pos + (n != 1) * profile.exact_match + any(x not in ("Noun", "ProperNoun") for x in pos) * profile.all_noun
        + (pos not in (["Noun", "Josa"], ["ProperNoun", "Josa"])) * profile.preferred_pattern + pos.count("Determiner") * profile.determiner
        + pos.count("Exclamation") * profile.exclamation + (n > 0 and pos[0] in _SUFFIXES) * profile.initial_suffix + (not ha) * profile.ha_verb + off * profile.space_guide_penalty
        + any(a.pos == "Noun" and b.pos == "Josa" and _mismatch(a.text, b.text) for a, b in zip(t, t[1:], strict=False)) * profile.josa_mismatch,
        5,
    )


def analyses(c: Token, lex: Lexicon, profile: Profile = Profile(), sequences: dict[str, str] = SEQUENCES) -> list[list[Token]]:
    """Analyses of a Korean chunk, best first: that as one word of the lexicon, then the beam's by score."""
    steps, starts = grammar(tuple(sequences.items()))
    direct = next(([c._replace(pos=pos)] for pos, own in lex.words.items() if c.text in own), None)
    beams: list[list[tuple[float, int, Parse]]] = [[(0.0, 0, Parse((), 1, starts, False))]]
    for end in range(1, c.length + 1):
        found: list[tuple[float, int, Parse]] = []
        for start in range(end - 1, max(end - REACH, 0) - 1, -1):
            word = c.text[start:end]
            for _, _, p in beams[start]:
                options = [(i, 0) for i in p.at] + ([(i, 1) for i in starts] if p.final else [])
                for i, more in options:
                    s = steps[i]
                    known = lex.has(s.pos, word)
                    if not known and s.pos != "Noun":
                        continue
                    unknown = not known and not (is_name(word, lex) or is_number(word) or is_name_variation(word, lex))
                    t = (*p.tokens, Token(word, s.pos, c.offset + start, end - start, None, unknown))
                    q = Parse(t, p.words + more, s.follow, s.final is not None)
                    found.append((score(q, lex, profile), sum(ORDINAL[x.pos] for x in t), q))
            found = sorted(found, key=lambda x: x[:2])[:BEAM]
        beams.append(found)
    last = [list(p.tokens) for _, _, p in sorted(beams[-1], key=lambda x: x[0])] if c.length else []
    if not last:
        last = [[Token(c.text, "Noun", c.offset, c.length, None, True)]]
    out: list[list[Token]] = []
    for a in ([direct] if direct else []) + last:
        if a not in out:
            out.append(a)
    return out


def collapse_nouns(tokens: list[Token]) -> list[Token]:
    """Runs of nouns of one character become one unknown noun."""
    out: list[Token] = []
    running = False
    for t in tokens:
        single = t.pos == "Noun" and t.length == 1
        if single and running:
            text = out[-1].text + t.text
            out[-1] = Token(text, "Noun", out[-1].offset, len(text), None, True)
        else:
            out.append(t)
        running = single
    return out


def tokenize_top(text: str, lex: Lexicon, n: int = 1, profile: Profile = Profile(), sequences: dict[str, str] = SEQUENCES) -> list[list[list[Token]]]:
    """For each chunk its n best analyses."""
    check_length(text)
    if n < 1:
        raise InvalidRequestError("n must be 1 or more")
    return [[collapse_nouns(a) for a in analyses(c, lex, profile, sequences)[:n]] if c.pos == "Korean" else [[c]] for c in chunk(text)]


def stem(tokens: list[Token], lex: Lexicon) -> list[Token]:
    """Endings join the predicate before them, and predicates get their dictionary form."""
    if not any(t.pos in PREDICATES for t in tokens):
        return tokens
    out: list[Token] = []
    for t in tokens:
        if t.pos in ("Eomi", "PreEomi") and out and out[-1].pos in PREDICATES:
            out[-1] = out[-1]._replace(text=out[-1].text + t.text, length=out[-1].length + t.length)
        elif t.pos in PREDICATES:
            out.append(t._replace(stem=lex.stems.get(t.pos, {}).get(t.text)))
        else:
            out.append(t)
    return out


def tokenize(text: str, lex: Lexicon, profile: Profile = Profile()) -> list[Token]:
    return stem([t for best in tokenize_top(text, lex, 1, profile) for t in best[0]], lex)


def tokenize_nouns(text: str, lex: Lexicon, profile: Profile = Profile()) -> list[Token]:
    """By the grammar of nouns alone."""
    return [t for best in tokenize_top(text, lex, 1, profile, NOUN_SEQUENCES) for t in best[0]]


def texts(tokens: list[Token]) -> list[str]:
    return [t.text for t in tokens if t.pos != "Space"]


def detokenize(words: list[str], lex: Lexicon) -> str:
    """Words joined by spaces as their parts of speech ask: suffixes to what stands before, prefixes to what follows, a
    verb to its noun."""
    ends, at = set(), 0
    for w in words:
        at += len(w)
        ends.add(at)
    out: list[str] = []
    prefix, before = False, None
    for t in tokenize("".join(words), lex, replace(Profile(), space_guide=frozenset(ends))):
        joins = (out and (prefix or t.pos in _SUFFIXES or t.pos == "Punctuation")) or (before == "Noun" and t.pos == "Verb")
        if joins:
            out[-1] += t.text
        else:
            out.append(t.text)
        prefix = not joins and t.pos in ("Modifier", "VerbPrefix")
        before = t.pos
    return " ".join(out)

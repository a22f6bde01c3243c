"""Japanese tokens over a supplied lexicon: a shortest path of lexicon words, and runs of one script where none fits."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from .requests import check_length
from .scripts import in_script

NOUN, VERB, ADJECTIVE, PARTICLE, AUXILIARY, SYMBOL, UNKNOWN = "名詞", "動詞", "形容詞", "助詞", "助動詞", "記号", "未知語"


class JaToken(NamedTuple):
    surface: str
    pos: str
    position: int


#: A few words for tests and examples; lexicons are supplied otherwise.
SAMPLE = {
    "私": NOUN, "日本語": NOUN, "日本": NOUN, "語": NOUN, "勉強": NOUN, "東京": NOUN, "今日": NOUN, "天気": NOUN, "馬鹿": NOUN, "野郎": NOUN, "猫": NOUN,
    "し": VERB, "する": VERB, "行き": VERB, "食べ": VERB, "い": VERB, "良い": ADJECTIVE, "美しい": ADJECTIVE,
    "は": PARTICLE, "が": PARTICLE, "を": PARTICLE, "の": PARTICLE, "に": PARTICLE, "へ": PARTICLE, "て": PARTICLE, "ます": AUXILIARY, "です": AUXILIARY, "た": AUXILIARY,
    "、": SYMBOL, "。": SYMBOL,
}


def _kind(c: str) -> str:
    if c.isspace():
        return "space"
    if "ァ" <= c <= "ヿ" or "ｦ" <= c <= "ﾟ":
        return "katakana"
    if in_script(c, "japanese"):
        return "hiragana"
    if in_script(c, "chinese") or c in "々〆":
        return "han"
    return "alnum" if c.isalnum() else "symbol"


def segment(text: str, lexicon: Mapping[str, str] = SAMPLE) -> list[JaToken]:
    """Costs: 1 for a lexicon word, 3 and 1 a character for an unknown run of one script; of equal costs the longer last
    word."""
    check_length(text)
    n = len(text)
    longest = max(map(len, lexicon), default=1)
    run = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        run[i] = run[i + 1] + 1 if i + 1 < n and _kind(text[i]) == _kind(text[i + 1]) else 1
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(float("inf"), 0, "")] * n
    for i in range(n):
        here = best[i][0]
        for j in range(i + 1, min(n, i + longest) + 1):
            pos = lexicon.get(text[i:j])
            if pos and here + 1 < best[j][0]:
                best[j] = (here + 1, i, pos)
        kind = _kind(text[i])
        pos = {"symbol": SYMBOL, "space": SYMBOL, "hiragana": UNKNOWN}.get(kind, NOUN)
        for j in {i + 1, i + run[i]}:
            cost = here + 3 + (j - i)
            if cost < best[j][0]:
                best[j] = (cost, i, pos)
    out, j = [], n
    while j:
        _, i, pos = best[j]
        out.append(JaToken(text[i:j], pos, i))
        j = i
    return out[::-1]


def keep(tokens: list[JaToken], predicate: Callable[[JaToken], bool]) -> list[JaToken]:
    return [t for t in tokens if predicate(t)]


def is_noun(t: JaToken) -> bool:
    return t.pos == NOUN


def is_verb(t: JaToken) -> bool:
    return t.pos == VERB


def is_noun_or_verb(t: JaToken) -> bool:
    return t.pos in (NOUN, VERB)


def is_adjective(t: JaToken) -> bool:
    return t.pos == ADJECTIVE


def is_particle(t: JaToken) -> bool:
    return t.pos == PARTICLE


def is_auxiliary(t: JaToken) -> bool:
    return t.pos == AUXILIARY


def is_punctuation(t: JaToken) -> bool:
    return t.pos == SYMBOL


def nouns(tokens: list[JaToken]) -> list[JaToken]:
    return keep(tokens, is_noun)

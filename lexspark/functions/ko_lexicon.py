"""A small lexicon of our own, and the shape in which others are given to the Korean functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from .ko_conjugate import conjugate

#: Parts of speech; their order breaks ties between analyses.
POS = (
    "Noun", "Verb", "Adjective", "Adverb", "Determiner", "Exclamation", "Josa", "Eomi", "PreEomi", "Conjunction", "Modifier", "VerbPrefix", "Suffix", "Unknown",
    "Korean", "Foreign", "Number", "KoreanParticle", "Alpha", "Punctuation", "Hashtag", "ScreenName", "Email", "URL", "CashTag", "Space", "Others", "ProperNoun",
)
ORDINAL = {p: i for i, p in enumerate(POS)}


@dataclass(frozen=True)
class Lexicon:
    """words by part of speech in the order in which a whole chunk is looked up; stems of conjugated forms."""

    words: dict[str, frozenset[str]]
    stems: dict[str, dict[str, str]] = field(default_factory=dict)
    freq: dict[str, float] = field(default_factory=dict)
    typos: dict[int, dict[str, str]] = field(default_factory=dict)
    family_names: frozenset[str] = frozenset()
    given_names: frozenset[str] = frozenset()
    full_names: frozenset[str] = frozenset()
    spam: frozenset[str] = frozenset()

    def has(self, pos: str, word: str) -> bool:
        return word in self.words.get(pos, ())

    def with_nouns(self, *nouns: str) -> Lexicon:
        return self._nouns(self.words.get("Noun", frozenset()) | set(nouns))

    def without_nouns(self, *nouns: str) -> Lexicon:
        return self._nouns(self.words.get("Noun", frozenset()) - set(nouns))

    def _nouns(self, nouns: frozenset[str]) -> Lexicon:
        return Lexicon(self.words | {"Noun": frozenset(nouns)}, self.stems, self.freq, self.typos, self.family_names, self.given_names, self.full_names, self.spam)


def lexicon(words: dict[str, set[str] | frozenset[str] | list[str]], stems: dict[str, list[str]] | None = None, typos: dict[str, str] | None = None, **rest) -> Lexicon:
    """A lexicon of plain words and of predicate stems (Verb, Adjective), whose forms are conjugated here; of two stems
    with one form the later counts."""
    out, back = {"Noun": frozenset()} | {p: frozenset(w) for p, w in words.items()}, {}
    for pos, own in (stems or {}).items():
        forms: dict[str, str] = {}
        for s in own:
            for f in conjugate({s}, pos == "Adjective"):
                forms[f] = s + "다"
        back[pos] = forms
        out[pos] = out.get(pos, frozenset()) | set(forms)
    by_length: dict[int, dict[str, str]] = {}
    for a, b in (typos or {}).items():
        by_length.setdefault(len(a), {})[a] = b
    return Lexicon(out, back, typos=dict(sorted(by_length.items())), **rest)


def from_table(rows, **rest) -> Lexicon:
    """From rows of (word, pos); part of speech Verb and Adjective hold stems."""
    words: dict[str, list[str]] = {}
    stems: dict[str, list[str]] = {}
    for r in rows:
        (stems if r["pos"] in ("Verb", "Adjective") else words).setdefault(r["pos"], []).append(r["word"])
    return lexicon(words, stems, **rest)


def sample_lexicon() -> Lexicon:
    """Enough words for the tests and the example queries."""
    return lexicon(
        {
            "Noun": "사랑 사람 안녕 대선 후보 트위터 상승 한국어 세상 학교 공부 소리 버스 시간 친구 오늘 날씨 강아지 고양이 음악 영화 책 나라 바보 멍청이 정부 경제 개인 소비 음식 바다".split(),
            "Adverb": "매우 정말 아주 빨리 드디어".split(),
            "Determiner": "이 그 저 한 새".split(),
            "Exclamation": "아 와 헐 오".split(),
            "Josa": "은 는 이 가 을 를 의 에 에서 와 과 도 로 으로 만 부터 까지 하고".split(),
            "Eomi": "다 요 고 지 네 게 니다 어 아 가 며 면 은 는 을".split(),
            "PreEomi": "었 았 겠 시 셨 수".split(),
            "Conjunction": "그리고 그러나 하지만".split(),
            "Modifier": "초 대".split(),
            "VerbPrefix": "쵸 완전".split(),
            "Suffix": "들 적 님".split(),
        },
        {"Verb": ["하", "가", "먹", "보", "나오", "만들", "모르"], "Adjective": ["귀엽", "이렇", "예쁘", "기쁘", "맑", "좋"]},
        typos={"하겟": "하겠", "됬": "됐", "왠일": "웬일"},
        freq={"사랑": 0.5, "사람": 0.6, "안녕": 0.3},
        family_names=frozenset("김이박최정"),
        given_names=frozenset(["민수", "지현", "우현", "빠순"]),
        full_names=frozenset(["홍길동"]),
        spam=frozenset(["도박"]),
    )

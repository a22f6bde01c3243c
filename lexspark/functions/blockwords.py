"""Block words in Korean and Japanese text: evasive punctuation goes, tokens are looked up by severity, and masked."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from ..errors import InvalidRequestError
from ..options import BlockwordOptions, Severity
from .ja_segment import JaToken
from .ko_chunk import Token, chunk
from .ko_lexicon import Lexicon
from .ko_tokenize import tokenize
from .requests import check_length

#: Kinds of chunk between which punctuation is evasive, kinds that count as punctuation, marks of sentences.
_NORMAL = frozenset(["Korean", "KoreanParticle", "Foreign", "Number", "Alpha", "Adjective"])
_MARKS = frozenset(["Punctuation", "Email", "Hashtag", "CashTag"])
_SENTENCE = frozenset(".?!,;:。？！，；：…")
_BLOCKED = frozenset(["Noun", "Adjective", "Verb", "Adverb", "Korean", "KoreanParticle", "Foreign", "Number", "Alpha"])


class Tiers:
    """Words by severity; at a threshold all words of it and of higher ones count."""

    def __init__(self, words: Mapping[str, Severity]):
        self.words = dict(words)

    def at(self, threshold: Severity) -> frozenset[str]:
        return frozenset(w for w, s in self.words.items() if s.rank >= threshold.rank)

    def add(self, words: Iterable[str], severity: Severity) -> Tiers:
        return Tiers(self.words | {w: max(severity, self.words.get(w, severity), key=lambda s: s.rank) for w in words})

    def remove(self, words: Iterable[str]) -> Tiers:
        gone = set(words)
        return Tiers({w: s for w, s in self.words.items() if w not in gone})


def removable(chunks: list[Token]) -> list[bool]:
    """For each chunk whether it is punctuation (or space within it) that only splits a word."""
    out = [False] * len(chunks)
    i = 0
    while i < len(chunks):
        j = i
        while j < len(chunks) and (chunks[j].pos in _MARKS or chunks[j].pos == "Space"):
            j += 1
        if j == i:
            i += 1
            continue
        if i and j < len(chunks) and chunks[i - 1].pos in _NORMAL and chunks[j].pos in _NORMAL:
            marks = [k for k in range(i, j) if chunks[k].pos in _MARKS]
            spaced = len(marks) < j - i
            odd = any(c not in _SENTENCE for k in marks for c in chunks[k].text)
            if not spaced or (len(marks) > 1 and odd):
                for k in range(i, j) if len(marks) > 1 else marks:
                    out[k] = True
        i = j
    return out


def find_punctuation(text: str) -> list[tuple[Token, bool]]:
    """The chunks between the first and the last, and whether they go."""
    chunks = chunk(text)
    return list(zip(chunks, removable(chunks), strict=True))[1:-1]


def remove_punctuation(text: str) -> str:
    chunks = chunk(text)
    return "".join(c.text for c, gone in zip(chunks, removable(chunks), strict=True) if not gone)


def _hits(token: Token, words: frozenset[str]) -> bool:
    return token.length > 1 and token.pos in _BLOCKED and (token.text in words or token.stem in words)


def find_ko(text: str, lex: Lexicon, tiers: Tiers) -> list[Token]:
    """Tokens of the text without evasive punctuation that are block words of any severity."""
    check_length(text)
    words = tiers.at(Severity.LOW)
    return [t for t in tokenize(remove_punctuation(text), lex) if _hits(t, words)] if text.strip() else []


def mask_ko(text: str, lex: Lexicon, tiers: Tiers, options: BlockwordOptions = BlockwordOptions()) -> tuple[str, list[str]]:
    """The text without evasive punctuation, masked, and the words found from the last to the first."""
    check_length(text)
    if not text.strip():
        return "", []
    if options.locale != "ko":
        raise InvalidRequestError("only Korean is supported")
    out = remove_punctuation(text)
    words = tiers.at(options.severity)
    found = sorted((t for t in tokenize(out, lex) if not t.unknown and _hits(t, words)), key=lambda t: -t.offset)
    for t in found:
        out = out[: t.offset] + options.mask * t.length + out[t.offset + t.length :]
    return out, [t.text for t in found]


def _ja_spans(tokens: list[JaToken], words: frozenset[str]) -> list[tuple[int, str]]:
    """Nouns and verbs, and adjacent pairs of a noun and one of them; the leftmost, of these the longest, without overlap."""
    content = lambda t: t.pos in ("名詞", "動詞")
    spans = [(t.position, t.surface) for t in tokens if content(t)]
    for a, b in zip(tokens, tokens[1:], strict=False):
        if a.pos == "名詞" and content(b) and a.position + len(a.surface) == b.position:
            spans.append((a.position, a.surface + b.surface))
    out, last = [], 0
    for at, s in sorted((x for x in spans if x[1] in words), key=lambda x: (x[0], -len(x[1]))):
        if at >= last:
            out.append((at, s))
            last = at + len(s)
    return out


def find_ja(tokens: list[JaToken], tiers: Tiers, threshold: Severity = Severity.LOW) -> list[str]:
    return [s for _, s in _ja_spans(tokens, tiers.at(threshold))]


def mask_ja(text: str, tokens: list[JaToken], tiers: Tiers, options: BlockwordOptions = BlockwordOptions(locale="ja")) -> tuple[str, list[str]]:
    check_length(text)
    if not text.strip():
        return "", []
    if options.locale != "ja":
        raise InvalidRequestError("only Japanese is supported")
    spans = _ja_spans(tokens, tiers.at(options.severity))
    for at, s in reversed(spans):
        text = text[:at] + options.mask * len(s) + text[at + len(s) :]
    return text, [s for _, s in spans]

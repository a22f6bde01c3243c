"""Splitting text into the pieces that byte-level BPE encodes one by one, with caches of what pieces become."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from typing import Any

import regex

#: Characters for which the classes of `re` and of the tokenizers' engines agree; other texts take the slower engine.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A lone space between two other characters: a piece always ends before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_CONTROL = re.compile("[\x1c-\x1f]")
_GAP = re.compile(r"\s\s|^\s|\s$")


@functools.lru_cache(maxsize=1)
def _stand_ins() -> dict[int, str]:
    """Code points whose class (letter, number, blank, other) is another in the library's engine than in `regex`, with a
    character that has that class in both. The library skips what a pattern does not match, which shows its classes."""
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\u3000"}
    theirs: dict[str, str] = {}
    ours: dict[str, str] = {}
    for pattern, stand_in in classes.items():
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs |= dict.fromkeys(probe.decode(probe.encode_ordinary(everything)), stand_in)
        ours |= dict.fromkeys(regex.findall(pattern, everything), stand_in)
    return {ord(c): theirs.get(c, "\u2020") for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


def find_pieces(pattern: regex.Pattern, text: str) -> list[str]:
    """The pattern's matches in text by the library's classes of characters."""
    if text.isascii() and not _CONTROL.search(text):
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(_stand_ins()))]


class Cache(dict):
    """A dictionary of bounded size in two generations: entries met again while in the older one move to the newer."""

    def __init__(self, limit: int):
        self.limit, self.older = limit // 2, {}

    def __missing__(self, key: str) -> Any:
        value = self.older.get(key)
        if value is not None:
            self[key] = value
        return value

    def add(self, items: Iterable[tuple[str, Any]]) -> None:
        self.update((k, v) for k, v in items if len(k) <= 48)
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class PieceCache:
    """Maps texts to lists of values, one per chunk: a chunk is what stands between lone spaces, with the space before.

    encode(pieces) gives a value for each of the pattern's matches; join(values) the value of a chunk. Values are kept in
    caches of bounded size.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[Any]], join: Callable[[list[Any]], Any], limit: int = 500_000):
        self.pattern, self.encode, self.join = regex.compile(pattern), encode, join
        self.chunks, self.pieces = Cache(limit), Cache(2 * limit)

    def texts(self, texts: list[str]) -> list[list[Any]]:
        cut: list[list[str]] = []
        out: list[list[Any]] = []
        missing: set[str] = set()
        first: list[str] = []
        get = self.chunks.__getitem__
        for text in texts:
            if not text:
                own, values = [], []
            elif UNUSUAL.search(text):
                own, values = [], self._values([find_pieces(self.pattern, text)])
            else:
                own = _CUT.split(text) if _GAP.search(text) else text.split(" ")
                values = list(map(get, own))
                values[0] = None
                first.append(own[0])
                missing.update([c for c, v in zip(own, values, strict=True) if v is None])
            cut.append(own)
            out.append(values)
        opening = iter(self._values([_QUICK.findall(c) for c in first]))
        chunks = list(missing)
        fresh = dict(zip(chunks, self._values([[" " + c] if c.isalpha() else _QUICK.findall(" " + c) for c in chunks]), strict=True))
        for own, values in zip(cut, out, strict=True):
            if own:
                values[0] = next(opening)
                if None in values:
                    values[:] = [fresh[c] if v is None else v for c, v in zip(own, values, strict=True)]
        self.chunks.add(fresh.items())
        return out

    def _values(self, cut: list[list[str]]) -> list[Any]:
        kept, join = self.pieces, self.join
        distinct = list({p for own in cut for p in own})
        known = dict(zip(distinct, map(kept.__getitem__, distinct), strict=True))
        missing = [p for p, v in known.items() if v is None]
        if missing:
            fresh = list(zip(missing, self.encode(missing), strict=True))
            known.update(fresh)
            kept.add(fresh)
        get = known.__getitem__
        return [get(own[0]) if len(own) == 1 else join(list(map(get, own))) for own in cut]

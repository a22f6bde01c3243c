"""Search for many keywords at once (Aho and Corasick 1975), and the policies for overlapping matches."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

from ..errors import InvalidRequestError
from ..options import SearchOptions, WordBoundary
from .offsets import Prepared, prepare, prepare_keyword

try:
    import ahocorasick
except ImportError:  # the machine below does the same
    ahocorasick = None


class Match(NamedTuple):
    """start and end (inclusive) in the source text; keyword as it is searched for."""

    start: int
    end: int
    keyword: str
    value: str


class Dictionary:
    """Keywords with values, checked: none is blank, and no two are equal once prepared for the options."""

    def __init__(self, keywords: Mapping[str, str] | Iterable[str], options: SearchOptions = SearchOptions()):
        items = keywords.items() if isinstance(keywords, Mapping) else ((k, k) for k in keywords)
        self.options = options
        self.values: dict[str, str] = {}
        for k, v in items:
            if not k or k.isspace():
                raise InvalidRequestError("a keyword must not be blank")
            own = prepare_keyword(k, options)
            if own in self.values:
                raise InvalidRequestError("Normalization collision: two keywords are equal once prepared")
            self.values[own] = v
        self._measure()

    def _measure(self) -> None:
        self.longest = max(map(len, self.values), default=0)
        #: One less than each keyword's length.
        self.sizes = {k: len(k) - 1 for k in self.values}
        self._machine = None

    def __reduce__(self):
        return _rebuild, (self.values, self.options)

    def raw(self, text: str) -> Iterator[tuple[int, str]]:
        """(end, keyword) of every occurrence by end; at one end the keywords in lexicographic order."""
        if not self.values:
            return
        if self._machine is None:
            self._machine = _Accelerated(self.values) if ahocorasick else Machine(self.values)
        yield from self._machine.run(text)


def _rebuild(values: dict[str, str], options: SearchOptions) -> Dictionary:
    d = Dictionary({}, options)
    d.values = values
    d._measure()
    return d


class _Accelerated:
    def __init__(self, keywords: Iterable[str]):
        self.machine = ahocorasick.Automaton()
        for k in keywords:
            self.machine.add_word(k, k)
        self.machine.make_automaton()

    def run(self, text: str) -> Iterator[tuple[int, str]]:
        found = list(self.machine.iter(text))
        found.sort()
        return iter(found)


class Machine:
    """States as dictionaries of transitions; missing ones are found over failure links and kept."""

    def __init__(self, keywords: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail = [0]
        own: list[list[str]] = [[]]
        for k in sorted(keywords):
            s = 0
            for c in k:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    own.append([])
                s = self.next[s][c]
            own[s].append(k)
        queue = deque(self.next[0].values())
        while queue:
            s = queue.popleft()
            for c, t in self.next[s].items():
                f = self.fail[s]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f].get(c, 0)
                own[t] = own[t] + own[self.fail[t]]
                queue.append(t)
        self.emits = [tuple(sorted(x)) for x in own]
        self.step = [dict(x) for x in self.next]

    def _move(self, s: int, c: str) -> int:
        f = s
        while f and c not in self.next[f]:
            f = self.fail[f]
        to = self.next[f].get(c, 0)
        if c in self.next[0] or to:
            self.step[s][c] = to
        return to

    def run(self, text: str) -> Iterator[tuple[int, str]]:
        s, step, emits = 0, self.step, self.emits
        for i, c in enumerate(text):
            t = step[s].get(c)
            s = self._move(s, c) if t is None else t
            if emits[s]:
                for k in emits[s]:
                    yield i, k


def bounded(text: str, start: int, end: int, boundary: WordBoundary) -> bool:
    """Whether the match [start, end] stands as the boundary asks."""
    if boundary is WordBoundary.NONE:
        return True
    before, after = text[start - 1 : start] if start else "", text[end + 1 : end + 2]
    if boundary is WordBoundary.LATIN_ALPHA:
        return not before.isalpha() and not after.isalpha()
    return (not before or before.isspace()) and (not after or after.isspace())


def _found(d: Dictionary, p: Prepared, everything: bool) -> list[tuple[int, int, str]]:
    out = []
    for end, k in d.raw(p.text):
        out.append((end - len(k) + 1, end, k))
        if d.options.stop_on_first and not everything:
            break
    return [m for m in out if bounded(p.text, m[0], m[1], d.options.boundary)]


def longest_first(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans kept by length, then start; a kept one removes all that overlap it. Result by start."""
    starts: list[int] = []  # of the kept ones, which do not overlap, in order
    kept: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda m: (m[0] - m[1], m[0])):
        at = bisect_left(starts, s[0])
        if (at == 0 or kept[at - 1][1] < s[0]) and (at == len(kept) or kept[at][0] > s[1]):
            starts.insert(at, s[0])
            kept.insert(at, s)
    return kept


def leftmost_longest(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept, last = [], -1
    for s in sorted(spans, key=lambda m: (m[0], -m[1], m[2])):
        if s[0] > last:
            kept.append(s)
            last = s[1]
    return kept


def _matches(d: Dictionary, p: Prepared, spans: Iterable[tuple[int, int, str]]) -> list[Match]:
    return [Match(*p.span(a, b), k, d.values[k]) for a, b, k in spans]


def parse(d: Dictionary, text: str) -> list[Match]:
    """All matches by start, then longer ones, then keyword; under allow_overlaps=False the longest-first survivors;
    under stop_on_first what the first raw match leaves after the boundary check."""
    p = prepare(text, d.options)
    spans = _found(d, p, False)
    if not d.options.allow_overlaps:
        spans = longest_first(spans)
    return sorted(_matches(d, p, spans), key=lambda m: (m.start, m.start - m.end, m.keyword))


def parse_rows(d: Dictionary, text: str) -> list[tuple[int, int, str]]:
    """(start, end, keyword) as parse gives them, without the objects where no option asks for more than a sort."""
    o = d.options
    p = prepare(text, o)
    if p.starts is None and o.allow_overlaps and o.boundary is WordBoundary.NONE and not o.stop_on_first:
        size = d.sizes
        rows = [(e - size[k], -size[k], k) for e, k in d.raw(p.text)]
        rows.sort()
        return [(a, a - n, k) for a, n, k in rows]
    return [m[:3] for m in parse(d, text)]


def stream(d: Dictionary, text: str) -> Iterator[Match]:
    """Matches in raw order (end, then keyword), whatever stop_on_first says."""
    p = prepare(text, d.options)
    if d.options.allow_overlaps and d.options.boundary is WordBoundary.NONE:
        yield from (Match(*p.span(e - len(k) + 1, e), k, d.values[k]) for e, k in d.raw(p.text))
        return
    spans = _found(d, p, True)
    yield from _matches(d, p, spans if d.options.allow_overlaps else longest_first(spans))


def first(d: Dictionary, text: str) -> Match | None:
    """The leftmost match, of these the longest; stop_on_first and overlaps do not matter."""
    p = prepare(text, d.options)
    spans = _found(d, p, True)
    return _matches(d, p, [min(spans, key=lambda m: (m[0], -m[1], m[2]))])[0] if spans else None


def contains(d: Dictionary, text: str) -> bool:
    p = prepare(text, d.options)
    return any(bounded(p.text, e - len(k) + 1, e, d.options.boundary) for e, k in d.raw(p.text))


def _cut(d: Dictionary, text: str) -> list[Match]:
    p = prepare(text, d.options)
    spans = _found(d, p, True)
    kept = _matches(d, p, leftmost_longest(spans) if d.options.allow_overlaps else longest_first(spans))
    out, last = [], -1
    for m in kept:
        if m.start > last:
            out.append(m)
            last = m.end
    return out


def tokenize(d: Dictionary, text: str) -> list[tuple[str, str, Match | None]]:
    """(kind, text, match): matches that do not overlap, and the fragments between them; they join to the text."""
    out, last = [], 0
    for m in _cut(d, text):
        if m.start > last:
            out.append(("FRAGMENT", text[last : m.start], None))
        out.append(("MATCH", text[m.start : m.end + 1], m))
        last = m.end + 1
    if last < len(text):
        out.append(("FRAGMENT", text[last:], None))
    return out


def replace_all(d: Dictionary, text: str, transform) -> str:
    out, last = [], 0
    for m in _cut(d, text):
        out += [text[last : m.start], transform(m)]
        last = m.end + 1
    return "".join([*out, text[last:]])


class Scanner:
    """Chunks of one text; its matches come out as they would from the whole, whatever the cuts. Offsets count from the
    start of the text, and stop_on_first does not matter.

    With overlaps a match is given out once no later character can change what starts at or before it. Without them, it is
    held back to the end of its cluster, the matches that overlap one another: a cluster is decided when no match to come
    can reach into it. The tail begins one character before what is undecided, as that character may be a boundary.
    """

    def __init__(self, d: Dictionary):
        if d.options.normalization.value != "NONE":
            raise InvalidRequestError("a scanner takes no normalization")
        self.d = d
        self.reset()

    def reset(self) -> None:
        self.tail, self.offset, self.done = "", 0, set()

    def scan(self, chunk: str) -> list[Match]:
        self.tail += chunk
        return self._give(False)

    def finish(self) -> list[Match]:
        out = self._give(True)
        self.reset()
        return out

    def _give(self, last: bool) -> list[Match]:
        p = prepare(self.tail, self.d.options)
        n = len(p.text)
        # a match that is still to come, or whose boundary is not known, starts here or later
        edge = n if last else max(0, n - self.d.longest)
        found = [(s, self._place(p, s)) for s in _found(self.d, p, True) if self.offset == 0 or s[0] > 0]
        spans = [s for s, place in found if place not in self.done]
        if self.d.options.allow_overlaps:
            ready = [s for s in spans if s[1] < edge]
            keep = edge - self.d.longest
        else:
            decided: list[tuple[int, int, str]] = []
            open_, reach = len(spans), -1
            spans.sort()
            for i, s in enumerate(spans):
                if s[0] > reach:  # the cluster before ends
                    if reach >= edge:
                        break
                    open_ = i
                reach = max(reach, s[1])
            if reach < edge:
                open_ = len(spans)
            decided, rest = spans[:open_], spans[open_:]
            ready = longest_first(decided)
            keep = min(edge, rest[0][0]) if rest else edge
        out = []
        for start, end, k in ready:
            place = self._place(p, (start, end, k))
            self.done.add(place)
            out.append(Match(*place, self.d.values[k]))
        cut = p.span(keep, keep)[0] - 1 if 0 < keep < n else n - 1 if keep >= n else 0
        cut = max(0, cut)
        self.offset += cut
        self.tail = self.tail[cut:]
        self.done = {x for x in self.done if x[1] >= self.offset}
        return out

    def _place(self, p: Prepared, span: tuple[int, int, str]) -> tuple[int, int, str]:
        a, b = p.span(span[0], span[1])
        return a + self.offset, b + self.offset, span[2]

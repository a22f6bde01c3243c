"""Redaction by rules: keyword and regular-expression rules give spans; overlapping spans merge and are masked."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidRequestError, LexsparkError
from ..functions import automaton as engine
from ..options import Normalization, SearchOptions

_SLUG = re.compile(r"[a-z0-9._-]{1,64}")
_W = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
#: The default policy's patterns, between word edges in ASCII.
EMAIL = rf"{_EDGE}[A-Za-z0-9._%+\-]{{1,64}}@[A-Za-z0-9.\-]{{1,253}}\.[A-Za-z]{{2,24}}{_EDGE}"
PHONE = rf"{_EDGE}(?:\+?1[-.\s]?)?\(?\d{{3}}\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}}{_EDGE}"


@dataclass(frozen=True)
class Rule:
    """A keyword (up to 1,024 characters) or a pattern (up to 4,096); smaller priorities name merged spans."""

    id: str
    category: str
    keyword: str | None = None
    pattern: str | None = None
    priority: int = 100
    ignore_case: bool = False

    def __post_init__(self):
        if not _SLUG.fullmatch(self.id) or not _SLUG.fullmatch(self.category):
            raise InvalidRequestError("rule id and category must be 1 to 64 of a-z 0-9 . _ -")
        if not 1 <= self.priority <= 1000:
            raise InvalidRequestError("priority must be 1 to 1000")
        if (self.keyword is None) == (self.pattern is None):
            raise InvalidRequestError("a rule has a keyword or a pattern")
        text, most = (self.keyword.strip(), 1024) if self.keyword is not None else (self.pattern, 4096)
        if not text or len(text) > most:
            raise InvalidRequestError(f"rule length must be 1 to {most}")
        if self.keyword is not None:
            object.__setattr__(self, "keyword", text)
        else:
            try:
                self.compiled()
            except regex.error:
                raise InvalidRequestError("the rule's pattern is not valid") from None

    def compiled(self) -> regex.Pattern:
        return regex.compile(self.pattern, regex.IGNORECASE if self.ignore_case else 0)


@dataclass(frozen=True)
class Policy:
    rules: Sequence[Rule]
    mask: str = "*"
    max_length: int = 4096
    ignore_case: bool = True
    normalization: Normalization = Normalization.NFC

    def __post_init__(self):
        if not 1 <= len(self.rules) <= 128:
            raise InvalidRequestError("a policy has 1 to 128 rules")
        if len({r.id for r in self.rules}) < len(self.rules):
            raise InvalidRequestError("rule ids must differ")
        if len(self.mask) != 1 or not self.mask.isprintable() or self.mask.isspace() or self.mask > "￿":
            raise InvalidRequestError("the mask must be one visible character")


def default_policy(**options) -> Policy:
    return Policy([Rule("email", "contact", pattern=EMAIL, priority=10), Rule("phone", "contact", pattern=PHONE, priority=20)], **options)


class Redactor:
    def __init__(self, policy: Policy):
        self.policy = policy
        self.patterns = [(r, r.compiled()) for r in policy.rules if r.pattern is not None]
        self.rules = {r.id: r for r in policy.rules}
        options = SearchOptions(ignore_case=policy.ignore_case, normalization=policy.normalization)
        by_word: dict[str, list[str]] = {}
        for r in policy.rules:
            if r.keyword is not None:
                by_word.setdefault(engine.prepare_keyword(r.keyword, options), []).append(r.id)
        self.words = by_word
        self.dictionary = engine.Dictionary(list(by_word), options) if by_word else None

    def __reduce__(self):
        return Redactor, (self.policy,)

    def find(self, text: str) -> list[tuple[int, int, Rule]]:
        """(start, end exclusive, rule) of all matches; those of no length do not count."""
        out = [(m.start(), m.end(), r) for r, p in self.patterns for m in p.finditer(text) if m.end() > m.start()]
        if self.dictionary:
            out += [(m.start, m.end + 1, self.rules[i]) for m in engine.parse(self.dictionary, text) for i in self.words[m.keyword]]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str, list[str]]]:
        """(start, end, category, rule ids): overlapping matches are one span, adjacent ones are not; it is named after its
        rule of best priority, and lists its rules by priority."""
        found = sorted(self.find(text), key=lambda x: (x[0], -x[1], x[2].priority, x[2].id, x[2].category))
        groups: list[tuple[int, int, list[Rule]]] = []
        for start, end, rule in found:
            if groups and start < groups[-1][1]:
                s, e, rules = groups[-1]
                groups[-1] = (s, max(e, end), [*rules, rule])
            else:
                groups.append((start, end, [rule]))
        out = []
        for s, e, rules in groups:
            ranked = sorted(set(rules), key=lambda r: (r.priority, r.id, r.category))
            out.append((s, e, ranked[0].category, list(dict.fromkeys(r.id for r in ranked))))
        return out

    def redact(self, text: str) -> tuple[str, list[tuple[int, int, str, list[str]]]]:
        if len(text) > self.policy.max_length:
            raise InvalidRequestError(f"text of {len(text)} characters exceeds {self.policy.max_length}")
        spans = self.spans(text)
        return mask(text, [(s, e) for s, e, *_ in spans], self.policy.mask), spans


def mask(text: str, spans: Sequence[tuple[int, int]], char: str) -> str:
    out, last = [], 0
    for s, e in sorted(spans):
        out += [text[last:s], char * (e - s)]
        last = e
    return "".join([*out, text[last:]])


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("rule_ids", pa.list_(pa.string()))])
_RESULT = pa.struct([("status", pa.int32()), ("redacted", pa.string()), ("spans", pa.list_(_SPAN))])
RESULT = "struct<status:int,redacted:string,spans:array<struct<start:int,end:int,category:string,rule_ids:array<string>>>>"


def redact(text: Column, policy: Policy) -> Column:
    """struct(status, redacted, spans): status 200, or 413 with nothing else for a text beyond the policy's length and
    400 for one that is refused otherwise."""
    redactor = Redactor(policy)

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
            elif len(t) > policy.max_length:
                out.append({"status": 413, "redacted": None, "spans": None})
            else:
                try:
                    r, spans = redactor.redact(t)
                except LexsparkError:
                    out.append({"status": 400, "redacted": None, "spans": None})
                    continue
                out.append({"status": 200, "redacted": r, "spans": [dict(zip(("start", "end", "category", "rule_ids"), s, strict=True)) for s in spans]})
        return pa.array(out, _RESULT)

    return run(text)


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, category, rule_ids of spans (key, start, end exclusive, rule_id, category, priority): strictly
    overlapping spans become one. Gaps and islands by windows, so a text's spans are never collected but per island."""
    w = W.partitionBy(key).orderBy("start", F.desc("end"), "priority", "rule_id", "category")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).over(w)
    rank = F.struct("priority", "rule_id", "category")
    return (
        spans.withColumn("_i", island).groupBy(key, "_i")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("category", rank).alias("category"), F.sort_array(F.collect_set(rank)).alias("_r"))
        .select(key, "start", "end", "category", F.array_distinct(F.transform("_r", lambda r: r["rule_id"])).alias("rule_ids"))
    )


def native_mask(text: Column, pattern: str, char: str = "*") -> Column:
    """Every character of the pattern's matches becomes char, without Python."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(F.flatten(F.zip_with(parts, F.transform(found, lambda m: F.repeat(F.lit(char), F.length(m))), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")

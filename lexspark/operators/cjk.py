"""Korean and Japanese operators as columns; the work is done per Arrow batch with the lexicon sent along once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import LexsparkError
from ..functions import blockwords, ja_segment, ko_chunk, ko_conjugate, ko_phrases, ko_text, ko_tokenize
from ..functions.blockwords import Tiers
from ..functions.ko_lexicon import Lexicon
from ..options import BlockwordOptions

TOKEN = "struct<text:string,pos:string,offset:int,length:int,stem:string,unknown:boolean>"
_TOKEN = pa.struct([("text", pa.string()), ("pos", pa.string()), ("offset", pa.int32()), ("length", pa.int32()), ("stem", pa.string()), ("unknown", pa.bool_())])
_SENTENCE = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_PHRASE = pa.struct([("text", pa.string()), ("pos", pa.string()), ("offset", pa.int32()), ("length", pa.int32()), ("tokens", pa.list_(_TOKEN))])
_JA = pa.struct([("surface", pa.string()), ("pos", pa.string()), ("position", pa.int32()), ("length", pa.int32())])
_MASKED = pa.struct([("status", pa.int32()), ("masked", pa.string()), ("blockwords", pa.list_(pa.string()))])


def per_text(text: Column, schema: str, kind: pa.DataType, f: Callable[[object], object]) -> Column:
    """Column of f over the values; nulls stay, and a value that f refuses becomes null."""

    def safe(value: object) -> object:
        try:
            return f(value)
        except LexsparkError:
            return None

    @F.arrow_udf(schema)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else safe(v) for v in values.to_pylist()], kind)

    return run(text)


def _tokens(xs) -> list[dict]:
    return [t._asdict() for t in xs]


def ko_chunks(text: Column) -> Column:
    return per_text(text, f"array<{TOKEN}>", pa.list_(_TOKEN), lambda t: _tokens(ko_chunk.chunk(t)))


def ko_tokens(text: Column, lex: Lexicon, nouns: bool = False) -> Column:
    f = ko_tokenize.tokenize_nouns if nouns else ko_tokenize.tokenize
    return per_text(text, f"array<{TOKEN}>", pa.list_(_TOKEN), lambda t: _tokens(f(t, lex)))


def ko_top_tokens(text: Column, lex: Lexicon, n: int) -> Column:
    """For each chunk its n best analyses."""
    return per_text(text, f"array<array<array<{TOKEN}>>>", pa.list_(pa.list_(pa.list_(_TOKEN))), lambda t: [[_tokens(a) for a in best] for best in ko_tokenize.tokenize_top(t, lex, n)])


def token_texts(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: t["pos"] != "Space"), lambda t: t["text"])


def ko_normalize(text: Column, lex: Lexicon) -> Column:
    return per_text(text, "string", pa.string(), lambda t: ko_text.normalize(t, lex))


def ko_sentences(text: Column) -> Column:
    return per_text(text, "array<struct<text:string,start:int,end:int>>", pa.list_(_SENTENCE), lambda t: [dict(zip(("text", "start", "end"), s, strict=True)) for s in ko_text.sentences(t)])


def ko_phrases_column(text: Column, lex: Lexicon, filter_spam: bool = False, hashtags: bool = True, nouns: bool = False) -> Column:
    def f(t: str) -> list[dict]:
        own = ko_tokenize.tokenize(t, lex)
        found = ko_phrases.extract_nouns(own, lex) if nouns else ko_phrases.extract(own, lex, filter_spam, hashtags)
        return [{"text": p.text, "pos": p.pos, "offset": p.offset, "length": p.length, "tokens": _tokens(p.tokens)} for p in found]

    return per_text(text, f"array<struct<text:string,pos:string,offset:int,length:int,tokens:array<{TOKEN}>>>", pa.list_(_PHRASE), f)


def ko_detokenize(words: Column, lex: Lexicon) -> Column:
    return per_text(words, "string", pa.string(), lambda w: ko_tokenize.detokenize(list(w), lex))


def ko_remove_punctuation(text: Column) -> Column:
    return per_text(text, "string", pa.string(), blockwords.remove_punctuation)


def ko_mask(text: Column, lex: Lexicon, tiers: Tiers, options: BlockwordOptions = BlockwordOptions()) -> Column:
    def f(t: str) -> dict:
        masked, found = blockwords.mask_ko(t, lex, tiers, options)
        return {"status": 200, "masked": masked, "blockwords": found}

    return per_text(text, "struct<status:int,masked:string,blockwords:array<string>>", _MASKED, f)


def ko_blockwords(text: Column, lex: Lexicon, tiers: Tiers) -> Column:
    return per_text(text, f"array<{TOKEN}>", pa.list_(_TOKEN), lambda t: _tokens(blockwords.find_ko(t, lex, tiers)))


def ja_tokens(text: Column, lexicon: Mapping[str, str]) -> Column:
    own = dict(lexicon)
    return per_text(text, "array<struct<surface:string,pos:string,position:int,length:int>>", pa.list_(_JA), lambda t: [{**x._asdict(), "length": len(x.surface)} for x in ja_segment.segment(t, own)])


def ja_mask(text: Column, lexicon: Mapping[str, str], tiers: Tiers, options: BlockwordOptions) -> Column:
    own = dict(lexicon)

    def f(t: str) -> dict:
        masked, found = blockwords.mask_ja(t, ja_segment.segment(t, own), tiers, options)
        return {"status": 200, "masked": masked, "blockwords": found}

    return per_text(text, "struct<status:int,masked:string,blockwords:array<string>>", _MASKED, f)


def ko_forms(stem: Column, adjective: bool = False) -> Column:
    """All surface forms of a predicate's stem, in order."""
    return per_text(stem, "array<string>", pa.list_(pa.string()), lambda t: sorted(ko_conjugate.conjugate([t], adjective)) if t else [])


def ko_punctuation(text: Column) -> Column:
    """The chunks between the first and the last, and whether they go."""
    kind = pa.struct([("text", pa.string()), ("gone", pa.bool_())])
    return per_text(text, "array<struct<text:string,gone:boolean>>", pa.list_(kind), lambda t: [{"text": c.text, "gone": bool(gone)} for c, gone in blockwords.find_punctuation(t)])


def ko_word_kinds(word: Column, lex: Lexicon) -> Column:
    """Whether the word is a person's name, a number, or a variation of a name."""
    kind = pa.struct([(c, pa.bool_()) for c in ("name", "number", "variation")])
    f = lambda w: {"name": ko_tokenize.is_name(w, lex), "number": ko_tokenize.is_number(w), "variation": ko_tokenize.is_name_variation(w, lex)}
    return per_text(word, "struct<name:boolean,number:boolean,variation:boolean>", kind, f)


def ko_josa_fits(noun: Column, josa: Column) -> Column:
    """Whether the particle may follow the noun's last syllable; null for an empty noun."""
    return per_text(F.array(noun, josa), "boolean", pa.bool_(), lambda x: ko_tokenize.josa_attachable(x[0][-1], x[1]) if x[0] and x[1] else None)

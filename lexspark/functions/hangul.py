"""Hangul syllables as arithmetic on code points, for Python and for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of a syllable in the order of Unicode; no final consonant is a space.
ONSETS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
CODAS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: Final consonants of two letters.
DOUBLE_CODAS = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}
FIRST, LAST = 0xAC00, 0xD7A3


def is_syllable(c: str) -> bool:
    return FIRST <= ord(c) <= LAST


def decompose(c: str) -> tuple[str, str, str]:
    """(onset, vowel, coda); what is not a syllable is an onset alone."""
    if not is_syllable(c):
        return c, " ", " "
    u = ord(c) - FIRST
    return ONSETS[u // 588], VOWELS[u % 588 // 28], CODAS[u % 28]


def compose(onset: str, vowel: str, coda: str = " ") -> str:
    return chr(FIRST + ONSETS.index(onset) * 588 + VOWELS.index(vowel) * 28 + CODAS.index(coda))


def has_coda(c: str) -> bool:
    return is_syllable(c) and (ord(c) - FIRST) % 28 > 0


def decompose_column(text: Column) -> Column:
    """array of struct(onset, vowel, coda), one per character."""

    def one(c: Column) -> Column:
        u = F.ascii(c) - FIRST
        inside = (F.ascii(c) >= FIRST) & (F.ascii(c) <= LAST)
        pick = lambda table, at: F.substr(F.lit(table), (at + 1).cast("int"), F.lit(1))
        letter = lambda table, at, other: F.when(inside, pick(table, at)).otherwise(other)
        return F.struct(
            letter(ONSETS, F.floor(u / 588), c).alias("onset"), letter(VOWELS, F.floor(F.pmod(u, F.lit(588)) / 28), F.lit(" ")).alias("vowel"),
            letter(CODAS, F.pmod(u, F.lit(28)), F.lit(" ")).alias("coda"),
        )

    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one)


def compose_column(parts: Column) -> Column:
    """Text of an array of struct(onset, vowel, coda)."""

    return F.array_join(F.transform(parts, lambda p: F.when(p["vowel"] == " ", p["onset"]).otherwise(_syllable(p))), "")


def _syllable(p: Column) -> Column:
    at = lambda table, x: F.position(x, F.lit(table)) - 1
    code = F.lit(FIRST) + at(ONSETS, p["onset"]) * 588 + at(VOWELS, p["vowel"]) * 28 + at(CODAS, p["coda"])
    # three bytes of UTF-8, as no built-in makes a character of a code point beyond 255
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    first = F.lit(0xE0) + F.shiftright(code, 12)
    second = F.lit(0x80) + F.shiftright(code, 6).bitwiseAND(63)
    third = F.lit(0x80) + code.bitwiseAND(63)
    return F.decode(F.unhex(F.concat(byte(first), byte(second), byte(third))), "UTF-8")


def has_coda_column(char: Column) -> Column:
    return (F.ascii(char) >= FIRST) & (F.ascii(char) <= LAST) & (F.pmod(F.ascii(char) - FIRST, F.lit(28)) > 0)

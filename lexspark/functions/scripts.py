"""Scripts of characters as native columns over ranges of code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inclusive ranges of code points by script. Japanese leaves out Han, Chinese is Han of the BMP.
RANGES: dict[str, list[tuple[int, int]]] = {
    "ascii": [(0x0000, 0x007F)],
    "latin": [(0x0000, 0x02FF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "thai": [(0x0E01, 0x0E3A), (0x0E40, 0x0E5B)],
    "korean": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)],
    "japanese": [(0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "chinese": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
#: Language of a locale -> the script that stays beside ASCII.
LOCALES = {"ko": "korean", "ja": "japanese", "en": "ascii", "zh": "chinese", "th": "thai"}


def char_class(*scripts: str, java: bool = True) -> str:
    """Inside of a character class for the scripts."""
    code = (lambda x: f"\\x{{{x:04X}}}") if java else chr
    return "".join(f"{code(a)}-{code(b)}" for s in scripts for a, b in RANGES[s])


def count_script(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{char_class(script)}]"))


def all_script(text: Column, script: str) -> Column:
    """Whether the text is not empty and of the script alone."""
    return text.rlike(f"^[{char_class(script)}]+\\z")


def filter_locale(text: Column, locale: str) -> Column:
    """Only ASCII and the locale's script stay; of an unknown locale ASCII alone."""
    own = LOCALES.get(locale)
    return F.regexp_replace(text, f"[^{char_class('ascii', *([own] if own else []))}]", "")


def contains_any_locale(text: Column, locale: str) -> Column:
    return F.length(filter_locale(text, locale)) > 0


def contains_all_locale(text: Column, locale: str) -> Column:
    return F.length(filter_locale(text, locale)) == F.length(text)


def in_script(c: str, script: str) -> bool:
    return any(a <= ord(c) <= b for a, b in RANGES[script])


def script_hint(c: str) -> str:
    """KOREAN, JAPANESE, CHINESE or MODEL, where only a model can tell."""
    return next((s.upper() for s in ("korean", "japanese", "chinese") if in_script(c, s)), "MODEL")

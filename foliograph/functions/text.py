"""Script slots and languages of text runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode scripts and their four-letter codes in theme fonts.
EAST_ASIAN = ("Han", "Hiragana", "Katakana", "Hangul", "Bopomofo")
COMPLEX = {
    "Arabic": "Arab",
    "Hebrew": "Hebr",
    "Syriac": "Syrc",
    "Thaana": "Thaa",
    "Devanagari": "Deva",
    "Bengali": "Beng",
    "Gurmukhi": "Guru",
    "Gujarati": "Gujr",
    "Oriya": "Orya",
    "Tamil": "Taml",
    "Telugu": "Telu",
    "Kannada": "Knda",
    "Malayalam": "Mlym",
    "Sinhala": "Sinh",
    "Thai": "Thai",
    "Lao": "Laoo",
    "Tibetan": "Tibt",
    "Myanmar": "Mymr",
    "Khmer": "Khmr",
}
#: Language prefixes of the east-asian theme scripts.
LANGUAGES = {
    "Hans": ("zh-hans", "zh-cn", "zh-sg"),
    "Hant": ("zh-hant", "zh-tw", "zh-hk", "zh-mo"),
    "Jpan": ("ja",),
    "Hang": ("ko",),
}


def _has(text: Column, *scripts: str) -> Column:
    return F.rlike(text, F.lit("[" + "".join(rf"\p{{Is{s}}}" for s in scripts) + "]"))


def script_slots(text: Column) -> Column:
    """The slots (latin, eastAsian, complexScript) that a text uses, in this order; [latin] for a text of none."""
    east, complex_ = _has(text, *EAST_ASIAN), _has(text, *COMPLEX)
    special = "".join(rf"\p{{Is{s}}}" for s in (*EAST_ASIAN, *COMPLEX))
    letter = F.rlike(text, F.lit(rf"[\p{{L}}&&[^{special}]]"))
    number = F.rlike(text, F.lit(rf"[\p{{N}}&&[^{special}]]"))
    latin = letter | (number & ~east & ~complex_) | ~(east | complex_)
    return F.array_compact(F.array(F.when(latin, "latin"), F.when(east, "eastAsian"), F.when(complex_, "complexScript")))


def language_script(language: Column) -> Column:
    """The east-asian theme script of a language tag; else null."""
    low, out = F.lower(language), None
    for script, prefixes in LANGUAGES.items():
        fits = F.lit(False)
        for p in prefixes:
            fits = fits | (low == p) | low.startswith(p + "-")
        out = F.when(fits, script) if out is None else out.when(fits, script)
    return out


def theme_scripts(text: Column, slot: Column, language: Column) -> Column:
    """The theme scripts whose supplemental fonts a run's slot needs; Han of unknown language needs both Chinese ones."""
    kana, hangul, bopomofo = _has(text, "Hiragana", "Katakana"), _has(text, "Hangul"), _has(text, "Bopomofo")
    named = F.array_compact(F.array(F.when(kana, "Jpan"), F.when(hangul, "Hang"), F.when(bopomofo, "Hant")))
    known = language_script(language)
    han = F.when(known.isNull(), F.array(F.lit("Hans"), F.lit("Hant"))).otherwise(F.array(known))
    none = F.slice(F.array(F.lit("")), 1, 0)
    east = F.when(_has(text, "Han") & (F.size(named) == 0), han).otherwise(named)
    complex_ = F.array_compact(F.array(*[F.when(_has(text, s), code) for s, code in COMPLEX.items()]))
    return F.when(slot == "eastAsian", east).when(slot == "complexScript", complex_).otherwise(none)

"""Latin rendering of names in Indian scripts, without the inherent vowel.

Nine Unicode blocks of 128 places share one layout, so one table by place serves them all.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST, LAST, BLOCK = 0x0900, 0x0D7F, 0x80

# Place in a block -> Latin.  Consonants, vowels, vowel signs, visarga; other places vanish.
LATIN = {
    0x03: "h",
    0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "ri", 0x0C: "li",
    0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j",
    0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t",
    0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b",
    0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "zh",
    0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "ri", 0x44: "rii",
    0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au",
    0x4E: "t", 0x57: "au",
    0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "d", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
    0x7A: "n", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "l", 0x7F: "k",
}
#: Candrabindu and anusvara: n before another sign of these scripts, else nothing.
NASALS = (0x01, 0x02)
#: Digits 0 to 9 stand at these places.
DIGITS = range(0x66, 0x70)

_INDIC = {chr(c): LATIN.get((c - FIRST) % BLOCK, str((c - FIRST) % BLOCK - DIGITS.start) if (c - FIRST) % BLOCK in DIGITS else "") for c in range(FIRST, LAST + 1)}
_TABLE = str.maketrans(_INDIC | {"‌": "", "‍": ""})
_NASAL = {chr(c) for c in range(FIRST, LAST + 1) if (c - FIRST) % BLOCK in NASALS}


def latin(text: str) -> str:
    """Text with Indian-script characters written in Latin; zero-width joiners go."""
    if text.isascii():
        return text
    text = text.replace("‌", "").replace("‍", "")
    if any(c in _NASAL for c in text):
        text = "".join(("n" if after in _INDIC else "") if c in _NASAL else c for c, after in zip(text, text[1:] + " ", strict=True))
    return text.translate(_TABLE)


def folded(text: str) -> str:
    """Lower-case text composed, in Latin, then without accents."""
    if not text.isascii():
        text = latin(unicodedata.normalize("NFC", text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text


@F.pandas_udf(T.StringType())
def transliterate(texts: pd.Series) -> pd.Series:
    return texts.map(latin, na_action="ignore")


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(folded, na_action="ignore")


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)

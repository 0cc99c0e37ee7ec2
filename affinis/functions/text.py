"""Tokens, skeletons and small extractions, all in built-in functions.

Spark has no Unicode normalisation, so folding (accents, Indian scripts) is the one step done by an Arrow UDF, and
only texts that are not ASCII go through it: see fold_columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.translit import fold, is_ascii

#: Between a decimal digit and a letter, either way.
BOUNDARY = "(?<=\\p{Nd})(?=[\\p{L}\\p{Nl}\\p{No}])|(?<=[\\p{L}\\p{Nl}\\p{No}])(?=\\p{Nd})"
NUMBER = "^\\p{Nd}+$"
#: Stands for a comma while a text is folded, since folding can make commas of other characters.
COMPONENT = "\x1f"
# Tokens that stand for a missing value, and spellings of an empty address.
MISSING = ("null", "nan", "none")
EMPTY = ("", "<NULL>", "null")
# Rewrites of a word on the way to its skeleton, in this order; then letters that are merged or go.
REWRITES = (("tion", "shn"), ("ck", "k"), ("x", "ks"), ("qu", "kv"), ("ph", "f"), ("c(?=[eiy])", "s"), ("g(?=[eiy])", "j"))
MERGED = ("cqgbfdwz" + "haeiouy", "kkkpptvs")


def fold_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each new name the folded lower case of a text column; the rows are read once, and Python is given nulls for ASCII ones."""
    lower = {new: F.lower(F.coalesce(F.col(old), F.lit(""))) for new, old in columns.items()}
    return df.withColumns({new: F.coalesce(fold(F.when(~is_ascii(c), c)), c) for new, c in lower.items()})


def clean_tokens(folded: Column) -> Column:
    """Tokens of a folded text: letters and digits apart, no placeholders, numbers without leading zeros."""
    parts = F.split(F.regexp_replace(folded, BOUNDARY, " "), "[^\\p{L}\\p{N}]+")
    real = F.filter(parts, lambda t: (t != "") & ~t.isin(*MISSING))
    return F.transform(real, lambda t: F.when(t.rlike(NUMBER), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t))


def skeleton_word(word: Column) -> Column:
    """Consonant skeleton of a lower-case Latin word."""
    for pattern, to in REWRITES:
        word = F.regexp_replace(word, pattern, to)
    return F.regexp_replace(F.translate(word, *MERGED), "(.)\\1+", "$1")


def name_skeleton(tokens: Column) -> Column:
    words = F.filter(tokens, lambda t: ~t.rlike(NUMBER))
    return F.filter(F.transform(words, skeleton_word), lambda s: s != "")


def norm_name(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def has_indic(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\x{0900}-\\x{0D7F}]"), F.lit(False))


def numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(NUMBER))


def address_numbers(tokens: Column, most: int = 8) -> Column:
    """The first all-digit tokens."""
    return F.slice(numbers(tokens), 1, most)


def postal_code(text: Column) -> Column:
    """The last run of three digits, maybe a space, and two or three digits; without the space."""
    found = F.regexp_extract_all(text, F.lit("(\\b\\d{3}\\s?\\d{2,3}\\b)"), 1)
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), "\\s", "")


def parse_ids(text: Column) -> Column:
    """Comma-separated ids, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "_")


def empty_address(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).isin(*EMPTY)

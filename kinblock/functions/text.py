"""Text normalisation as column functions.

All functions take and return string columns; null counts as empty.  Three
normal forms are kept apart: ``basic`` (letters, marks and digits stay),
``word`` (letters, digits and underscore stay, marks go, no NFC) and
``word_series`` (as ``word``, with NFC after lower-casing).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as str.isspace has it.
BLANK = "\\s\\x1c-\\x1f\\x85\\p{Z}"
#: Trailing legal forms of a company name (fixed values).
LEGAL_SUFFIXES = [
    "l l c", "private limited", "pvt limited", "pvt ltd", "private ltd", "limited", "ltd",
    "corporation", "corp", "incorporated", "inc", "llc", "pllc", "co", "company",
]
#: Trailing parts of web names (fixed values).
WEB_SUFFIXES = ["com", "net", "org", "co", "in", "biz", "info", "us"]


def _trailing(words: list[str]) -> str:
    return f"(?:(?:^| )(?:{'|'.join(words)}))+$"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Canonical composition.  Text below U+0300 is composed already; the Arrow function gets null for it."""
    return F.coalesce(_nfc(F.when(c.rlike("[^\\x{0}-\\x{2FF}]"), c)), c)


def strip(c: Column) -> Column:
    """Null becomes empty; white space at both ends goes."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^[{BLANK}]+|[{BLANK}]+$", "")


def country(c: Column) -> Column:
    return strip(F.lower(strip(c)))


def _spaced(c: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), f"[^{keep}]+", " "))


def basic(c: Column) -> Column:
    """NFC, lower case, ``&`` as and, anything but letters, marks and digits as one space."""
    return _spaced(F.lower(nfc(strip(c))), "\\p{L}\\p{M}\\p{N}")


def compact(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "), F.lit(""))


def strip_suffix(normal: Column) -> Column:
    """``basic`` text without trailing legal forms, however many; may become empty."""
    return F.regexp_replace(normal, _trailing(LEGAL_SUFFIXES), "")


def strip_suffix_ws(normal: Column) -> Column:
    """The form that needs white space before a suffix and does not know ``l l c``."""
    words = [w for w in LEGAL_SUFFIXES if w != "l l c"]
    return F.trim(F.regexp_replace(normal, f"(?:\\s+(?:{'|'.join(words)}))+$", ""))


def transliterate(c: Column, to_ascii: Callable[[Column], Column] | None = None) -> Column:
    """``to_ascii`` (the caller's), lower-cased and reduced to [a-z0-9]; without one, ``basic``."""
    if to_ascii is None:
        return basic(c)
    return F.trim(F.regexp_replace(F.lower(to_ascii(strip(c))), "[^a-z0-9]+", " "))


def _folds() -> tuple[str, str]:
    """Characters whose canonical decomposition is an ASCII letter and marks, and those letters."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0x3000)]
    found = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def ascii_fold(c: Column) -> Column:
    """A transliterator for Latin script, by rule and without Python: accented letters become plain ones, marks go."""
    return F.regexp_replace(F.translate(c, *_folds()), "\\p{Mn}", "")


def numbers(c: Column) -> Column:
    """All runs of decimal digits, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("\\p{Nd}+"), F.lit(0))


def word(c: Column) -> Column:
    return _spaced(F.lower(strip(c)), "\\p{L}\\p{N}_")


def word_series(c: Column) -> Column:
    return _spaced(nfc(F.lower(F.coalesce(c.cast("string"), F.lit("")))), "\\p{L}\\p{N}_")


def domain_name(no_suffix: Column) -> Column:
    """Suffix-free ``basic`` text without trailing web parts and spaces; legal forms are not tried again."""
    return compact(F.regexp_replace(no_suffix, _trailing(WEB_SUFFIXES), ""))


def name_features(c: Column) -> Column:
    b = basic(c)
    return F.struct(
        strip(c).alias("raw"), b.alias("basic"), compact(b).alias("compact"), strip_suffix(b).alias("no_suffix"), transliterate(c).alias("transliterated")
    )


def address_features(c: Column) -> Column:
    b = basic(c)
    return F.struct(
        strip(c).alias("raw"), b.alias("basic"), compact(b).alias("compact"), F.concat_ws(" ", numbers(c)).alias("numbers"), numbers(c).alias("address_number_tokens")
    )

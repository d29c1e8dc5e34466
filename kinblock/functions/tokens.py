"""Token, n-gram and key-part functions over normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a name (fixed values).
GENERIC_NAME = [
    "the", "and", "company", "corporation", "corporate", "limited", "private", "pvt", "ltd", "llc", "inc",
    "incorporated", "co", "group", "services", "service", "solutions", "solution", "enterprises", "enterprise",
    "business", "businesses", "international", "india", "america", "american", "usa", "united", "global",
    "official", "shop", "store",
]
#: Forms of address, left out as well by the later pipelines (fixed values).
TITLES = ["mr", "mrs", "ms", "dr", "sri", "shri", "smt"]
#: Words that say nothing about an address (fixed values).
GENERIC_ADDRESS = [
    "road", "street", "st", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "highway", "hwy", "circle",
    "place", "building", "block", "floor", "near", "opposite", "opp", "main",
]
#: The first pipeline's further address words (fixed values).
MORE_ADDRESS = ["pl", "india", "usa", "america"]
NAME_LENGTH, ADDRESS_LENGTH, NGRAM_TOKEN_LENGTH = 3, 4, 5
PAIR = "array<struct<a:string,b:string>>"


def tokens(normal: Column, least: int, generic: list[str]) -> Column:
    """Words of at least ``least`` characters that are not ``generic``, in order, repeats kept."""
    return F.filter(F.split(normal, " "), lambda t: (F.length(t) >= least) & ~t.isin(generic))


def name_tokens(normal: Column, titles: bool = True) -> Column:
    return tokens(normal, NAME_LENGTH, GENERIC_NAME + (TITLES if titles else []))


def address_tokens(normal: Column, more: bool = False) -> Column:
    return tokens(normal, ADDRESS_LENGTH, GENERIC_ADDRESS + (MORE_ADDRESS if more else []))


def as_set(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def first_or_empty(arr: Column) -> Column:
    return F.coalesce(F.get(arr, F.lit(0)), F.lit(""))


def first_number(nums: Column) -> Column:
    """The first number of at most five digits, else the first, else empty."""
    return F.coalesce(F.get(F.filter(nums, lambda x: F.length(x) <= 5), F.lit(0)), first_or_empty(nums))


def postal_codes(nums: Column) -> Column:
    return F.filter(nums, lambda x: F.length(x).isin(5, 6))


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def pairs(arr: Column) -> Column:
    """2-combinations (a before b) of a sorted set."""
    many = F.flatten(
        F.transform(arr, lambda a, i: F.transform(F.slice(arr, i + 2, F.size(arr)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return F.when(F.size(arr) >= 2, many).otherwise(F.array().cast(PAIR))


def cross(left: Column, right: Column) -> Column:
    """Every item of ``left`` with every one of ``right``, which is held as an element: where it stands inside the
    function, the optimizer puts its definition there, and it is computed again for every item of ``left``."""
    held = F.transform(F.array(right), lambda r: F.transform(left, lambda a: F.transform(r, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.flatten(F.flatten(held))


def pair_key(ctry: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("|", ctry, F.least(a, b), F.greatest(a, b))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The set of n-grams; none if the text is shorter.  The text is split once: a substring reads it
    from its begin, so that grams by substring take time with the square of its length."""
    at = lambda chars: lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
    each = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - n), at(chars))
    grams = F.array_distinct(F.flatten(F.transform(F.array(F.split(c, "")), each)))
    return F.when(F.length(c) >= n, grams).otherwise(F.array().cast("array<string>"))


def token_ngrams(toks: Column, n: int = 3) -> Column:
    """n-grams of the tokens of five or more characters: a set per token, repeats across tokens."""
    return F.flatten(F.transform(F.filter(toks, lambda t: F.length(t) >= NGRAM_TOKEN_LENGTH), lambda t: char_ngrams(t, n)))

"""Signatures of records and key families over them, as one projection and one explode.

A key is (family, country, k1, k2); k2 is empty for one-part families.  An
empty value gives no key; an empty country is a country.  Repeats of a key in
a record are counted in its array, so no later step expands or removes them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K

KEY = ["family", "country", "k1", "k2"]
_KEYS = "array<struct<family:string,k1:string,k2:string,m:int>>"


@dataclass(frozen=True)
class Style:
    """How a pipeline normalises: ``normal`` is basic, word or word_series."""

    normal: str = "basic"
    sets: bool = True  # tokens once per record
    titles: bool = True
    more_address: bool = False
    to_ascii: Callable[[Column], Column] | None = None


FIRST = Style(sets=False, titles=False, more_address=True)
LISTS = Style(sets=False)
SETS = Style()
WORDS = Style(normal="word")
SERIES = Style(normal="word_series", sets=False)


def signature(records: DataFrame, style: Style = SETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, country and everything that keys are made of; ids are stripped once, here."""
    normal = getattr(T, style.normal)
    ctry = T.word(F.col("country")) if style.normal == "word" else T.country(F.col("country"))
    one = records.select(
        T.strip(F.col("entity_id")).alias("entity_id"),
        ctry.alias("country"),
        *carry,
        normal(F.col("business_name")).alias("name"),
        normal(F.col("business_address")).alias("address"),
        T.numbers(F.col("business_address")).alias("nums"),
        (T.transliterate(F.col("business_name"), style.to_ascii).alias("ascii_name") if style.to_ascii else F.lit(None).cast("string").alias("ascii_name")),
    )
    no_suffix = T.strip_suffix_ws(F.col("name")) if style.normal == "word_series" else T.strip_suffix(F.col("name"))
    two = one.select(
        "entity_id", "country", *carry, "name", "address", "nums",
        no_suffix.alias("no_suffix"),
        F.coalesce("ascii_name", "name").alias("translit"),
    )
    some = K.as_set if style.sets else (lambda c: c)
    return two.select(
        "entity_id", "country", *carry, "name", "no_suffix", "translit", "nums",
        T.compact(F.col("name")).alias("compact"),
        (T.transliterate(F.col("no_suffix"), style.to_ascii) if style.to_ascii else F.col("no_suffix")).alias("translit_no_suffix"),
        T.domain_name(F.col("no_suffix")).alias("domain"),
        some(K.name_tokens(F.col("name"), style.titles)).alias("name_tokens"),
        some(K.name_tokens(F.col("translit"), style.titles)).alias("translit_tokens"),
        some(K.address_tokens(F.col("address"), style.more_address)).alias("address_tokens"),
        K.first_number(F.col("nums")).alias("number"),
        K.postal_codes(F.col("nums")).alias("postals"),
    )


def _one(name: str) -> Callable[[], Column]:
    return lambda: F.array(F.struct(F.col(name).alias("a"), F.lit("").alias("b")))


def _each(make: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.transform(make(), lambda x: F.struct(x.alias("a"), F.lit("").alias("b")))


def _number() -> Column:
    return F.filter(F.array("number"), lambda x: x != "")


#: Family -> array<struct<a, b>> over a signature.
FAMILIES: dict[str, Callable[[], Column]] = {
    "exact_name": _one("name"),
    "name_no_suffix": _one("no_suffix"),
    "translit_name": _one("translit"),
    "translit_no_suffix": _one("translit_no_suffix"),
    "domain_name": _one("domain"),
    "number": _one("number"),
    "prefix5": lambda: F.array(F.struct(K.prefix(F.col("compact"), 5).alias("a"), F.lit("").alias("b"))),
    "prefix8": lambda: F.array(F.struct(K.prefix(F.col("compact"), 8).alias("a"), F.lit("").alias("b"))),
    "translit_prefix6": lambda: F.array(F.struct(K.prefix(K.ascii_only(F.col("translit")), 6).alias("a"), F.lit("").alias("b"))),
    "first_token": lambda: F.array(F.struct(K.first_or_empty(F.col("name_tokens")).alias("a"), F.lit("").alias("b"))),
    "name_token": _each(lambda: F.col("name_tokens")),
    "translit_token": _each(lambda: F.col("translit_tokens")),
    "address_token": _each(lambda: F.col("address_tokens")),
    "postal": _each(lambda: F.col("postals")),
    "address_ngram": _each(lambda: K.token_ngrams(F.col("address_tokens"))),
    "name_ngram": _each(lambda: K.char_ngrams(F.col("compact"))),
    "translit_ngram": _each(lambda: K.char_ngrams(K.ascii_only(F.col("translit")))),
    "name_pair": lambda: K.pairs(F.col("name_tokens")),
    "address_pair": lambda: K.pairs(F.col("address_tokens")),
    "address_token_pair": lambda: K.pairs(K.as_set(F.col("address_tokens"))),
    "name_address": lambda: K.cross(F.col("name_tokens"), F.col("address_tokens")),
    "name_number": lambda: K.cross(F.col("name_tokens"), _number()),
    "name_postal": lambda: K.cross(F.col("name_tokens"), F.col("postals")),
    "number_address": lambda: K.cross(_number(), F.col("address_tokens")),
}


#: Families of at most one key a record.
SINGLE = {"exact_name", "name_no_suffix", "translit_name", "translit_no_suffix", "domain_name", "number", "prefix5", "prefix8", "translit_prefix6", "first_token"}


def keys(sig: DataFrame, families: list[str], distinct: bool = False, carry: tuple[str, ...] = (), before: bool = False) -> DataFrame:
    """Long-form keys of a signature: one row per record, family and key, with ``m``, how often
    the record repeats the key there (1 if ``distinct``).  With ``before`` also the record's keys that
    come before this one, by the order of ``families`` and then by value, so in one order for all records."""
    own = ["entity_id", "country", *carry]
    every, once = [f"__{k}" for k in range(len(families))], [f"__once{k}" for k in range(len(families))]
    unique_ = lambda c: F.array_sort(F.array_distinct(c)) if before else F.array_distinct(c)
    given = sig.select(*own, *[F.filter(FAMILIES[f](), lambda x: x["a"] != "").alias(c) for f, c in zip(families, every)])
    arrays = given.select(*own, *every, *[(F.col(c) if f in SINGLE else unique_(c)).alias(o) for f, c, o in zip(families, every, once)])

    def labelled(family: str, arr: str, unique: str) -> Column:
        if distinct or family in SINGLE:
            times = lambda x: F.lit(1)
        else:
            times = lambda x: F.when(F.size(unique) == F.size(arr), 1).otherwise(F.size(arr) - F.size(F.array_remove(arr, x)))
        return F.transform(unique, lambda x: F.struct(F.lit(family).alias("family"), x["a"].alias("k1"), x["b"].alias("k2"), times(x).alias("m")))

    parts = [labelled(*p) for p in zip(families, every, once)]
    all_ = F.flatten(F.array(*parts)).cast(_KEYS)
    if before:
        tag = lambda x: F.concat_ws("\u0000", x["family"], x["k1"], x["k2"])
        told = arrays.select(*own, all_.alias("all")).select("*", F.transform("all", tag).alias("tags"))
        rows = told.select(*own, "tags", F.posexplode("all").alias("at", "k"))
        return rows.select("entity_id", *carry, "k.family", "country", "k.k1", "k.k2", "k.m", F.slice("tags", F.lit(1), F.col("at")).alias("before"))
    rows = arrays.select(*own, F.explode(all_).alias("k"))
    return rows.select("entity_id", *carry, "k.family", "country", "k.k1", "k.k2", "k.m")

"""Licence scans by a positional rare-token index, in DataFrame functions only.

Every template is a licence text, notice or opening sentence with its label
and the key phrases that must be present.  The index lists, for each rare word
of a template, its places there.  One pass over the corpus counts in how many
documents each licence word occurs (at most as many numbers as there are
licence words) and the bytes of text; the second pass looks up, per file that may hold a key phrase,
all its indexed words, meets the template postings at the same relative
position, and sums the weights along each alignment.  Of the alignments that
reach THRESHOLD of the template's weight and hold all its key phrases in their
places the best counts; with one the template is accepted.

The base phrases are always labelled, wherever their words stand in a row:
each is found through its rarest word and verified word by word.

Words: runs of ASCII digits and letters and all characters from U+0080, of
the text with A-Z lower-cased.

Defined results: a null or empty text has no words, no labels, null first and
last word and score 0; very long texts are scanned whole; ties of frequency go
to the word that sorts first; repeated rows, and rows with a null id, are scanned
one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier
from .licence_texts import TEXTS

WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
THRESHOLD = 0.6
#: Rare words of a template that are indexed.
PER_TEMPLATE = 8
#: Bytes of text that a task of the scan reads at least, if the input comes in smaller parts.
TASK_BYTES = 4 << 20


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases of the contract and their labels (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

def plain(text: str) -> str:
    """The words of ``text``, joined by spaces."""
    return " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower()))


#: The base phrases, opening or grant sentences of public licences, and whole texts and notices.
TEMPLATES = [
    *[Template(label, phrase, (phrase,)) for phrase, label in BASE.items()],
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("you may not use this file except in compliance with the license", "apache license")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    *[Template(label, plain(text), keys) for label, text, keys in TEXTS],
]


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for x in (t.text, *t.keys) for w in x.split()})


def frequencies(docs: DataFrame, templates: list[Template]) -> tuple[int, dict[str, int], int]:
    """Documents of ``docs``, those that hold each licence word, and the bytes of all texts."""
    vocab = F.array(*[F.lit(w) for w in vocabulary(templates)])
    held = docs.select(F.array_intersect(vocab, words_of(F.col("text"))).alias("w"), F.octet_length("text").cast("long").alias("n"))
    every = held.select(F.explode(F.array_append("w", F.lit(""))).alias("w"), "n")
    one = every.groupBy("w").agg(F.count("*"), F.sum("n")).collect()  # one row a licence word
    found = {r[0]: r[1] for r in one}
    return found.pop("", 0), found, next((r[2] for r in one if r[0] == ""), None) or 0


class Index:
    """Postings of rare template words, phrases by their rarest word, and weights."""

    def __init__(self, templates: list[Template], n_docs: int, df: dict[str, int]):
        self.templates = templates
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 0.01 for w in vocabulary(templates)}
        self.by_idf = sorted(self.idf, key=lambda w: (-self.idf[w], w))
        self.postings: dict[str, list[tuple[int, int, float]]] = {}
        self.total: list[float] = []
        for t, template in enumerate(templates):
            words = template.text.split()
            rare = [w for w in self.by_idf if w in words][:PER_TEMPLATE]
            places = [(w, k) for k, w in enumerate(words) if w in rare]
            for w, k in places:
                self.postings.setdefault(w, []).append((t, k, self.idf[w]))
            self.total.append(sum(self.idf[w] for w, _ in places))
        self.phrases: list[tuple[str, ...]] = sorted({tuple(k.split()) for t in templates for k in t.keys})
        self.anchor = [next(w for w in self.by_idf if w in p) for p in self.phrases]

    def keys_of(self, t: int) -> list[tuple[int, int]]:
        """(phrase, its place in the template) of the key phrases."""
        words = self.templates[t].text.split()
        out = []
        for key in self.templates[t].keys:
            p = tuple(key.split())
            place = next(k for k in range(len(words)) if tuple(words[k : k + len(p)]) == p)
            out.append((self.phrases.index(p), place))
        return out


def _occurrences(index: Index) -> Column:
    """array<struct<p, at>>: places of every phrase, from the places ``__a`` of the anchors."""

    def at(i: Column) -> Column:
        found = []
        for p, (phrase, anchor) in enumerate(zip(index.phrases, index.anchor)):
            rel = phrase.index(anchor)
            hit = F.get("__w", i) == anchor
            for k, w in enumerate(phrase):
                if k != rel:
                    hit = hit & F.coalesce(F.get("__w", i + (k - rel)) == w, F.lit(False))
            found.append(F.when(hit, F.struct(F.lit(p).alias("p"), (i - rel).alias("at"))))
        return F.array_compact(F.array(*found))

    return F.flatten(F.transform("__a", at))


def _alignments(index: Index) -> Column:
    """Sorted array<struct<t, d, w>>: a rare word's weight on each alignment d of template t."""
    entries = []
    for w, posts in index.postings.items():
        rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), F.lit(x).alias("w")) for t, k, x in posts])
        entries += [F.lit(w), rows]
    table = F.create_map(*entries)
    met = F.transform(
        "__a",
        lambda i: F.transform(
            F.coalesce(F.try_element_at(table, F.get("__w", i)), F.array().cast("array<struct<t:int,k:int,w:double>>")),
            lambda q: F.struct(q["t"].alias("t"), (i - q["k"]).alias("d"), q["w"].alias("w")),
        ),
    )
    return F.sort_array(F.flatten(met))


def _accepted(index: Index, t: int) -> Column:
    """The largest share of template ``t``'s weight on an alignment that is accepted, or 0."""
    state = lambda d, s, best: F.struct(d.alias("d"), s.alias("s"), best.alias("best"))
    zero = F.lit(0.0)

    def step(acc: Column, x: Column) -> Column:
        total = F.when(x["d"] == acc["d"], acc["s"] + x["w"]).otherwise(x["w"])
        ok = total > F.greatest(acc["best"], F.lit(THRESHOLD * index.total[t] * (1 - 1e-9)))
        for p, place in index.keys_of(t):
            ok = ok & F.array_contains(F.col("__o"), F.struct(F.lit(p).alias("p"), (x["d"] + place).alias("at")))
        return state(x["d"], total, F.when(ok, total).otherwise(acc["best"]))

    best = F.aggregate(F.filter("__m", lambda x: x["t"] == t), state(F.lit(-(2**31)), zero, zero), step)
    return F.least(best["best"] / F.lit(index.total[t]), F.lit(1.0))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, occurrences of the base phrases, labels and score."""
    docs = docs.select("doc_id", "text")
    n_docs, df, size = frequencies(docs, templates)
    index = Index(templates, n_docs, df)
    anchors = sorted(set(index.anchor))
    indexed = [w for w in index.by_idf if w in index.postings]
    base = {index.phrases.index(tuple(p.split())): label for p, label in BASE.items()}
    # small parts of the input are read together: each task writes a file of its own, and starts helper processes for it
    whole = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    words = whole.select("doc_id", words_of(F.col("text")).alias("__w"))
    hinted = F.exists("__w", lambda w: w.isin(anchors))
    looked = words.select("doc_id", "__w", F.size("__w").cast("long").alias("n_words"), hinted.alias("__k"))
    placed = looked.select(
        "doc_id",
        "n_words",
        "__w",
        F.when(
            F.col("__k"),
            F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: F.get("__w", i).isin(sorted({*indexed, *anchors}))),
        )
        .otherwise(F.array().cast("array<int>"))
        .alias("__a"),
    )
    found = placed.select("doc_id", "n_words", "__w", "__a", _occurrences(index).alias("__o"))
    some = F.size("__o") > 0  # without any key phrase no template can be accepted
    aligned = found.select(
        "doc_id", "n_words", "__o", F.when(some, _alignments(index)).otherwise(F.array().cast("array<struct<t:int,d:int,w:double>>")).alias("__m")
    )
    shares = F.array(*[_accepted(index, t) for t in range(len(templates))])
    scored = aligned.select(
        "doc_id",
        "n_words",
        F.filter("__o", lambda x: x["p"].isin(*base)).alias("__b"),
        F.when(F.size("__m") > 0, shares).otherwise(F.array().cast("array<double>")).alias("__s"),
    )
    names = F.array(*[F.lit(t.label) for t in templates])
    base_name = F.create_map(*[x for p, label in base.items() for x in (F.lit(p), F.lit(label))])
    labelled = scored.select(
        "doc_id",
        "n_words",
        "__b",
        "__s",
        F.array_sort(F.array_distinct(F.transform("__b", lambda x: F.try_element_at(base_name, x["p"])))).alias("__bl"),
    )
    by_method = F.filter(F.transform("__s", lambda s, t: F.when(s > 0, F.get(names, t))), lambda x: x.isNotNull())
    places = F.transform("__b", lambda x: x["at"])
    out = labelled.select(
        "doc_id",
        "n_words",
        F.size("__b").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join("__bl", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__bl", by_method)), ",").alias("labels"),
        F.when(F.size("__bl") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("__s"), F.lit(0.0))).alias("score"),
    )
    return barrier(out)


def op1(docs: DataFrame) -> DataFrame:
    return scan(docs)

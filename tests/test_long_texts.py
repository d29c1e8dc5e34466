"""Keys of long texts take time in proportion to the text."""

import time

from pyspark.sql import functions as F

from kinblock.functions import tokens as K
from kinblock.functions.text import numbers


def test_ngrams_of_code_points(spark):
    texts = ["", "ab", "abc", "a\U00010400é中b\U00010401\U00010402", "abcabcab"]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", K.char_ngrams(F.col("c")).alias("g")).collect()
    assert {r.c: r.g for r in rows} == {t: list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) for t in texts}


def test_ngrams_read_a_long_text_once(spark):
    text = spark.range(1).select(F.repeat(F.lit("quellbach"), 60_000).alias("c")).cache()
    text.count()
    began = time.time()
    assert text.select(F.size(K.char_ngrams(F.col("c")))).first()[0] == 9
    assert time.time() - began < 15


def test_cross_keeps_the_right_side(spark):
    """The postal codes are found once a text, not once for each of its tokens."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.translate(F.md5(i.cast("string")), "0123456789", "ghijklmnop")))
    text = spark.range(1).select(words.alias("name"), F.concat(words, F.lit(" 560037 12345 560037")).alias("address")).cache()
    text.count()
    sig = text.select(K.as_set(K.name_tokens(F.col("name"))).alias("left"), numbers(F.col("address")).alias("nums")).select("left", K.postal_codes(F.col("nums")).alias("right"))
    began = time.time()
    pairs = sig.select(K.cross(F.col("left"), F.col("right")).alias("pairs")).select(F.size("pairs"), F.slice("pairs", 1, 2).alias("first")).first()
    assert pairs[0] == 60_000 and pairs.first[0].a == pairs.first[1].a
    assert time.time() - began < 15

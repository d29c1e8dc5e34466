"""Fixtures shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of other operators' making, as they might come with a table.
CLASH = "n_words long, fail_bits long, start long, part int, score double, ids string, fp long, labels string"


def words(rng, n, alphabet="abcdefghijklmnoprstuvw"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, rows, clash=False):
    """``rows``: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src1", None if r[1] is None else len(r[1])) for r in rows]
    if not clash:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*f, 1, 2, 3, 4, 0.5, "x", 7, "y") for f in full], f"{SCHEMA}, {CLASH}")


def edge_rows():
    """Null and empty texts, a null id, repeated rows, odd characters, and a long text."""
    rng = random.Random(5)
    long_text = "\n".join(words(rng, 12) for _ in range(3000))
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (3, "one two three"), (None, "no id here at all"),
        (4, "Ünïcode é漢字😀 it's we'll don't 1234 !!! \x1c\x85 x"), (5, long_text), (6, "a"), (7, "A B C a b c"),
    ]

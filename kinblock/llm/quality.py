"""Quality rules kept as a ledger of failure bits and measurements.

Every rule is evaluated once per document.  The ledger stores one bit per
failed rule beside the measurements; a policy is a versioned bit mask, so a
change of policy or an ablation reads the ledger and never the texts.

Words are runs of characters other than space and U+0009-U+000D.

Defined results: a null text counts as empty (no words, all measurements 0, so
``few_words`` fails); very long texts are measured whole; repeated rows, and rows
with a null id, are measured one by one; measures on a rule's limit pass it (every
condition is a strict one); an empty table gives an empty ledger; columns of the
input other than ``text`` pass through unless the ledger has a column of that
name, which then replaces it (``apply_policy`` keeps the input's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from .common import barrier

WORD_BREAK = "[ \\t-\\r]+"
HAS_WORD = "[^ \\t-\\r]"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5

#: Measurements of the ledger, in order.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Bit -> (rule name, failure condition over the measurements).  Bits are never reused.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines"),
    ("too_long", "n_words > 10000000"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies: the bits that reject a document.
BASE = mask("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("many_symbols", "short_words", "long_words", "duplicate_lines"),
    "strict": mask(*BIT),
}
DEFAULT_POLICY = "v1"


def _with_neighbour(arr: str, field: str) -> Column:
    """Elements of a sorted array of structs that share ``field`` with a neighbour."""
    return F.filter(
        F.col(arr),
        lambda x, i: (x[field] == F.get(F.col(arr), i - 1)[field])
        | (x[field] == F.get(F.col(arr), i + 1)[field]),
    )


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of MEASURES, all long.

    Windows of five words are compared by 64-bit hash first; only where two
    hashes meet are the window texts themselves compared.  Arrays that a
    lambda indexes are named more than once in their projection, so that
    the optimizer keeps them as columns instead of recomputing them per element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = [c for c in docs.columns if c.lower() not in {*MEASURES, "fail_bits"}]
    inner = {c: f"__c{k}" for k, c in enumerate(carried)}
    base = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in carried], text.alias("__t"))
    keep = list(inner.values())
    words = base.select(*keep, "__t", F.array_remove(F.split("__t", WORD_BREAK), "").alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(HAS_WORD))
    hashed = words.select(
        *keep,
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    windows = F.when(
        F.size("__h") >= WINDOW,
        F.slice(
            F.transform("__h", lambda h, i: F.xxhash64(h, *[F.get(F.col("__h"), i + k) for k in range(1, WINDOW)])),
            1,
            F.size("__h") - (WINDOW - 1),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    stats = ["n_words", "word_chars", "n_symbols"]
    wide = hashed.select(
        *keep,
        "__w",
        *stats,
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        windows.alias("__v"),
    )
    stats += ["n_lines", "n_dup_lines"]
    sorted_hash = F.when(
        F.size(F.array_distinct("__v")) < F.size("__v"),
        F.sort_array(F.transform("__v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    by_hash = wide.select(*keep, "__w", *stats, sorted_hash.alias("__s"))
    by_text = by_hash.select(
        *keep,
        *stats,
        F.sort_array(
            F.transform(
                _with_neighbour("__s", "h"),
                lambda x: F.struct(F.array_join(F.slice("__w", x["i"] + 1, WINDOW), " ").alias("w"), x["i"].alias("i")),
            )
        ).alias("__s"),
    )
    places = by_text.select(
        *keep, *stats, F.sort_array(F.transform(_with_neighbour("__s", "w"), lambda x: x["i"])).alias("__p")
    )
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")
        ),
        lambda acc: acc["n"].cast("long"),
    )
    return places.select(
        *[F.col(inner[c]).alias(c) for c in carried],
        *stats,
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with MEASURES and ``fail_bits`` (long): bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return barrier(measure(docs).withColumn("fail_bits", bits))


def store(docs: DataFrame, path: str) -> None:
    """Write the ledger of ``docs`` without texts, for policies and ablations to come."""
    ledger(docs).write.parquet(path)


def kept(policy: str = DEFAULT_POLICY) -> Column:
    """Whether a ledger row passes ``policy``."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy] | BASE).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The documents that pass ``policy``, with their own columns only."""
    names = {f.lower() for f in [*MEASURES, "fail_bits"]}
    clash = {c: f"__own{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
    renamed = docs.select(*[F.col(f"`{c}`").alias(clash.get(c, c)) for c in docs.columns])
    passed = ledger(renamed).where(kept(policy))
    return passed.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of ``policy``, from a ledger in one aggregate: documents that fail it, and
    documents that would come back if only this rule were dropped."""
    active = POLICIES[policy]
    inside = F.col("fail_bits").bitwiseAND(F.lit(active).cast("long"))
    cols = []
    for name, _ in RULES:
        bit = F.lit(BIT[name]).cast("long")
        cols += [F.count_if(inside.bitwiseAND(bit) != 0).alias(f"f_{name}"), F.count_if(inside == bit).alias(f"o_{name}")]
    one = rows.agg(*cols)
    parts = [
        f"'{name}', f_{name}, o_{name}" for name, _ in RULES if active & BIT[name]
    ]
    return one.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (rule, n_failed, n_only)")


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns: measurements, base_failed and the verdict of the default policy."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        kept().alias("kept"),
        "fail_bits",
    )


def quality_ablation(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Stores the ledger of ``docs``, and reads the ablation of ``policy`` from it."""
    spark = docs.sparkSession
    path = fresh_path(spark, "ledger")
    store(docs.select("doc_id", "text"), path)
    return ablation(spark.read.parquet(path), policy)


OP9_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
w AS (SELECT doc_id, txt,
             regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
v AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM v) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, range(5) AS q(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END
   + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
   + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
   + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
   + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
   + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END
   + CASE WHEN n_words > 10000000 THEN 64 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits
FROM b
"""

ABLATION_SQL = OP9_SQL[: OP9_SQL.rindex("SELECT doc_id")] + "".join(
    f"{'' if not k else 'UNION ALL '}SELECT '{name}' AS rule, count(*) FILTER (WHERE fail_bits & {BIT[name]} <> 0) AS n_failed,"
    f" count(*) FILTER (WHERE fail_bits & {POLICIES[DEFAULT_POLICY]} = {BIT[name]}) AS n_only FROM b\n"
    for k, name in enumerate(n for n, _ in RULES if POLICIES[DEFAULT_POLICY] & BIT[n])
)

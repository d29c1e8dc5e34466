"""Registered queries of the blocking engine over the driver's tables.

Two mappings give business entities, each one SQL expression that Spark and
DuckDB read alike and each over a whole table and whole column values:
``part`` for keys, blocks and candidates, whose names and addresses are short
fields as those of businesses are, and ``documents``, with the whole text as
name and in the address, for text forms, tokens and numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import tokens as K
from .operators import blocking as B
from .operators import classes as C
from .operators import evaluate as E
from .operators import profile as P
from .operators.keys import FIRST, LISTS, SETS, Style, keys, signature
from .plans import pipelines as L
from .sources import tsv
from .sources.shared import fresh_path
from .sources.tsv import load_truth, load_truth_lists

Query = Callable[[SparkSession, str], DataFrame]

_SUFFIX = """CASE {id} % 5 WHEN 0 THEN '' WHEN 1 THEN ' Pvt. Ltd.' WHEN 2 THEN ' & Co' WHEN 3 THEN '.com' ELSE ' Private Limited' END"""
ENTITY_SQL = f"""
SELECT CAST(p_partkey AS STRING) AS entity_id,
       concat(p_name, {_SUFFIX.format(id="p_partkey")}) AS business_name,
       concat(CAST(p_size AS STRING), ', ', p_name, ' ', p_brand, ' ',
              CAST(10000 + CAST(floor(p_retailprice * 10) AS INT) % 40 AS STRING)) AS business_address,
       p_type AS country,
       CAST(p_partkey % 3 AS INT) AS src
FROM {{part}}
"""
TEXT_SQL = f"""
SELECT CAST(doc_id AS STRING) AS entity_id,
       concat(coalesce(text, ''), {_SUFFIX.format(id="doc_id")}) AS business_name,
       concat(CAST(n_chars % 97 AS STRING), ', ', coalesce(text, ''), ' ', CAST(10000 + n_chars % 400 AS STRING)) AS business_address,
       lang AS country,
       CAST(doc_id % 3 AS INT) AS src
FROM {{documents}}
"""
#: Caps that some blocks of every family keep and others exceed, over ``part`` from 2,000 rows on.
SMALL_CAPS = {
    "exact_name": 1, "name_no_suffix": 1, "translit_name": 1, "domain_name": 1, "number": 2, "prefix5": 2, "prefix8": 1, "translit_prefix6": 2,
    "first_token": 14, "name_token": 14, "address_token": 4, "postal": 3, "name_pair": 2, "address_pair": 2, "name_address": 2, "name_number": 1,
    "name_postal": 1, "number_address": 1, "name_ngram": 4,
}


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source 1, the other sources and the truth, written as TSV files and read back."""
    s1, others = sides(spark, sf_dir)
    d = truth(spark, sf_dir)
    lists = d.select(F.col("s1").alias("source1_entity_id"), F.concat_ws(",", "targets").alias("matched_entity_ids"))
    out = []
    for name, rows in (("s1", s1.select(*tsv.REQUIRED)), ("s2", others.where("source = 'S2'").select(*tsv.REQUIRED)), ("s3", others.where("source = 'S3'").select(*tsv.REQUIRED)), ("truth", lists)):
        path = fresh_path(spark, f"tsv-{name}")
        tsv.write_tsv(rows, path)
        out.append(tsv.read_tsv(spark, path, tsv.TRUTH if name == "truth" else tsv.ENTITY))
    one, two, three, given = out
    both = two.withColumn("source", F.lit("S2")).unionByName(three.withColumn("source", F.lit("S3")))
    return tsv.validate_columns(one), tsv.validate_columns(both), load_truth(given)


def _written(rows: DataFrame, write, **options) -> DataFrame:
    """``rows`` through one of the sinks and back."""
    path = fresh_path(rows.sparkSession, "sink")
    write(rows, path)
    return rows.sparkSession.read.options(header=True, **options).csv(path)


def _pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, others = sides(spark, sf_dir)
    index = lambda name: L.build_index(others.where(F.col("source") == name))
    return L.generate_candidate_pairs(s1, index("S2"), index("S3"))


def _candidate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, others = sides(spark, sf_dir)
    pairs = L.composite(s1, others).select("s1", "candidate", F.lit("composite").alias("family"))
    return _written(pairs, tsv.write_candidates, sep="\t")


def _match_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.truth_pairs(truth(spark, sf_dir))
    rows = d.select(F.col("s1").alias("item_id_1"), F.col("target").alias("item_id_2"), F.lit("0.5").alias("match_score"), F.lit("1").alias("is_match"))
    return _written(rows, tsv.write_matches, sep="\t")


def _profile_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _written(L.single_profile(*sides(spark, sf_dir)), tsv.write_profile_csv)
    return back.selectExpr("source", "family", "CAST(keys_seen AS BIGINT) AS keys_seen", "CAST(total_rows AS BIGINT) AS total_rows", "CAST(max AS BIGINT) AS max")


def _in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations as rows in memory."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()
    return tsv.from_rows(spark, [{"entity_id": str(r[0]), "business_name": r[1], "country": None} for r in rows])


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all task slots if it comes in fewer partitions: a small file is one task, and so
    would be all that follows up to the next exchange, where rows become many keys each."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.sql(ENTITY_SQL.format(part="{parts}"), parts=spark.read.parquet(f"{sf_dir}/part.parquet")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.sql(TEXT_SQL.format(documents="{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet")))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = entities(spark, sf_dir)
    return e.where("src = 0"), e.where("src > 0").withColumn("source", F.concat(F.lit("S"), (F.col("src") + 1).cast("string")))


def _raw_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per s1 the other sources' parts with the same name and brand, as a comma list."""
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    a = d.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("source1_entity_id"), "p_name", "p_brand")
    b = d.where("p_partkey % 3 > 0").select(F.col("p_partkey").cast("string").alias("target"), "p_name", "p_brand")
    lists = b.groupBy("p_name", "p_brand").agg(F.concat_ws(",", F.sort_array(F.collect_list("target"))).alias("matched_entity_ids"))
    return a.join(lists, ["p_name", "p_brand"], "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_truth(_raw_truth(spark, sf_dir), "source1_entity_id")


def truth_lists(spark: SparkSession, sf_dir: str) -> C.Truth:
    return C.Truth(*load_truth_lists(_raw_truth(spark, sf_dir), "source1_entity_id"))


def _names(make, column: str = "business_name", alias: str = "value") -> Query:
    return lambda s, d: texts(s, d).select("entity_id", make(F.col(column)).alias(alias))


def _from_signature(make, rows=texts, style=SETS) -> Query:
    return lambda s, d: signature(rows(s, d), style).select("entity_id", make().alias("value"))


def _joined(make) -> Query:
    """Array results as text, one join of the items."""
    return lambda s, d: texts(s, d).select("entity_id", F.array_join(make(), "|").alias("value"))


def _pairs_text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda p: F.concat_ws("+", p["a"], p["b"])), "|")


def _name() -> F.Column:
    return F.col("business_name")


def _address() -> F.Column:
    return F.col("business_address")


def text_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = texts(spark, sf_dir)
    return e.where("src = 0"), e.where("src > 0").withColumn("source", F.concat(F.lit("S"), (F.col("src") + 1).cast("string")))


#: Names in plain letters.
ASCII = Style(to_ascii=T.ascii_fold)


def _block(family: str, caps: dict[str, int] | None = None, style=SETS, of=sides) -> Query:
    def run(s, d):
        s1, others = of(s, d)
        q = keys(signature(s1, style), [family])
        p = keys(signature(others, style, ("source",)), [family], carry=("source",))
        return B.block_join(q, p, caps or {}).select(*B.PAIR)

    return run


def _both(make) -> Query:
    return lambda s, d: make(*sides(s, d))


def _with_truth(make) -> Query:
    return lambda s, d: make(*sides(s, d), truth(s, d))


def _evaluated(make) -> Query:
    """``make`` on both sides and the truth by its different lists."""
    return lambda s, d: make(*sides(s, d), truth_lists(s, d))


def _by_class(make) -> Query:
    """``make`` on the composite pipeline's pairs of classes, the truth and both sides' classes."""

    def run(s, d):
        pairs, left, right = L.scored("composite", *sides(s, d))
        return make(pairs, truth_lists(s, d), left, right)

    return run


def _scored(make) -> Query:
    """``make`` on the truth and the composite pipeline's pairs."""
    return lambda s, d: make(truth(s, d), B.all_sources(L.composite(*sides(s, d))))


def _overlap(family: str, cap: int) -> Query:
    def run(s, d):
        s1, others = sides(s, d)
        q = keys(signature(s1, FIRST), [family])
        p = keys(signature(others, FIRST, ("source",)), [family], carry=("source",))
        return B.overlap_join(q, p, {family: cap})

    return run


#: Families as blocks, with their cap and style.
BLOCKS = {
    "exact_name": (500, SETS), "name_no_suffix": (500, SETS), "translit_name": (500, SETS), "domain_name": (500, SETS),
    "number": (500, LISTS), "prefix5": (250, LISTS), "prefix8": (250, LISTS), "translit_prefix6": (250, LISTS),
    "first_token": (500, LISTS), "name_token": (150, LISTS), "address_token": (150, LISTS), "postal": (500, LISTS),
    "name_pair": (200, SETS), "address_pair": (200, SETS), "name_address": (150, SETS), "name_number": (150, SETS),
    "name_postal": (20, SETS), "number_address": (75, SETS), "name_ngram": (500, SETS),
}


def queries() -> dict[str, Query]:
    basic = T.basic
    selected = lambda a, b, t=None: L.rare_selection(a, b, L.HYBRID_BUDGET, L.HYBRID_DF)[0]
    out: dict[str, Query] = {
        "cand_v4": _both(L.composite),
        "norm_basic": _names(basic),
        "norm_compact": _names(lambda c: T.compact(basic(c))),
        "strip_suffix": _names(lambda c: T.strip_suffix(basic(c))),
        "strip_suffix_ws": _names(lambda c: T.strip_suffix_ws(T.word_series(c))),
        "norm_word": _names(T.word),
        "norm_word_series": _names(T.word_series),
        "norm_country": _names(T.country, "country"),
        "transliterate": _names(T.transliterate),
        "domain_name": _from_signature(lambda: F.col("domain")),
        "numbers": _joined(lambda: T.numbers(_address())),
        "first_number": _names(lambda c: K.first_number(T.numbers(c)), "business_address"),
        "postal_codes": _joined(lambda: K.postal_codes(T.numbers(_address()))),
        "name_tokens": _joined(lambda: K.name_tokens(basic(_name()))),
        "name_tokens_set": _joined(lambda: K.as_set(K.name_tokens(basic(_name())))),
        "address_tokens": _joined(lambda: K.address_tokens(basic(_address()))),
        "first_token": _names(lambda c: K.first_or_empty(K.name_tokens(basic(c)))),
        "prefix5": _names(lambda c: K.prefix(T.compact(basic(c)), 5)),
        "prefix8": _names(lambda c: K.prefix(T.compact(basic(c)), 8)),
        "translit_prefix": _names(lambda c: K.prefix(K.ascii_only(T.transliterate(c)), 6)),
        "transliterate_ascii": _names(lambda c: T.transliterate(c, T.ascii_fold)),
        "token_pairs": _from_signature(lambda: _pairs_text(K.pairs(F.col("address_tokens"))), entities),
        "cross_keys": _from_signature(lambda: _pairs_text(K.cross(F.col("name_tokens"), F.col("postals")))),
        "pair_key": lambda s, d: signature(texts(s, d), SETS).select(
            "entity_id", K.pair_key(F.col("country"), K.first_or_empty(F.col("name_tokens")), F.col("number")).alias("value")
        ),
        "char_ngrams": _from_signature(lambda: F.array_join(F.array_sort(K.char_ngrams(F.col("compact"))), "|")),
        "name_features": lambda s, d: texts(s, d).select("entity_id", T.name_features(_name()).alias("f")).select("entity_id", "f.*"),
        "address_features": lambda s, d: texts(s, d).select("entity_id", T.address_features(_address()).alias("f")).select(
            "entity_id", "f.raw", "f.basic", "f.compact", "f.numbers", F.size("f.address_number_tokens").cast("long").alias("n_numbers")
        ),
        "truth_pairs": lambda s, d: E.truth_pairs(truth(s, d)),
    }
    for family, (cap, style) in BLOCKS.items():
        out[f"block_{family}"] = _block(family, {family: cap}, style)
        out[f"block_{family}_small_cap"] = _block(family, {family: SMALL_CAPS[family]}, style)
    out |= {
        "block_exact_name_uncapped": _block("exact_name"),
        "overlap_tokens": _overlap("address_token", 1000),
        "overlap_ngrams": _overlap("address_ngram", 300),
        "cand_v3": _both(L.first),
        "cand_real_scale": _both(L.real_scale),
        "cand_selective": _both(L.selective),
        "cand_selective_small_cap": _both(lambda a, b: L.selective(a, b, {f: SMALL_CAPS[f] for f in L.SELECTIVE_CAPS})),
        "cand_adaptive": _both(L.adaptive),
        "cand_hybrid": _with_truth(L.hybrid),
        "hybrid_sweep": _evaluated(L.hybrid_sweep),
        "hybrid_best": _evaluated(lambda a, b, t: L.best_configuration(L.hybrid_sweep(a, b, t))),
        "hybrid_rescue_only": _with_truth(lambda a, b, t: L.hybrid(a, b, t, strong_blocks=False)),
        "profile_single": _both(L.single_profile),
        "profile_composite": _both(L.composite_profile),
        "top_blocks": _both(lambda a, b: P.worst_blocks(L.single_sizes(a, b))),
        "overflow_stats": _both(lambda a, b: P.overflow(L.single_sizes(a, b), B.cap_of(L.SELECTIVE_CAPS | {"first_token": 50}))),
        "universe_counts": _both(lambda a, b: P.universe_counts(B.universe(keys(signature(a, SETS), list(L.COMPOSITE_CAPS))))),
        "selected_keys": _both(lambda a, b: selected(a, b).select("source", "s1", "family", "k1", "k2", "df", "rank")),
        "selected_key_stats": _both(lambda a, b: P.selected_counts(selected(a, b))),
        "positive_coverage": lambda s, d: L.coverage(truth_lists(s, d), *sides(s, d)),
        "totals": _with_truth(L.totals),
        "block_translit_name_ascii": _block("translit_name", {"translit_name": 500}, ASCII, text_sides),
        "pair_table": _pair_table,
        "tsv_cand_v4": lambda s, d: L.composite(*_files(s, d)[:2]),
        "tsv_truth": lambda s, d: E.truth_pairs(_files(s, d)[2]),
        "candidate_file": _candidate_file,
        "match_file": _match_file,
        "profile_file": _profile_file,
        "in_memory_rows": _in_memory,
        "eval_selective": _evaluated(lambda a, b, t: L.evaluate("selective", a, b, t)),
        "eval_adaptive": _evaluated(lambda a, b, t: L.evaluate("adaptive", a, b, t)),
        "eval_v3": _evaluated(lambda a, b, t: L.evaluate("first", a, b, t)),
        "eval_real_scale": _evaluated(lambda a, b, t: L.evaluate("real_scale", a, b, t)),
        "index_sizes": lambda s, d: L.build_index(entities(s, d)).groupBy("family").agg(F.sum("m").alias("n")),
        "recall": _by_class(C.recall),
        "missing_pairs": _scored(E.missing),
        "missing_top30": _scored(lambda t, p: E.missing(t, p, 30)),
        "candidate_stats": _scored(E.candidate_stats),
        "evaluation": _by_class(C.evaluation),
        "f05_per_entity": _by_class(C.f05_per_entity),
        "macro_f05": _by_class(C.macro_f05),
    }
    return out

"""The candidate generators and profilers, as families, caps and options over one spine.

Every generator takes ``s1`` (records) and ``others`` (records with a
``source`` column) and returns distinct (source, s1, candidate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import blocking as B
from ..operators import classes as C
from ..operators import evaluate as E
from ..operators import profile as P
from ..operators.keys import FIRST, KEY, LISTS, SERIES, SETS, WORDS, Style, keys, signature
from ..sources.tsv import validate_columns

#: Inclusive block caps per pipeline (fixed values).
FIRST_CAPS = {
    "exact_name": 500, "name_no_suffix": 500, "translit_name": 500, "translit_no_suffix": 500,
    "prefix5": 250, "prefix8": 250, "translit_prefix6": 250,
    "name_token": 150, "translit_token": 150, "address_token": 150, "number": 500, "postal": 500,
}
FIRST_OVERLAP = {"address_token": 1000, "address_ngram": 300}
#: The pair family is indexed and never probed.
FIRST_FAMILIES = [*FIRST_CAPS, "address_ngram", "address_token_pair"]
REAL_SCALE = ["exact_name", "name_no_suffix", "prefix5", "first_token", "number", "postal"]
SELECTIVE_CAPS = {"exact_name": 500, "name_no_suffix": 500, "prefix5": 50, "name_token": 50, "number": 50, "postal": 100, "address_token": 50}
COMPOSITE_CAPS = {
    "exact_name": 500, "name_no_suffix": 500, "translit_name": 500, "translit_no_suffix": 500, "domain_name": 500,
    "name_postal": 20, "name_number": 150, "name_address": 150, "name_pair": 200, "address_pair": 200, "number_address": 75,
}
ADAPTIVE_STRONG = {"exact_name": 500, "name_no_suffix": 500, "translit_name": 500, "domain_name": 500}
ADAPTIVE_BUDGET = {"name_token": 2, "translit_token": 2, "address_token": 2, "name_ngram": 2, "translit_ngram": 2, "address_ngram": 1}
ADAPTIVE_DF = 500
HYBRID_STRONG = {**ADAPTIVE_STRONG, "name_postal": 20, "name_number": 150, "name_address": 150, "name_pair": 200}
HYBRID_BUDGET = {"name_token": 2, "translit_token": 2, "address_token": 2, "address_pair": 2, "number_address": 1}
HYBRID_DF, HYBRID_LEAST, HYBRID_SWEEP, HYBRID_AVERAGE = 100, 20, (0, 10, 25, 50, 100), 1000
SINGLE_PROFILE = ["exact_name", "name_no_suffix", "prefix5", "first_token", "name_token", "number", "postal", "address_token"]
COMPOSITE_PROFILE = ["name_pair", "address_pair", "name_address", "name_number", "name_postal", "number_address"]


def _keys(s1: DataFrame, others: DataFrame, style: Style, families: list[str], distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    carry = ("source", "weight") if "weight" in others.columns else ("source",)
    return keys(signature(s1, style), families, distinct), keys(signature(others, style, carry), families, distinct, carry)


def first(s1: DataFrame, others: DataFrame, caps: dict[str, int] = FIRST_CAPS, overlap: dict[str, int] = FIRST_OVERLAP) -> DataFrame:
    """14 families with lists of tokens; address tokens and n-grams also by overlap; never a record itself."""
    q, p = _keys(s1, others, FIRST, list({**caps, **overlap}))
    return B.block_or_overlap(q, p, caps, overlap).where("s1 <> candidate")


def real_scale(s1: DataFrame, others: DataFrame) -> DataFrame:
    """Six uncapped families over the word form; pairs are found between classes of equal records, and
    those of their members made as they are returned: no exchange holds pairs, but those of ``_real_scale_rest``."""
    if "weight" in others.columns:  # classes
        return B.block_join(*_keys(s1, others, SERIES, REAL_SCALE), {})
    left, right = C.collapsed(s1, others)
    q, p = (_first_keys(C.with_members(side.records.where("alone"), side), ("ids",)) for side in (left, right))
    met = B.block_join(q, p, {}, lambda a, b: B.join_first(a, b, ("ids",), ("ids",)))
    return C.spelled(met).union(C.expanded(_real_scale_rest(left, right), left, right))


def _first_keys(records: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Keys of ``real_scale`` with those before them, the short ones first; of records that are alone, so that the
    keys are few and all that their ids have."""
    carry = (*carry, "source") if "source" in records.columns else carry
    return keys(signature(records, SERIES, carry), REAL_SCALE[::-1], carry=carry, before=True)


def _real_scale_rest(left: C.Side, right: C.Side) -> DataFrame:
    """The class pairs of which a side has several records or a long address: made distinct by an exchange."""
    one, rest = (lambda side: side.records.where("alone")), (lambda side: side.records.where("NOT alone"))
    pairs = lambda a, b: B.join_keys(*_keys(a, b, SERIES, REAL_SCALE))
    return pairs(rest(left), right.records).union(pairs(one(left), rest(right)))


def _real_scale_counts(left: C.Side, right: C.Side) -> DataFrame:
    """(cls, n): how many candidates the classes of source 1 have, summed up where pairs are made."""
    q, p = (_first_keys(side.records.where("alone"), ("weight",)) for side in (left, right))
    met = B.block_join(q, p, {}, lambda a, b: B.join_first(a, b, (), ("weight",)))
    rest = B.all_sources(_real_scale_rest(left, right)).join(right.weights().withColumnRenamed("cls", "candidate"), "candidate")
    every = met.select("s1", F.col("candidate_weight").alias("weight")).union(rest.select("s1", "weight"))
    return every.groupBy(F.col("s1").alias("cls")).agg(F.sum("weight").alias("n"))


def _real_scale_shares(pairs: DataFrame, left: C.Side, right: C.Side) -> DataFrame:
    """Those of the class pairs (s1, candidate) that share a key."""
    q, p = _keys(left.records, right.records, SERIES, REAL_SCALE)
    asked = pairs.join(q.select(F.col("entity_id").alias("s1"), *KEY), "s1")
    return asked.join(p.select(F.col("entity_id").alias("candidate"), *KEY), ["candidate", *KEY], "left_semi").select("s1", "candidate").distinct()


def selective(s1: DataFrame, others: DataFrame, caps: dict[str, int] = SELECTIVE_CAPS) -> DataFrame:
    q, p = _keys(s1, others, LISTS, list(caps))
    return B.block_join(q, p, caps)


def composite(s1: DataFrame, others: DataFrame, caps: dict[str, int] = COMPOSITE_CAPS) -> DataFrame:
    q, p = _keys(s1, others, SETS, list(caps))
    return B.block_join(q, p, caps)


def rare_selection(s1: DataFrame, others: DataFrame, budget: dict[str, int], most: int) -> tuple[DataFrame, DataFrame]:
    """The rarest keys of every s1, and the posts they select from."""
    q, p = _rare_keys(s1, others, list(budget))
    return B.rarest(q, B.frequencies(p, q), budget, most), p


def _rare_keys(s1: DataFrame, others: DataFrame, families: list[str]) -> tuple[DataFrame, DataFrame]:
    return _keys(s1, others, SETS, families, distinct=True)


def adaptive(s1: DataFrame, others: DataFrame, strong: dict[str, int] = ADAPTIVE_STRONG, budget: dict[str, int] = ADAPTIVE_BUDGET, most: int = ADAPTIVE_DF) -> DataFrame:
    q, p = _rare_keys(s1, others, [*strong, *budget])
    return B.selected_join(B.probes(q, p, strong, budget, most), p).select(*B.PAIR)


def hybrid_parts(
    s1: DataFrame, others: DataFrame, truth: DataFrame, strong: dict[str, int] = HYBRID_STRONG, budget: dict[str, int] = HYBRID_BUDGET,
    most: int = HYBRID_DF, least: int = HYBRID_LEAST, strong_blocks: bool = True, weights: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Strong pairs, and rescue pairs (with their least df) of entities with few strong ones.

    ``weights`` (cls, weight): the ids that a candidate stands for, where ids are classes.  ``strong_blocks=False`` gives the result of a run whose strong blocks stay empty.
    """
    q, p = _rare_keys(s1, others, [*strong, *budget])
    read = B.probes(q, p, strong, budget, most)
    pairs = B.selected_join(read.where("strong") if strong_blocks else read.where("false"), p).select(*B.PAIR)
    hard = B.hard_entities(truth, pairs, least, weights)
    return pairs, B.selected_join(read.where("NOT strong").join(hard, "s1", "left_semi"), p)


def hybrid(s1: DataFrame, others: DataFrame, truth: DataFrame, max_df: int = HYBRID_DF, **options) -> DataFrame:
    strong, rescue = hybrid_parts(s1, others, truth, **options)
    return strong.union(rescue.where(F.col("df") <= max_df).select(*B.PAIR)).distinct()


def hybrid_sweep(s1: DataFrame, others: DataFrame, truth: DataFrame | C.Truth, thresholds: tuple[int, ...] = HYBRID_SWEEP, **options) -> DataFrame:
    """Evaluation per threshold from one pass: each pair of classes carries the least df that admits it (strong: 0)."""
    truth = truth if isinstance(truth, C.Truth) else C.of_truth(truth)
    left, right = C.collapsed(s1, others)
    strong, rescue = hybrid_parts(left.records, right.records, left.records.select(F.col("entity_id").alias("s1")), weights=right.weights(), **options)
    pairs = strong.select("s1", "candidate", F.lit(0).cast("long").alias("df")).union(rescue.select("s1", "candidate", "df"))
    least = pairs.groupBy("s1", "candidate").agg(F.min("df").alias("df"))
    within = lambda t, x: F.sum(F.when(F.col("df") <= t, x))
    some = C.groups(truth, left)
    per = C.numbers(least, truth, some, right, lambda n, hit: [c for k, t in enumerate(thresholds) for c in (within(t, n).alias(f"n{k}"), within(t, hit).alias(f"hit{k}"))])
    zero = lambda c: F.coalesce(c, F.lit(0))
    levels = F.array(*[F.struct(F.lit(t).alias("threshold"), zero(f"n{k}").alias("n"), zero(f"hit{k}").alias("hit")) for k, t in enumerate(thresholds)])
    totals_ = truth.lists.select("list", F.size("targets").alias("total"))
    rows = some.join(per, ["cls", "list"], "left").join(totals_, "list").select("total", "judged", "w", F.inline(levels))
    return rows.groupBy("threshold").agg(*E.recall_columns(F.col("w")), *E.stats_columns(F.col("w")))


def best_configuration(sweep: DataFrame, most: float = HYBRID_AVERAGE) -> DataFrame:
    """The eligible row of highest recall; ties to the lowest threshold."""
    return sweep.where(F.col("avg") <= most).orderBy(F.desc("recall"), "threshold").limit(1)


def single_sizes(s1: DataFrame, others: DataFrame) -> DataFrame:
    q, p = _keys(s1, others, LISTS, SINGLE_PROFILE)
    return B.block_sizes(p, q)


def composite_sizes(s1: DataFrame, others: DataFrame) -> DataFrame:
    q, p = _keys(s1, others, WORDS, COMPOSITE_PROFILE, distinct=True)
    return B.block_sizes(p, q)


def single_profile(s1: DataFrame, others: DataFrame) -> DataFrame:
    return P.summary(single_sizes(s1, others))


def composite_profile(s1: DataFrame, others: DataFrame) -> DataFrame:
    return P.summary(composite_sizes(s1, others), P.COMPOSITE_SHARES, count="keys")


def coverage(truth: DataFrame | C.Truth, s1: DataFrame, others: DataFrame) -> DataFrame:
    """``P.positive_coverage`` between the classes of both sides; pairs are made only as they are returned."""
    truth = truth if isinstance(truth, C.Truth) else C.of_truth(truth)
    left, right = C.collapsed(s1, others)
    reached = C.reached(truth, right)
    some = C.groups(truth, left).select("cls", "list")
    small = some.join(reached.select("list", "candidate"), "list")
    asked = small.where(F.col("cls") != C.NONE).select(F.col("cls").alias("s1"), F.col("candidate").alias("target")).distinct()
    told = _shared(asked, left, right).select(F.col("s1").alias("cls"), F.col("target").alias("candidate"), *COMPOSITE_PROFILE)
    # targets come last: they are the larger part of a row
    cells = small.join(told, ["cls", "candidate"], "left").join(reached, ["list", "candidate"])
    rows = C.placed(truth.members, left).join(cells, ["cls", "list"])
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in COMPOSITE_PROFILE]
    return rows.select("s1", *flags, F.explode("targets").alias("target")).select("s1", "target", *COMPOSITE_PROFILE)


def _shared(pairs: DataFrame, left: C.Side, right: C.Side) -> DataFrame:
    """Per class pair (s1, target) and family, whether they share a key: by parts of keys where both are alone."""
    sig = lambda side, which: signature(side.records.where(which), WORDS)
    one = P.shared_parts(pairs, sig(left, "alone"), sig(right, "alone"), COMPOSITE_PROFILE)
    rest = lambda side: side.records.where("NOT alone").select("entity_id").distinct()
    by_left = pairs.join(rest(left).withColumnRenamed("entity_id", "s1"), "s1", "left_semi")
    by_right = pairs.join(rest(right).withColumnRenamed("entity_id", "target"), "target", "left_semi")
    others = by_left.unionByName(by_right).distinct()
    return one.union(P.positive_coverage(others, signature(left.records, WORDS), signature(right.records, WORDS), COMPOSITE_PROFILE))


def build_index(records: DataFrame) -> DataFrame:
    """The long-form key table of the first pipeline's 14 families; ValueError if a column is missing."""
    return keys(signature(validate_columns(records), FIRST), FIRST_FAMILIES)


def generate_candidates(records: DataFrame, index: DataFrame) -> DataFrame:
    """(source, s1, candidate) of ``records`` against an index with a ``source`` column."""
    q = keys(signature(records, FIRST), FIRST_FAMILIES)
    some = lambda df, caps: df.where(F.col("family").isin(list(caps)))
    probed = {**FIRST_CAPS, **FIRST_OVERLAP}
    return B.block_or_overlap(some(q, probed), some(index, probed), FIRST_CAPS, FIRST_OVERLAP).where("s1 <> candidate")


def generate_candidate_pairs(s1: DataFrame, index_s2: DataFrame, index_s3: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id): distinct per source, all sources one after another."""
    index = index_s2.withColumn("source", F.lit("S2")).unionByName(index_s3.withColumn("source", F.lit("S3")))
    return generate_candidates(s1, index).select(F.col("s1").alias("source1_entity_id"), F.col("candidate").alias("candidate_entity_id"))


def totals(s1: DataFrame, others: DataFrame, truth: DataFrame) -> DataFrame:
    """Row counts of the inputs: (what, n)."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    sources = others.groupBy(F.col("source").alias("what")).agg(F.count("*").alias("n"))
    return count(s1, "S1").union(sources).union(count(truth, "truth entities")).union(count(E.truth_pairs(truth), "truth pairs"))


#: Name -> (s1, others, truth) -> distinct (source, s1, candidate), for runs by name.
GENERATORS = {
    "first": lambda a, b, t: first(a, b),
    "real_scale": lambda a, b, t: real_scale(a, b),
    "selective": lambda a, b, t: selective(a, b),
    "composite": lambda a, b, t: composite(a, b),
    "adaptive": lambda a, b, t: adaptive(a, b),
    "hybrid": lambda a, b, t: hybrid(a, b, t),
}
#: Generators that are evaluated over the rows of source 1; the others over the truth's entities.
OVER_ROWS = {"first", "selective"}


def class_pairs(name: str, left: C.Side, right: C.Side) -> DataFrame:
    """Distinct (s1, candidate) of one generator over the sources, both of them classes."""
    if name == "hybrid":
        every = left.records.select(F.col("entity_id").alias("s1"))
        strong, rescue = hybrid_parts(left.records, right.records, every, weights=right.weights())
        return B.all_sources(strong.union(rescue.select(*B.PAIR)))
    return B.all_sources(GENERATORS[name](left.records, right.records, None))


def scored(name: str, s1: DataFrame, others: DataFrame) -> tuple[DataFrame, C.Side, C.Side]:
    """The class pairs of one generator, and the classes of both sides."""
    left, right = C.collapsed(s1, others, apart=name == "first")  # the first one never pairs a record with itself
    return class_pairs(name, left, right), left, right


def evaluate(name: str, s1: DataFrame, others: DataFrame, truth: DataFrame | C.Truth) -> DataFrame:
    """Recall and candidate statistics of one generator, over the entities it is judged on."""
    truth = truth if isinstance(truth, C.Truth) else C.of_truth(truth)
    if name == "real_scale":
        left, right = C.collapsed(s1, others)
        rows = C.counted_apart(_real_scale_counts(left, right), lambda some: _real_scale_shares(some, left, right), truth, left, right)
        return rows.agg(*E.recall_columns(F.col("w")), *E.stats_columns(F.col("w")))
    pairs, left, right = scored(name, s1, others)
    rows = None
    if name in OVER_ROWS:
        rows = s1.select(strip(F.col("entity_id")).alias("s1")).distinct()
        truth = C.Truth(truth.members.join(rows, "s1", "left_semi"), truth.lists)
    return C.evaluation(pairs, truth, left, right, rows)

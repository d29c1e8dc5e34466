"""Classes of ids with equal records, and evaluation over them.

Ids whose records are equal get equal candidates and are equal candidates.  The
generators read one set of records a class, whose ``weight`` (ids of the class)
stands for the others in block sizes and frequencies, and yield pairs of
classes; entities are counted by the members of theirs.  Copies thus cost
their own rows, not the product of both sides' copies.  Truths with one list of
targets share that list in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import evaluate as E

#: The class of ids without a record; ids are stripped, so none has this name.
NONE = " "
_TEXTS = ["business_name", "business_address", "country"]
#: Characters of an address, which then has at most 85 postal codes.
LONG = 512
#: Ids of a class that are brought together, about.
TOGETHER = 256


@dataclass(frozen=True)
class Side:
    """One side's classes, named by their smallest id; ``members`` is (entity_id, cls), ``weighed`` has the weight
    of cls too, ``sizes`` is (cls, weight), ``records`` has cls as entity_id, weight, and alone: whether it is the
    only record of its ids, and its address of at most LONG characters."""

    weighed: DataFrame
    sizes: DataFrame
    records: DataFrame

    @property
    def members(self) -> DataFrame:
        return self.weighed.select("entity_id", "cls")

    def weights(self) -> DataFrame:
        return self.sizes


@dataclass(frozen=True)
class Truth:
    """``members`` is (s1, list), ``lists`` is (list, targets)."""

    members: DataFrame
    lists: DataFrame


def _digits(digest: str, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")


def collapse(records: DataFrame, carry: tuple[str, ...] = (), apart: DataFrame | None = None) -> Side:
    """Classes by the records of an id, with repeats, in any order; null and empty are one, as everywhere.

    A class is told by how many records it has and two sums of 60 bits of their SHA-256, so an id with
    many records meets in numbers only.  Ids of ``apart`` (entity_id) are classes of their own.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _TEXTS]
    rows = records.select(strip(F.col("entity_id")).alias("entity_id"), *carry, *texts)
    hashed = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*carry, *_TEXTS)), 256))
    sums = [F.sum(_digits("digest", at)).cast("string") for at in (1, 16)]
    ids = hashed.groupBy("entity_id").agg(F.concat_ws("-", F.count("*").cast("string"), *sums).alias("content"), F.count("*").alias("n"), F.max(F.length("business_address")).alias("longest"))
    cls = F.substring(F.sha2("content", 256), 1, 32)
    if apart is not None:
        ids = ids.join(apart.select("entity_id").distinct().withColumn("own", F.lit(True)), "entity_id", "left")
        cls = F.when(F.col("own"), F.concat(F.lit("id "), F.col("entity_id"))).otherwise(cls)
    told = ids.select("entity_id", cls.alias("told"), ((F.col("n") == 1) & (F.col("longest") <= LONG)).alias("alone"))
    chosen = told.groupBy("told").agg(F.min("entity_id").alias("cls"), F.count("*").alias("weight"), F.bool_and("alone").alias("alone"))
    named = chosen.select(F.col("cls").alias("entity_id"), "weight", "alone")
    own = rows.join(named, "entity_id").select("entity_id", *carry, *_TEXTS, "weight", "alone")
    return Side(told.join(chosen, "told").select("entity_id", "cls", "weight"), chosen.select("cls", "weight"), own)


def collapsed(s1: DataFrame, others: DataFrame, apart: bool = False) -> tuple[Side, Side]:
    """Both sides' classes; ``apart``: an id of both sides is a class of its own on each, under one name."""
    both = None
    if apart:
        ids = lambda df: df.select(strip(F.col("entity_id")).alias("entity_id")).distinct()
        both = ids(s1).join(ids(others), "entity_id", "left_semi")
    return collapse(s1, apart=both), collapse(others, ("source",), apart=both)


def together(side: Side) -> DataFrame:
    """(cls, ids): the members of each class, TOGETHER or so in a row."""
    part = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("weight") / TOGETHER)).alias("part")
    return side.weighed.groupBy("cls", part).agg(F.collect_list("entity_id").alias("ids")).select("cls", "ids")


def with_members(records: DataFrame, side: Side) -> DataFrame:
    """Records of classes with the members as ``ids``, TOGETHER or so in a row."""
    return records.join(together(side).withColumnRenamed("cls", "entity_id"), "entity_id")


def expanded(pairs: DataFrame, left: Side, right: Side) -> DataFrame:
    """(source, s1, candidate) of the members of distinct class pairs: each once, as classes have no member
    in common.  Pairs of members are made as they are returned and meet in no exchange."""
    named = lambda side, name: together(side).select(F.col("cls").alias(name), F.col("ids").alias(f"{name}_ids"))
    return spelled(pairs.join(named(right, "candidate"), "candidate").join(named(left, "s1"), "s1"))


def spelled(met: DataFrame) -> DataFrame:
    """(source, s1, candidate) of rows with the lists s1_ids and candidate_ids."""
    ones = met.select("source", F.explode("s1_ids").alias("s1"), "candidate_ids")
    return ones.select("source", "s1", F.explode("candidate_ids").alias("candidate"))


def of_truth(truth: DataFrame) -> Truth:
    """A truth of (s1, targets) by its different lists."""
    named = truth.select("s1", "targets", F.sha2(F.to_json("targets"), 256).alias("list"))
    return Truth(named.select("s1", "list"), named.select("list", "targets").distinct())


def groups(truth: Truth, left: Side, entities: DataFrame | None = None) -> DataFrame:
    """(cls, list, w, judged): how many s1 of the truth or of ``entities`` (s1; default: the truth's) are of a
    class and have a list; cls is NONE without a record, list empty out of the truth."""
    base = truth.members
    if entities is None:
        base = base.withColumn("judged", F.lit(True))
    else:
        own = entities.select("s1").distinct().withColumn("judged", F.lit(True))
        base = base.join(own, "s1", "full_outer").withColumn("judged", F.coalesce("judged", F.lit(False)))
    return placed(base, left).groupBy("cls", "list", "judged").agg(F.count("*").alias("w"))


def placed(base: DataFrame, left: Side) -> DataFrame:
    """``base`` (s1, list) with the class of s1."""
    rows = base.join(left.members.withColumnRenamed("entity_id", "s1"), "s1", "left")
    return rows.withColumns({"cls": F.coalesce("cls", F.lit(NONE)), "list": F.coalesce("list", F.lit(""))})


def wanted(truth: Truth, right: Side) -> DataFrame:
    """(list, candidate, true): how many targets of a list are of a candidate class."""
    flat = truth.lists.select("list", F.explode("targets").alias("entity_id"))
    return flat.join(right.members, "entity_id").groupBy("list", F.col("cls").alias("candidate")).agg(F.count("*").alias("true"))


def reached(truth: Truth, right: Side) -> DataFrame:
    """(list, candidate, targets): the targets of a list that are of a candidate class."""
    flat = truth.lists.select("list", F.explode("targets").alias("entity_id"))
    return flat.join(right.members, "entity_id").groupBy("list", F.col("cls").alias("candidate")).agg(F.collect_list("entity_id").alias("targets"))


def numbers(pairs: DataFrame, truth: Truth, some: DataFrame, right: Side, aggregates: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """Per class and list of ``some``: ``aggregates`` over (candidates, true ones) of the class pairs (s1, candidate)."""
    asked = some.select(F.col("cls").alias("s1"), "list").distinct()
    rows = pairs.join(right.weights().withColumnRenamed("cls", "candidate"), "candidate").join(asked, "s1")
    rows = rows.join(wanted(truth, right), ["list", "candidate"], "left")
    return rows.groupBy(F.col("s1").alias("cls"), "list").agg(*aggregates(F.col("weight"), F.coalesce("true", F.lit(0))))


def counted(pairs: DataFrame, truth: Truth, left: Side, right: Side, entities: DataFrame | None = None) -> DataFrame:
    """(cls, list, w, judged, total, n, hit): the rows of ``evaluate.counted``, w at a time."""
    some = groups(truth, left, entities)
    per = numbers(pairs, truth, some, right, lambda n, hit: [F.sum(n).alias("n"), F.sum(hit).alias("hit")])
    return completed(some, per, truth)


def counted_apart(n: DataFrame, shares: Callable[[DataFrame], DataFrame], truth: Truth, left: Side, right: Side) -> DataFrame:
    """``counted`` without pairs: ``n`` is (cls, n); ``shares`` keeps those of class pairs (s1, candidate) that
    are pairs, and is asked for the true ones only."""
    some = groups(truth, left)
    true = some.select(F.col("cls").alias("s1"), "list").distinct().join(wanted(truth, right), "list")
    hits = true.join(shares(true.select("s1", "candidate").distinct()), ["s1", "candidate"])
    per = hits.groupBy(F.col("s1").alias("cls"), "list").agg(F.sum("true").alias("hit"))
    return completed(some.join(n, "cls", "left"), per, truth)


def completed(some: DataFrame, per: DataFrame, truth: Truth) -> DataFrame:
    """``some`` with the numbers of each class and list, zero if it has none, and the length of the list."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    totals = truth.lists.select("list", F.size("targets").alias("total"))
    return some.join(per, ["cls", "list"], "left").join(totals, "list", "left").select("cls", "list", "w", "judged", "total", zero("n"), zero("hit"))


def recall(pairs: DataFrame, truth: Truth, left: Side, right: Side) -> DataFrame:
    return counted(pairs, truth, left, right).agg(*E.recall_columns(F.col("w")))


def evaluation(pairs: DataFrame, truth: Truth, left: Side, right: Side, entities: DataFrame | None = None) -> DataFrame:
    w = F.col("w")
    return counted(pairs, truth, left, right, entities).agg(*E.recall_columns(w), *E.stats_columns(w))


def f05_per_entity(pairs: DataFrame, truth: Truth, left: Side, right: Side) -> DataFrame:
    """(s1, f05) for every s1 of the truth."""
    scored = counted(pairs, truth, left, right).select("cls", "list", E.f05_of_counts())
    return placed(truth.members, left).join(scored, ["cls", "list"]).select("s1", "f05")


def macro_f05(pairs: DataFrame, truth: Truth, left: Side, right: Side) -> DataFrame:
    scored = counted(pairs, truth, left, right).select("w", E.f05_of_counts())
    return scored.agg(F.round(F.coalesce(F.sum(F.col("f05") * F.col("w")) / F.sum("w"), F.lit(0.0)), 6).alias("macro_f05"))

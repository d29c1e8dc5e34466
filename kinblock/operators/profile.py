"""Block-size profiles, overflow statistics and key coverage of true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import FAMILIES

SHARES = (10, 25, 50, 100, 500)
COMPOSITE_SHARES = (10, 25, 50, 100, 250, 500)


def summary(sizes: DataFrame, shares: tuple[int, ...] = SHARES, by: tuple[str, ...] = ("source", "family"), count: str = "keys_seen") -> DataFrame:
    """Per family: keys, rows, exact quantiles and the share of blocks within each size (per cent)."""
    q = F.percentile("n", F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    rows = sizes.groupBy(*by).agg(
        F.count("*").alias(count),
        F.sum("n").alias("total_rows"),
        q.alias("q"),
        F.max("n").alias("max"),
        *[F.avg(F.when(F.col("n") <= t, 100.0).otherwise(0.0)).alias(f"le_{t}") for t in shares],
    )
    at = [F.round(F.get("q", F.lit(k)), 6).alias(name) for k, name in enumerate(("median", "p90", "p95", "p99"))]
    return rows.select(*by, count, "total_rows", *at, "max", *[F.round(f"le_{t}", 6).alias(f"le_{t}") for t in shares])


def worst_blocks(sizes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest blocks per source and family; ties by key."""
    w = Window.partitionBy("source", "family").orderBy(F.desc("n"), "country", "k1", "k2")
    return sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def overflow(sizes: DataFrame, cap) -> DataFrame:
    """Keys, usable and overflowed blocks per source and family under the cap column."""
    return sizes.groupBy("source", "family").agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("n") <= cap).alias("usable"),
        F.count_if(F.col("n") > cap).alias("overflowed"),
    )


def universe_counts(universe: DataFrame) -> DataFrame:
    return universe.groupBy("family").agg(F.count("*").alias("keys"))


def selected_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("source", "family").agg(F.count("*").alias("selected"))


def positive_coverage(truth_pairs: DataFrame, left: DataFrame, right: DataFrame, families: list[str]) -> DataFrame:
    """Per true pair (s1, target) and family, whether the two signatures share a key.
    Targets without a record are left out.  Only records of true pairs are looked at,
    and their keys stay arrays; of records with one id all keys count."""

    def held(sig: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        some = sig.join(ids.select(F.col(name).alias("entity_id")).distinct(), "entity_id", "left_semi")
        given = lambda f: F.filter(FAMILIES[f](), lambda x: x["a"] != "")
        arrays = [F.transform(given(f), lambda x: F.struct(F.col("country").alias("c"), x["a"].alias("a"), x["b"].alias("b"))).alias(f) for f in families]
        all_ = [F.flatten(F.collect_list(f)).alias(f"{name}_{f}") for f in families]
        return some.select(F.col("entity_id").alias(name), *arrays).groupBy(name).agg(*all_)

    sides = truth_pairs.join(held(right, truth_pairs, "target"), "target").join(held(left, truth_pairs, "s1"), "s1", "left")
    return sides.select("s1", "target", *[F.coalesce(F.arrays_overlap(f"s1_{f}", f"target_{f}"), F.lit(False)).alias(f) for f in families])


#: The parts that the keys of ``shared_parts`` are made of.
PARTS = ["country", "name_tokens", "address_tokens", "number", "postals"]


def shared_parts(pairs: DataFrame, left: DataFrame, right: DataFrame, families: list[str]) -> DataFrame:
    """``positive_coverage`` of ids with one record whose tokens are sets: told from tokens and numbers, which are
    fewer than the keys made of them.  Pairs with an id that has no record are left out."""

    def held(sig: DataFrame, name: str) -> DataFrame:
        return sig.select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in PARTS])

    common = lambda c: F.array_intersect(f"s1_{c}", f"target_{c}")
    some = lambda c: F.arrays_overlap(f"s1_{c}", f"target_{c}")
    number = (F.col("s1_number") == F.col("target_number")) & (F.col("s1_number") != "")
    tests = {
        "name_pair": F.size(common("name_tokens")) >= 2,
        "address_pair": F.size(common("address_tokens")) >= 2,
        "name_address": some("name_tokens") & some("address_tokens"),
        "name_number": some("name_tokens") & number,
        "name_postal": some("name_tokens") & some("postals"),
        "number_address": number & some("address_tokens"),
    }
    met = pairs.join(held(right, "target"), "target").join(held(left, "s1"), "s1")
    same = F.col("s1_country") == F.col("target_country")
    return met.select("s1", "target", *[F.coalesce(same & tests[f], F.lit(False)).alias(f) for f in families])

"""Recall, candidate statistics and F0.5 of candidate sets against a truth.

``truth`` has one row per s1 with ``targets`` (array, maybe empty);
``pairs`` are distinct (s1, candidate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("s1", F.explode("targets").alias("target"))


def found(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    hits = pairs.withColumnRenamed("candidate", "target")
    return truth_pairs(truth).join(hits, ["s1", "target"], "left_semi")


def missing(truth: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    hits = pairs.withColumnRenamed("candidate", "target")
    rows = truth_pairs(truth).join(hits, ["s1", "target"], "left_anti")
    return rows.orderBy("s1", "target").limit(limit) if limit else rows


def counted(truth: DataFrame, pairs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Per s1 of ``truth`` or ``entities`` (default: the truth's): total (true pairs, null out of the
    truth), n (candidates), hit (true ones) and judged (whether it is one of ``entities``).

    The pairs are read once and reduced to numbers; no entity's candidates meet in one row.
    """
    wanted = truth_pairs(truth).select("s1", F.col("target").alias("candidate"), F.lit(1).alias("true"))
    per = pairs.select("s1", "candidate").join(wanted, ["s1", "candidate"], "left").groupBy("s1").agg(F.count("*").alias("n"), F.count("true").alias("hit"))
    base = truth.select("s1", F.size("targets").alias("total"))
    if entities is None:
        base = base.withColumn("judged", F.lit(True))
    else:
        own = entities.select("s1").distinct().withColumn("judged", F.lit(True))
        base = base.join(own, "s1", "full_outer").withColumn("judged", F.coalesce("judged", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(per, "s1", "left").select("s1", "total", zero("n"), zero("hit"), "judged")


def recall_columns(w: Column | int = 1) -> list[Column]:
    """Aggregates over the rows of ``counted``, each of which stands for ``w`` rows."""
    w = F.lit(w) if isinstance(w, int) else w
    total = F.coalesce(F.sum(F.col("total") * w), F.lit(0)).cast("long")
    hit = F.coalesce(F.sum(F.when(F.col("total").isNotNull(), F.col("hit") * w)), F.lit(0))
    share = F.when(total == 0, 0.0).otherwise(hit / total)
    return [total.alias("total_true"), hit.alias("total_found"), F.round(share, 6).alias("recall")]


def stats_columns(w: Column | int = 1) -> list[Column]:
    """Aggregates over the rows of ``counted``, each of which stands for ``w`` rows."""
    w = F.lit(w) if isinstance(w, int) else w
    n = F.when(F.col("judged"), F.col("n"))
    at = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95)), w)
    return [F.round(F.sum(n * w) / F.sum(F.when(F.col("judged"), w)), 6).alias("avg"), F.round(F.get(at, F.lit(0)), 6).alias("median"), F.round(F.get(at, F.lit(1)), 6).alias("p95"), F.max(n).alias("max")]


def recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: total_true, total_found, recall (0 without true pairs)."""
    return counted(truth, pairs).agg(*recall_columns())


def candidate_counts(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1, n) with zeros, for every s1 of ``entities``."""
    n = pairs.groupBy("s1").agg(F.count("*").alias("n"))
    return entities.select("s1").distinct().join(n, "s1", "left").select("s1", F.coalesce("n", F.lit(0)).alias("n"))


def candidate_stats(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    return candidate_counts(entities, pairs).withColumn("judged", F.lit(True)).agg(*stats_columns())


def evaluation(truth: DataFrame, pairs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """recall, totals and candidate statistics over ``entities`` (default: the truth's), in one row."""
    return counted(truth, pairs, entities).agg(*recall_columns(), *stats_columns())


def f05(total: Column, predicted: Column, hit: Column) -> Column:
    """F0.5 of numbers of true, predicted and truly predicted ids: 1 if the first two are 0, 0 if one is or nothing is hit."""
    precision, recall_ = hit / predicted, hit / total
    score = 1.25 * precision * recall_ / (0.25 * precision + recall_)
    return F.when((total == 0) & (predicted == 0), 1.0).when((total == 0) | (predicted == 0) | (hit == 0), 0.0).otherwise(score)


def f05_of_counts() -> Column:
    """``f05`` over the rows of ``counted``."""
    return F.round(f05(F.col("total"), F.col("n"), F.col("hit")), 6).alias("f05")


def f05_per_entity(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1, f05) for every s1 of ``truth``."""
    return counted(truth, pairs).select("s1", f05_of_counts())


def macro_f05(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return f05_per_entity(truth, pairs).agg(F.round(F.coalesce(F.avg("f05"), F.lit(0.0)), 6).alias("macro_f05"))

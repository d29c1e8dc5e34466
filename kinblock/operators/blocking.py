"""Block sizes, caps, and the joins that make candidate pairs.

``queries`` are keys of source 1 (entity_id, KEY, m); ``posts`` are keys of the
other sources (entity_id, source, KEY, m), with a weight where a row stands
for as many ids (see ``classes``).  Blocks are counted per source, with
repeats, by partial aggregation: a hot key's rows meet nowhere, only its
counts do.  What the counts yield is small and goes back to the rows: the
blocks over a cap (joined to mark or drop their rows, Spark broadcasts them
or splits a skewed side) or, for rare keys, the sizes of the queries' own keys.  Caps are
inclusive and hold before any candidate join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import KEY

PAIR = ["source", "s1", "candidate"]
BLOCK = ["source", *KEY]


def universe(queries: DataFrame) -> DataFrame:
    return queries.select(*KEY).distinct()


def in_universe(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return rows.join(universe(queries), KEY, "left_semi")


def weight(posts: DataFrame) -> Column:
    """The ids that a row stands for."""
    return F.col("weight") if "weight" in posts.columns else F.lit(1).cast("long")


def sizes_of(posts: DataFrame) -> DataFrame:
    """(source, KEY, n): rows of each block, repeats counted."""
    return posts.groupBy(*BLOCK).agg(F.sum(F.col("m") * weight(posts)).alias("n"))


def block_sizes(posts: DataFrame, queries: DataFrame) -> DataFrame:
    """(source, KEY, n): rows of each block that a query can reach."""
    return in_universe(sizes_of(posts), queries).select(*BLOCK, "n")


def cap_of(caps: dict[str, int]) -> Column:
    """The cap of ``family``; null for a family without one."""
    expr = F.lit(None).cast("long")
    for family, cap in caps.items():
        expr = F.when(F.col("family") == family, F.lit(cap)).otherwise(expr)
    return expr


def capped(posts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The posts whose block is within its cap; a family without one keeps every block."""
    if not caps:
        return posts
    return posts.join(sizes_of(posts).where(F.col("n") > cap_of(caps)).select(*BLOCK), BLOCK, "left_anti")


def join_keys(queries: DataFrame, posts: DataFrame) -> DataFrame:
    """Distinct (source, s1, candidate) that share a key."""
    q = queries.select(F.col("entity_id").alias("s1"), *KEY)
    p = posts.select("source", F.col("entity_id").alias("candidate"), *KEY)
    return q.join(p, KEY).select(*PAIR).distinct()


def join_first(queries: DataFrame, posts: DataFrame, own: tuple[str, ...] = (), theirs: tuple[str, ...] = ()) -> DataFrame:
    """``join_keys`` without an exchange of pairs: each is made at the first key it shares, as told by ``before``
    (the country is part of the key).  Every id has one record; ``own`` and ``theirs`` are taken along."""
    q = queries.select(F.col("entity_id").alias("s1"), *KEY, F.col("before").alias("mine"), *[F.col(c).alias(f"s1_{c}") for c in own])
    p = posts.select("source", F.col("entity_id").alias("candidate"), *KEY, "before", *[F.col(c).alias(f"candidate_{c}") for c in theirs])
    met = q.join(p, KEY).where(~F.arrays_overlap("mine", "before"))
    return met.select(*PAIR, *[f"s1_{c}" for c in own], *[f"candidate_{c}" for c in theirs])


def block_join(queries: DataFrame, posts: DataFrame, caps: dict[str, int], join: Callable[[DataFrame, DataFrame], DataFrame] = join_keys) -> DataFrame:
    return join(queries, capped(posts, caps))


def block_or_overlap(queries: DataFrame, posts: DataFrame, caps: dict[str, int], overlap: dict[str, int], least: int = 2) -> DataFrame:
    """Pairs that share a key of a family of ``caps``, or at least ``least`` keys of one family of
    ``overlap``, counted with repeats on both sides; both by blocks within the family's cap there."""
    low = F.least(*[F.coalesce(cap_of(c), F.lit(2**62)) for c in (caps, overlap)])
    large = sizes_of(posts).where(F.col("n") > low)
    rows = posts.join(large, BLOCK, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    within = lambda c: F.coalesce(F.col("n") <= cap_of(c), F.lit(False))
    p = rows.select("source", F.col("entity_id").alias("candidate"), *KEY, F.col("m").alias("mp"), within(caps).alias("block"), within(overlap).alias("shared"))
    q = queries.select(F.col("entity_id").alias("s1"), *KEY, F.col("m").alias("mq"))
    met = q.join(p.where("block OR shared"), KEY)
    times = F.col("mq").cast("long") * F.col("mp")
    counts = [F.sum(F.when(F.col("shared") & (F.col("family") == f), times)).alias(f"n{k}") for k, f in enumerate(overlap)]
    enough = F.max("block").alias("block")
    found = met.groupBy(*PAIR).agg(enough, *counts)
    hit = F.col("block")
    for k in range(len(overlap)):
        hit = hit | F.coalesce(F.col(f"n{k}") >= least, F.lit(False))
    return found.where(hit).select(*PAIR)


def overlap_join(queries: DataFrame, posts: DataFrame, caps: dict[str, int], least: int = 2) -> DataFrame:
    """Pairs that share at least ``least`` keys of one family, counted with repeats on both sides."""
    return block_or_overlap(queries, posts, {}, caps, least)


def frequencies(posts: DataFrame, queries: DataFrame) -> DataFrame:
    """(source, KEY, df): records with the key, for keys that some query has."""
    once = posts.select("source", "entity_id", *KEY).distinct()
    return in_universe(once.groupBy(*BLOCK).agg(F.count("*").alias("df")), queries).select(*BLOCK, "df")


def rarest(queries: DataFrame, df: DataFrame, budget: dict[str, int], most: int) -> DataFrame:
    """Per s1, source and family the ``budget`` rarest keys with df from 1 to ``most``; ties by k1, k2."""
    q = queries.select(F.col("entity_id").alias("s1"), *KEY).distinct()
    w = Window.partitionBy("s1", "source", "family").orderBy("df", "k1", "k2")
    ranked = q.join(df.where(F.col("df").between(1, most)), KEY).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= F.coalesce(cap_of(budget), F.lit(0)))


def probes(queries: DataFrame, posts: DataFrame, strong: dict[str, int], budget: dict[str, int], most: int) -> DataFrame:
    """(source, s1, KEY, df, strong): the blocks that each s1 reads, strong ones by cap and its rarest ones
    by ``budget`` and ``most`` (the two name different families); one pass over queries and posts."""
    once = posts.groupBy("source", "entity_id", *KEY).agg(F.sum("m").alias("m"), F.first(weight(posts)).alias("weight"))
    sizes = once.groupBy(*BLOCK).agg(F.sum(F.col("m") * F.col("weight")).alias("n"), F.sum("weight").alias("df"))
    q = queries.select(F.col("entity_id").alias("s1"), *KEY).distinct()
    w = Window.partitionBy("s1", "source", "family").orderBy("df", "k1", "k2")
    own = ["source", "s1", *KEY, "df"]
    rows = q.join(sizes, KEY)
    capped_ = rows.where(F.col("n") <= cap_of(strong)).select(*own, F.lit(True).alias("strong"))
    ranked = rows.where(F.col("family").isin(list(budget)) & (F.col("df") <= most)).withColumn("rank", F.row_number().over(w))
    return capped_.unionByName(ranked.where(F.col("rank") <= cap_of(budget)).select(*own, F.lit(False).alias("strong")))


def selected_join(selected: DataFrame, posts: DataFrame) -> DataFrame:
    """(source, s1, candidate, df): candidates of selected keys with their least df."""
    p = posts.select("source", F.col("entity_id").alias("candidate"), *KEY)
    pairs = selected.select("source", "s1", "df", *KEY).join(p, BLOCK)
    return pairs.groupBy(*PAIR).agg(F.min("df").alias("df"))


def hard_entities(truth: DataFrame, strong: DataFrame, least: int, weights: DataFrame | None = None) -> DataFrame:
    """s1 of ``truth`` with fewer than ``least`` distinct strong candidates over all sources; ``weights``
    (cls, weight): the ids that a candidate stands for."""
    pairs = all_sources(strong)
    if weights is not None:
        pairs = pairs.join(weights.withColumnRenamed("cls", "candidate"), "candidate")
    n = pairs.groupBy("s1").agg(F.sum(weight(pairs)).alias("n"))
    return truth.select("s1").distinct().join(n, "s1", "left").where(F.coalesce("n", F.lit(0)) < least).select("s1")


def all_sources(pairs: DataFrame) -> DataFrame:
    """Distinct (s1, candidate) over the sources."""
    return pairs.select("s1", "candidate").distinct()

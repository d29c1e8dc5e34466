"""Stream-static probe: records that arrive are joined with the keys of source 1 (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocking import universe
from ..operators.keys import KEY, SERIES, keys, signature
from ..plans.pipelines import REAL_SCALE


def probe(stream: DataFrame, s1: DataFrame, families: list[str] = REAL_SCALE) -> DataFrame:
    """(source, s1, candidate, family) for every arriving record (with ``source``), one row a shared key."""
    q = keys(signature(s1, SERIES), families).select("entity_id", *KEY).distinct().withColumnRenamed("entity_id", "s1")
    p = keys(signature(stream, SERIES, ("source",)), families, carry=("source",)).withColumnRenamed("entity_id", "candidate")
    return p.join(q, KEY).select("source", "s1", "candidate", "family")


def sizes(stream: DataFrame, s1: DataFrame, families: list[str] = REAL_SCALE) -> DataFrame:
    """Running block sizes of the stream, for keys that source 1 has (complete mode)."""
    q = keys(signature(s1, SERIES), families)
    p = keys(signature(stream, SERIES, ("source",)), families, carry=("source",))
    return p.join(universe(q), KEY, "left_semi").groupBy("source", *KEY).agg(F.sum("m").alias("count"))

"""Runs a generator or profile over TSV files: ``python -m kinblock composite --s1 a.tsv --s2 b.tsv --s3 c.tsv``.

With ``--truth`` it prints recall and candidate statistics; with ``--out`` it
writes the pairs (or the profile) there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import pipelines as L
from .sources import tsv


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kinblock", description=__doc__)
    p.add_argument("plan", choices=[*L.GENERATORS, "profile", "composite_profile", "sweep"])
    for name in ("s1", "s2", "s3"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--truth")
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("kinblock").getOrCreate()
    read = lambda path: tsv.validate_columns(tsv.read_tsv(spark, path))
    s1 = read(a.s1)
    others = read(a.s2).withColumn("source", F.lit("S2")).unionByName(read(a.s3).withColumn("source", F.lit("S3")))
    truth = tsv.load_truth(tsv.read_tsv(spark, a.truth, tsv.TRUTH)) if a.truth else None
    if a.plan in ("hybrid", "sweep") and truth is None:
        p.error(f"{a.plan} needs --truth")

    def show(df: DataFrame, write=tsv.write_tsv) -> None:
        if a.out:
            write(df, a.out)
        else:
            df.show(50, False)

    if a.plan in ("profile", "composite_profile"):
        show((L.single_profile if a.plan == "profile" else L.composite_profile)(s1, others), tsv.write_profile_csv)
    elif a.plan == "sweep":
        sweep = L.hybrid_sweep(s1, others, truth).orderBy("threshold")
        show(sweep)
        L.best_configuration(sweep).show()
    else:
        if truth is not None:
            L.evaluate(a.plan, s1, others, truth).show()
        if a.out or truth is None:
            show(L.GENERATORS[a.plan](s1, others, truth))


if __name__ == "__main__":
    main()

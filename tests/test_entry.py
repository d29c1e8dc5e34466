import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from kinblock import oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_engine_query_has_an_oracle():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_folders(tmp_path):
    import shutil

    root = os.path.dirname(entry.__file__)
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 100 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy)


def test_library_does_not_import_llm():
    code = "import kinblock.queries, kinblock.oracle, kinblock.streaming.probe, sys; assert not any('llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["norm_basic", "token_pairs", "block_name_token_small_cap", "block_translit_name_ascii", "pair_table", "tsv_cand_v4", "profile_file", "overlap_ngrams", "cand_v3", "cand_v4", "cand_hybrid", "hybrid_sweep", "profile_single", "positive_coverage", "evaluation"])
def test_against_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA).toPandas()
    want = con.execute(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_streaming_probe(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinblock.sources.tsv import ENTITY
    from kinblock.streaming.probe import probe, sizes

    s1 = spark.createDataFrame([("a", "Acme", "12 Road", "x")], ENTITY)
    spark.createDataFrame([("b", "acme", "7 Road", "x"), ("c", "zeta", "", "x")], ENTITY).withColumn("source", F.lit("S2")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{ENTITY}, source string").parquet(str(tmp_path / "in"))
    q = probe(stream, s1).writeStream.format("memory").queryName("probe").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.s1, r.candidate) for r in spark.table("probe").collect()} == {("a", "b")}
    q = sizes(stream, s1).writeStream.outputMode("complete").format("memory").queryName("sizes").start()
    q.processAllAvailable()
    q.stop()
    assert {r.family for r in spark.table("sizes").collect()} == {"exact_name", "name_no_suffix", "prefix5", "first_token"}

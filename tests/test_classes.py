import random

import pytest
from pyspark.sql import functions as F

from kinblock import queries as Q
from kinblock.functions.text import strip
from kinblock.operators import blocking as B
from kinblock.operators import classes as C
from kinblock.operators import evaluate as E
from kinblock.operators import profile as P
from kinblock.operators.keys import WORDS, signature
from kinblock.plans import pipelines as L
from kinblock.sources import tsv

RECORD = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def tables(spark):
    """Few different records: copies, ids with several records, ids of both sides and of both sources, nulls."""
    rng = random.Random(5)
    texts = [(f"{a} {b} Ltd", f"{n}, {c} Weg {10000 + n}", "x") for a in ("Quell", "Morgen") for b in ("Orgel", "Traders") for c in ("Linden", "Sund") for n in (3, 4)]
    texts += [(None, "", None), ("", None, ""), ("Quell", "Quell Quell", "x")]
    s1 = [(f"a{rng.randrange(30)} ", *rng.choice(texts)) for _ in range(36)] + [(f"b{k}", *rng.choice(texts)) for k in range(3)]
    others = [(f"b{rng.randrange(45)}", *rng.choice(texts), rng.choice(["S2", "S3"])) for _ in range(60)] + [("a1", *texts[0], "S2"), (None, *texts[0], "S2"), (" ", *texts[5], "S3")]
    s1 += [(None, *texts[0]), ("", *texts[1])]
    truth = [(f"a{k}", rng.choice([[], ["b1", "b2", "gone"], ["b3"], [f"b{j}" for j in range(20)], ["a1"]])) for k in range(25)] + [("b1", ["b1", "b2"]), ("none", ["b1"]), ("", ["b1", "b4"])]
    return (
        spark.createDataFrame(s1, RECORD).cache(),
        spark.createDataFrame(others, f"{RECORD}, source string").cache(),
        spark.createDataFrame(truth, "s1 string, targets array<string>").cache(),
    )


def _by_rows(name, s1, others, truth):
    pairs = B.all_sources(L.GENERATORS[name](s1, others, truth))
    if name not in L.OVER_ROWS:
        return E.evaluation(truth, pairs)
    rows = s1.select(strip(F.col("entity_id")).alias("s1")).distinct()
    return E.evaluation(truth.join(rows, "s1", "left_semi"), pairs, rows)


@pytest.mark.parametrize("name", list(L.GENERATORS))
def test_classes_count_as_rows_do(spark, tables, name):
    assert L.evaluate(name, *tables).collect() == _by_rows(name, *tables).collect()


def test_block_sizes_count_the_members(spark, tables):
    """With caps between the numbers of classes and of rows."""
    s1, others, truth = tables
    left, right = C.collapsed(s1, others)
    for caps in ({"exact_name": 4, "number": 9, "name_token": 12}, {"exact_name": 7, "name_pair": 8}):
        rows = L.selective(s1, others, caps)
        by_class = C.evaluation(B.all_sources(L.selective(left.records, right.records, caps)), C.of_truth(truth), left, right)
        assert by_class.collect() == E.evaluation(truth, B.all_sources(rows)).collect()


def test_scores_of_entities(spark, tables):
    s1, others, truth = tables
    pairs = B.all_sources(L.composite(s1, others))
    by_class, left, right = L.scored("composite", s1, others)
    mine = C.of_truth(truth)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(C.f05_per_entity(by_class, mine, left, right)) == key(E.f05_per_entity(truth, pairs))
    assert C.macro_f05(by_class, mine, left, right).collect() == E.macro_f05(truth, pairs).collect()
    assert C.recall(by_class, mine, left, right).collect() == E.recall(truth, pairs).collect()


def test_sweep(spark, tables):
    s1, others, truth = tables
    got = {r.threshold: tuple(r)[1:] for r in L.hybrid_sweep(s1, others, truth).collect()}
    for t in L.HYBRID_SWEEP:
        assert got[t] == tuple(E.evaluation(truth, B.all_sources(L.hybrid(s1, others, truth, max_df=t))).first())


def test_coverage(spark, tables, monkeypatch):
    s1, others, truth = tables
    by_row = P.positive_coverage(E.truth_pairs(truth), signature(s1, WORDS), signature(others, WORDS), L.COMPOSITE_PROFILE)
    tested = []
    whole = P.positive_coverage
    monkeypatch.setattr(P, "positive_coverage", lambda pairs, *a: tested.append(pairs) or whole(pairs, *a))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(L.coverage(truth, s1, others)) == key(by_row)
    assert tested[0].count() < by_row.count()


def test_copies_are_paired_once(spark):
    """60 copies on both sides: one pair of classes, not 3,600 pairs."""
    one = spark.range(60).select(F.col("id").cast("string").alias("entity_id"), F.lit("Quell Orgel").alias("business_name"), F.lit("3, Linden").alias("business_address"), F.lit("x").alias("country"))
    others = one.withColumn("entity_id", F.concat(F.lit("o"), "entity_id")).withColumn("source", F.lit("S2"))
    pairs, left, right = L.scored("composite", one, others)
    assert pairs.count() == 1
    truth = C.of_truth(one.select(F.col("entity_id").alias("s1"), F.array(F.lit("o1"), F.lit("o2")).alias("targets")))
    assert tuple(C.evaluation(pairs, truth, left, right).first()) == (120, 120, 1.0, 60.0, 60.0, 60.0, 60)


@pytest.mark.parametrize("name", ["evaluation", "f05_per_entity", "recall", "macro_f05"])
def test_queries_read_classes(spark, name, monkeypatch):
    """The query's pairs are those of classes: the generator sees one record of each."""
    seen = []
    monkeypatch.setitem(L.GENERATORS, "composite", lambda a, b, t: seen.append((a, b)) or L.composite(a, b))
    Q.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and all("weight" in df.columns for df in seen[0])


@pytest.mark.parametrize("name", ["hybrid_sweep", "hybrid_best"])
def test_sweeps_read_truth_lists(spark, name, monkeypatch):
    monkeypatch.setattr(Q, "truth", None)  # the truth by rows: a list of targets for every entity
    assert Q.queries()[name](spark, "/root/testdata/sf0.001").columns[0] == "threshold"


@pytest.mark.parametrize("name", ["eval_v3", "eval_adaptive", "eval_selective", "eval_real_scale"])
def test_evaluations_read_truth_lists(spark, name, monkeypatch):
    monkeypatch.setattr(Q, "truth", None)
    assert "recall" in Q.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_truth_lists(spark):
    raw = spark.createDataFrame([("s", "old", 1), ("s", " a , ,b,a", 2), ("e", "", 3), ("n", None, 4), ("t", " a , ,b,a", 1)], "source1_entity_id string, matched_entity_ids string, at int")
    members, lists = tsv.load_truth_lists(raw, "at")
    of = {r.list: r.targets for r in lists.collect()}
    assert {r.s1: of[r.list] for r in members.collect()} == {r.s1: r.targets for r in tsv.load_truth(raw, "at").collect()} and len(of) == 3


def test_uncapped_pairs_are_those_of_rows(spark, tables, monkeypatch):
    s1, others, _ = tables
    plain = B.join_keys(*L._keys(s1, others, L.SERIES, L.REAL_SCALE))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = key(plain)
    assert {"", "b1"} <= {r[1] for r in want} and {"", "a1"} <= {r[2] for r in want}  # null ids are empty ones
    for most in (256, 1):
        monkeypatch.setattr(C, "TOGETHER", most)
        assert key(L.real_scale(s1, others)) == want


def test_uncapped_pairs_meet_as_classes(spark, monkeypatch):
    """60 copies on both sides: 3,600 pairs are returned, one is made distinct."""
    one = spark.range(60).select(F.col("id").cast("string").alias("entity_id"), F.lit("Quell Orgel").alias("business_name"), F.lit("3, Linden").alias("business_address"), F.lit("x").alias("country"))
    met, join = [], B.block_join
    monkeypatch.setattr(B, "block_join", lambda *a: met.append(join(*a)) or met[-1])
    pairs = L.real_scale(one, one.withColumn("source", F.lit("S2")))
    assert pairs.columns == B.PAIR and pairs.count() == pairs.distinct().count() == 3600
    assert [df.count() for df in met] == [1]


def test_uncapped_pairs_meet_in_no_exchange(spark, tables, monkeypatch):
    """Pairs are told apart by the keys that two records share, not by bringing equal ones together."""
    met, join = [], B.block_join
    monkeypatch.setattr(B, "block_join", lambda *a: met.append(join(*a)) or met[-1])
    L.real_scale(*tables[:2])
    (plan,) = [df._jdf.queryExecution().executedPlan().toString() for df in met]
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Aggregate" not in above


def test_long_addresses_are_paired_once(spark):
    """Records with more keys than are held against each other, beside one with few of them."""
    codes = " ".join(str(10000 + k) for k in range(200))
    s1 = spark.createDataFrame([("a", "Quell", codes, "x"), ("b", "Morgen", "10003 10005", "x")], RECORD)
    others = spark.createDataFrame([("c", "Quell", codes, "x", "S2"), ("d", "Orgel", "10005 10003", "x", "S3"), ("e", "Orgel", "10003", "y", "S3")], f"{RECORD}, source string")
    assert sorted(map(tuple, L.real_scale(s1, others).collect())) == [("S2", "a", "c"), ("S2", "b", "c"), ("S3", "a", "d"), ("S3", "b", "d")]


def test_uncapped_pairs_are_counted_where_they_are_made(spark, tables, monkeypatch):
    """The evaluation makes no pairs distinct."""
    met, join = [], B.block_join
    monkeypatch.setattr(B, "block_join", lambda *a: met.append(join(*a)) or met[-1])
    assert L.evaluate("real_scale", *tables).collect() == _by_rows("real_scale", *tables).collect()
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_coverage_of_single_records_makes_no_keys(spark, monkeypatch):
    """Each id has one record: what two of them share is told from tokens and numbers."""
    rng = random.Random(7)
    words = ["Quell", "Morgen", "Orgel", "Sund", "ab", ""]
    row = lambda: (" ".join(rng.choices(words, k=rng.randrange(4))) or None, f"{rng.choice(['', 3, 10003, '10003 10005', '10005 123456'])} {' '.join(rng.choices(['Linden', 'Allee', 'Markt', 'weg'], k=rng.randrange(4)))}", rng.choice(["x", "y", None]))
    s1 = spark.createDataFrame([(f"a{k}", *row()) for k in range(40)], RECORD)
    others = spark.createDataFrame([(f"b{k}", *row(), rng.choice(["S2", "S3"])) for k in range(60)], f"{RECORD}, source string")
    truth = spark.createDataFrame([(f"a{k}", [f"b{j}" for j in range(k % 2, 60, 2)] + ["gone"]) for k in range(41)], "s1 string, targets array<string>")
    want = P.positive_coverage(E.truth_pairs(truth), signature(s1, WORDS), signature(others, WORDS), L.COMPOSITE_PROFILE).collect()
    asked, whole = [], P.positive_coverage
    monkeypatch.setattr(P, "positive_coverage", lambda pairs, *a: asked.append(pairs) or whole(pairs, *a))
    assert sorted(map(tuple, L.coverage(truth, s1, others).collect())) == sorted(map(tuple, want))
    assert all({False, True} == {r[f] for r in want} for f in L.COMPOSITE_PROFILE)
    assert [df.count() for df in asked] == [0]

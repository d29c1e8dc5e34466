import pytest
from pyspark.sql import functions as F

from kinblock.operators import blocking as B
from kinblock.operators import profile as P
from kinblock.operators.keys import FIRST, LISTS, SETS, keys, signature
from kinblock.plans import pipelines as L
from kinblock.sources.tsv import ENTITY

S1 = [("S1-001", "Quellbach Orgel Werkstatt Pvt. Ltd.", "31, H.K. Road, Lindenau 481025", "Utopia")]
#: The same business, overlap of a name token or of an address token only, and others.
S2 = [
    ("S2-001", "Quellbach Orgel Werkstatt Private Limited", "31 HK Road Lindenau 481025", "Utopia"),
    ("S2-002", "Morgentau Werkstatt", "8 Harbour Street, Sundheim", "Utopia"),
    ("S2-003", "Quellbach Orgel Werkstatt", "31 Hans Krug Road, Lindenow", "Utopia"),
    ("S2-004", "Quellbach Orgel Werkstatt", "Lindenau 481025", "Utopia"),
]
S3 = [("S3-001", "quellbach orgel werkstatt", "HK Road", "utopia"), ("S3-002", "Zimmer Traders", "5 Anger Road, Lindenau", "Utopia")]


def entities(spark, rows, source=None):
    df = spark.createDataFrame(rows, ENTITY)
    return df.withColumn("source", F.lit(source)) if source else df


def sides(spark):
    return entities(spark, S1), entities(spark, S2, "S2").union(entities(spark, S3, "S3"))


def found(df):
    return sorted({r["candidate"] for r in df.collect()})


def test_smoke_pipelines(spark):
    s1, others = sides(spark)
    everything = ["S2-001", "S2-002", "S2-003", "S2-004", "S3-001", "S3-002"]
    strict = ["S2-001", "S2-003", "S2-004", "S3-001"]
    assert found(L.first(s1, others)) == everything
    assert found(L.selective(s1, others)) == everything
    assert found(L.real_scale(s1, others)) == strict
    assert found(L.composite(s1, others)) == strict
    assert set(strict) <= set(found(L.adaptive(s1, others)))


def test_pair_api(spark):
    pairs = L.generate_candidate_pairs(entities(spark, S1), L.build_index(entities(spark, S2)), L.build_index(entities(spark, S3)))
    assert pairs.columns == ["source1_entity_id", "candidate_entity_id"] and pairs.count() == 6
    with pytest.raises(ValueError, match="country"):
        L.build_index(entities(spark, S2).drop("country"))


def test_denominators(spark):
    s1, others = sides(spark)
    truth = spark.createDataFrame([("S1-001", ["S2-001"]), ("absent", ["S2-001"])], "s1 string, targets array<string>")
    assert L.evaluate("first", s1, others, truth).first().recall == 1.0  # over the rows of source 1
    assert L.evaluate("composite", s1, others, truth).first().recall == 0.5  # over the truth's entities
    assert {r.what: r.n for r in L.totals(s1, others, truth).collect()} == {"S1": 1, "S2": 4, "S3": 2, "truth entities": 2, "truth pairs": 2}


@pytest.mark.parametrize("n,kept", [(3, True), (4, False)])
def test_cap_is_inclusive(spark, n, kept):
    s1 = entities(spark, [("a", "acme", "", "x")])
    others = entities(spark, [(f"b{i}", "acme", "", "x") for i in range(n)], "S2")
    q, p = keys(signature(s1), ["exact_name"]), keys(signature(others, SETS, ("source",)), ["exact_name"], carry=("source",))
    assert (B.block_join(q, p, {"exact_name": 3}).count() == n) is kept


def test_overlap_counts_repeats(spark):
    s1 = entities(spark, [("a", "q", "lindow lindow", "x"), ("b", "q", "sundby", "x")])
    others = entities(spark, [("c", "r", "lindow lindow", "x"), ("d", "r", "sundby", "x")], "S2")
    q, p = keys(signature(s1, FIRST), ["address_token"]), keys(signature(others, FIRST, ("source",)), ["address_token"], carry=("source",))
    assert [tuple(r) for r in B.overlap_join(q, p, {"address_token": 1000}).collect()] == [("S2", "a", "c")]


def test_empty_country_joins_and_empty_value_does_not(spark):
    s1 = entities(spark, [("a", "acme", "", None), ("b", "", "", "")])
    others = entities(spark, [("c", "Acme", "", ""), ("d", None, None, "")], "S2")
    assert [(r.s1, r.candidate) for r in L.composite(s1, others).collect()] == [("a", "c")]


def test_self_is_excluded_only_in_the_first_pipeline(spark):
    s1 = entities(spark, [("a", "acme", "", "x")])
    others = entities(spark, [("a", "acme", "", "x")], "S2")
    assert L.first(s1, others).count() == 0 and L.composite(s1, others).count() == 1


def test_rarest_ties_by_parts(spark):
    q = spark.createDataFrame([("s", "f", "", "ab", "z"), ("s", "f", "", "abc", "d"), ("s", "f", "", "b", "a")], "entity_id string, family string, country string, k1 string, k2 string")
    df = q.drop("entity_id").withColumn("source", F.lit("S2")).withColumn("df", F.lit(3))
    got = B.rarest(q, df, {"f": 2}, 100).orderBy("rank").collect()
    assert [(r.k1, r.k2) for r in got] == [("ab", "z"), ("abc", "d")]
    assert B.rarest(q, df, {"f": 2}, 2).count() == 0


def test_hybrid_rescue_and_as_written(spark):
    s1, others = sides(spark)
    truth = spark.createDataFrame([("S1-001", ["S2-001"]), ("none", [])], "s1 string, targets array<string>")
    strong, rescue = L.hybrid_parts(s1, others, truth)
    assert found(strong) and rescue.count()
    assert set(found(L.hybrid(s1, others, truth, max_df=0))) == set(found(strong))
    bare, again = L.hybrid_parts(s1, others, truth, strong_blocks=False)
    assert bare.count() == 0 and again.count()
    sweep = L.hybrid_sweep(s1, others, truth)
    assert sweep.count() == 5 and L.best_configuration(sweep).first().threshold == 0


def test_profiles(spark):
    s1, others = sides(spark)
    sizes = L.single_sizes(s1, others)
    row = L.single_profile(s1, others).where("source = 'S2' AND family = 'exact_name'")
    assert row.count() == 0  # no block of that family: left out
    top = P.worst_blocks(sizes, 1).where("source = 'S2' AND family = 'name_token'").first()
    assert (top.k1, top.n, top["rank"]) == ("werkstatt", 4, 1)
    over = P.overflow(sizes, F.lit(3)).where("source = 'S2' AND family = 'name_token'").first()
    assert (over["keys"], over.usable, over.overflowed) == (3, 2, 1)


def test_positive_coverage(spark):
    s1, others = sides(spark)
    truth = spark.createDataFrame([("S1-001", ["S2-001", "S2-002", "gone"])], "s1 string, targets array<string>")
    rows = {r.target: r for r in L.coverage(truth, s1, others).collect()}
    assert set(rows) == {"S2-001", "S2-002"}
    assert rows["S2-001"].name_pair and not rows["S2-002"].name_pair


def test_empty_tables(spark):
    s1, others = entities(spark, []), entities(spark, [], "S2")
    for make in (L.first, L.real_scale, L.selective, L.composite, L.adaptive, L.single_profile, L.composite_profile):
        assert make(s1, others).count() == 0


def test_lists_keep_repeats(spark):
    df = entities(spark, [("a", "acme acme", "", "x")])
    assert [(r.k1, r.m) for r in keys(signature(df, LISTS), ["name_token"]).collect()] == [("acme", 2)]
    assert [(r.k1, r.m) for r in keys(signature(df, SETS), ["name_token"]).collect()] == [("acme", 1)]


def test_hot_block_never_meets(spark):
    """Repeats count, a block over its cap is left out of blocks and stays in overlaps with a higher cap."""
    s1 = entities(spark, [("a", "q", "lindow sundby", "x")])
    others = entities(spark, [(f"b{i}", "r", "lindow lindow" if i < 4 else "lindow sundby", "x") for i in range(6)], "S2")
    q, p = keys(signature(s1, FIRST), ["address_token"]), keys(signature(others, FIRST, ("source",)), ["address_token"], carry=("source",))
    assert {r.k1: r.n for r in B.sizes_of(p).collect()} == {"lindow": 10, "sundby": 2}
    assert found(B.block_join(q, p, {"address_token": 9})) == ["b4", "b5"]
    assert found(B.block_or_overlap(q, p, {"address_token": 9}, {"address_token": 10})) == [f"b{i}" for i in range(6)]
    assert found(B.block_or_overlap(q, p, {"address_token": 1}, {"address_token": 9})) == []


def test_cross_keys_of_whole_texts_equal_brute_force(spark):
    from kinblock.functions import tokens as K

    names, codes = [f"word{i}" for i in range(300)], [str(10000 + i) for i in range(9)]
    rows = spark.createDataFrame([(names, codes), ([], codes), (["a"], [])], "n array<string>, c array<string>")
    got = [[tuple(p) for p in r[0]] for r in rows.select(K.cross(F.col("n"), F.col("c"))).collect()]
    assert got == [[(a, b) for a in names for b in codes], [], []]


def test_plain_letters_join_accented_ones(spark):
    from kinblock.functions import text as T
    from kinblock.operators.keys import Style

    style = Style(to_ascii=T.ascii_fold)
    s1, others = entities(spark, [("a", "Café Ñandú", "", "x")]), entities(spark, [("b", "Cafe Nandu", "", "x")], "S2")
    q, p = keys(signature(s1, style), ["translit_name"]), keys(signature(others, style, ("source",)), ["translit_name"], carry=("source",))
    assert found(B.block_join(q, p, {})) == ["b"]
    q, p = keys(signature(s1), ["translit_name"]), keys(signature(others, SETS, ("source",)), ["translit_name"], carry=("source",))
    assert found(B.block_join(q, p, {})) == []

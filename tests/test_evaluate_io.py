import pytest

from kinblock.operators import evaluate as E
from kinblock.sources import tsv


def frames(spark, truth, pairs):
    return spark.createDataFrame(truth, "s1 string, targets array<string>"), spark.createDataFrame(pairs, "s1 string, candidate string")


def test_metrics(spark):
    t, p = frames(spark, [("a", ["x", "y"]), ("b", []), ("c", ["z"]), ("d", ["w"])], [("a", "x"), ("a", "q"), ("c", "z"), ("zz", "x")])
    assert tuple(E.recall(t, p).first()) == (4, 2, 0.5)
    assert {(r.s1, r.target) for r in E.missing(t, p).collect()} == {("a", "y"), ("d", "w")}
    assert E.missing(t, p, 1).count() == 1
    assert tuple(E.candidate_stats(t, p).first()) == (0.75, 0.5, 1.85, 2)
    f = {r.s1: r.f05 for r in E.f05_per_entity(t, p).collect()}
    assert f == {"a": 0.5, "b": 1.0, "c": 1.0, "d": 0.0}
    assert E.macro_f05(t, p).first()[0] == 0.625


def test_f05_edges(spark):
    t, p = frames(spark, [("a", ["x"]), ("b", []), ("c", ["x"])], [("a", "x"), ("a", "y"), ("b", "x"), ("c", "y")])
    assert {r.s1: r.f05 for r in E.f05_per_entity(t, p).collect()} == {"a": 0.555556, "b": 0.0, "c": 0.0}


def test_empty_truth(spark):
    t, p = frames(spark, [], [("a", "x")])
    assert E.recall(t, p).first().recall == 0.0 and E.macro_f05(t, p).first()[0] == 0.0


def test_truth_loader(spark):
    raw = spark.createDataFrame([("s", "old", 1), ("s", " a , ,b,a", 2), ("e", "", 3), ("n", None, 4)], "source1_entity_id string, matched_entity_ids string, at int")
    rows = {r.s1: r.targets for r in tsv.load_truth(raw, "at").collect()}
    assert rows == {"s": ["a", "b"], "e": [], "n": []}
    assert E.truth_pairs(tsv.load_truth(raw, "at")).count() == 2


def test_truth_of_several_files_is_read_by_name(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    (tmp_path / "1.tsv").write_text(head + "s\told\n" + "".join(f"f{i}\tx\n" for i in range(5000)))
    (tmp_path / "2.tsv").write_text(head + "s\tfirst\ns\tlast\n")
    for path in (tmp_path / "2.tsv", tmp_path):
        rows = tsv.load_truth(tsv.read_tsv(spark, str(path), tsv.TRUTH))
        assert rows.where("s1 = 's'").first().targets == ["last"]


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t"say ""hi"""\t"two\nlines"\tNA\n2\tnull\t\t pad \n')
    rows = [tuple(r) for r in tsv.read_tsv(spark, str(path)).orderBy("entity_id").collect()]
    assert rows == [("1", 'say "hi"', "two\nlines", "NA"), ("2", "null", "", " pad ")]
    assert tsv.has_line_breaks(spark, str(path))
    plain = tmp_path / "plain.tsv"
    plain.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t"say ""hi"""\tx\tNA\n')
    assert not tsv.has_line_breaks(spark, str(plain)) and tsv.read_tsv(spark, str(plain)).first().business_name == 'say "hi"'
    out = str(tmp_path / "out")
    tsv.write_tsv(tsv.read_tsv(spark, str(path)).select("entity_id", "country"), out)
    assert spark.read.csv(out, sep="\t", header=True).count() == 2
    tsv.write_profile_csv(spark.range(3), str(tmp_path / "csv"))


def test_validate_columns(spark):
    with pytest.raises(ValueError, match=r"\['business_address', 'business_name', 'country'\]"):
        tsv.validate_columns(spark.createDataFrame([("a",)], "entity_id string"))


def test_rows_and_result_files(spark, tmp_path):
    assert tsv.from_rows(spark, [{"entity_id": "1", "country": "x"}]).first().business_name == ""
    keyed = spark.createDataFrame([("a", "b", "postal")], "s1 string, candidate string, family string")
    tsv.write_candidates(keyed, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).columns == tsv.CANDIDATE_FILE
    scored = spark.createDataFrame([("a", "b", 0.5, 1)], "item_id_1 string, item_id_2 string, match_score double, is_match int")
    tsv.write_matches(scored, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).columns == tsv.MATCH_FILE


def test_command_line(spark, tmp_path, capsys):
    from kinblock.__main__ import main

    for name, rows in (("s1", "a\tAcme\t1 Road\tx\n"), ("s2", "b\tacme\t2 Road\tx\n"), ("s3", "c\tzeta\t\tx\n")):
        (tmp_path / name).write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + rows)
    (tmp_path / "t").write_text("source1_entity_id\tmatched_entity_ids\na\tb\n")
    files = [x for n in ("s1", "s2", "s3") for x in (f"--{n}", str(tmp_path / n))]
    main(["composite", *files, "--truth", str(tmp_path / "t"), "--out", str(tmp_path / "out")])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()] == [("S2", "a", "b")]
    assert "total_true" in capsys.readouterr().out
    main(["profile", *files])
    with pytest.raises(SystemExit):
        main(["sweep", *files])

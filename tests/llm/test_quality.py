import re
from collections import Counter

import pytest

from kinblock.llm import quality as Q

from .helpers import documents, edge_rows

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    "a b c d e a b c d e a b c d e f", "x\nx\n\n \nx y", "1 2 3 4 5 6 1 2 3 4 5 9 1 2 3 4 5", "# $$ <a>|b", "é é é é é é é é é é é é",
    "a b c d", "a b c d e", "a\x0bb\x0cc\rd\te", "\x1c \x85 x",
]


@pytest.mark.parametrize("clash", [False, True])
def test_measures_equal_brute_force(spark, clash):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = Q.ledger(documents(spark, rows, clash)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(key((d, *brute(t))) for d, t in rows)


def test_base_verdict(spark):
    got = {r.doc_id: r for r in Q.op9(documents(spark, [(1, "a b"), (2, " ".join(map(str, range(100, 150)))), (3, "a b c d e " * 9)])).collect()}
    assert got[1].base_failed and got[3].base_failed and not got[2].base_failed
    assert got[2].kept and not got[1].kept and not got[3].kept


def test_policy_keeps_columns_and_ablation(spark):
    docs = documents(spark, edge_rows() + [(50, " ".join(map(str, range(100, 150)))), (51, "& " * 40 + "a b c d e f g h i j")], clash=True)
    kept = Q.apply_policy(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 50}
    assert kept.where("doc_id = 50").first().n_words == 1  # the table's own column
    table = {r.rule: (r.n_failed, r.n_only) for r in Q.ablation(Q.ledger(docs)).collect()}
    assert table["many_symbols"] == (1, 0) and table["few_words"][0] == 9


def test_ablation_of_a_stored_ledger(spark):
    rows = edge_rows() + [(50, " ".join(map(str, range(100, 150)))), (51, "& " * 40 + "a b c d e f g h i j")]
    stored = {tuple(r) for r in Q.quality_ablation(documents(spark, rows, clash=True)).collect()}
    assert stored == {tuple(r) for r in Q.ablation(Q.ledger(documents(spark, rows))).collect()} and len(stored) == 6


def test_long_text(spark):
    text = "a b c d e f g " * 60_000 + "\n" + " ".join(str(i) for i in range(400_000))
    got = Q.ledger(documents(spark, [(1, text)])).first()
    assert (got.n_words, got.n_repeat_words, got.n_lines) == (820_000, 420_000, 2)


def test_empty_table(spark):
    assert Q.op9(documents(spark, [])).count() == 0 and Q.apply_policy(documents(spark, [])).count() == 0

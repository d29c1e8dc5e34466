import random

import numpy as np

from kinblock.llm import langid as L

from .helpers import documents, edge_rows

SYLLABLES = {
    "en": ["the", "ing", "th", "wh", "sh", "ou", "ed", "er"], "de": ["sch", "ung", "ein", "ver", "ß", "ü", "ch", "en"],
    "fr": ["eau", "oi", "é", "que", "ai", "è", "tion", "ou"], "es": ["ción", "ñ", "rr", "ll", "que", "dad", "os", "ez"],
}


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(800)
    truth = {d: lang for d, _, lang in rows}
    got = L.op2(documents(spark, rows, clash=True)).collect()
    out = [r for r in got if r.held_out]
    assert 100 < len(out) < 300 and np.mean([truth[r.doc_id] == r.lang_pred for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_edges_and_no_labels(spark):
    rows = corpus(300) + [(1000 + i, t, None) for i, (_, t) in enumerate(edge_rows())] + [(2000, "123 !! ½ Ⅷ _", "en")]
    got = L.op2(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == by[2000] == "und" and by[1003] != "und"
    none = L.op2(documents(spark, [(1, "some text", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert L.op2(documents(spark, [])).count() == 0


def test_one_language_and_stage(spark):
    docs = documents(spark, [(i, f"the thing {i}", "en") for i in range(20)] + [(30, "12", "en"), (31, None, "en")], clash=True)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(20))


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    c = L.train_svm((x @ x.T).astype(float) + 1.0, y)
    assert ((x @ (x.T @ c) + c.sum() > 0) == (y > 0)).mean() > 0.97


def test_features_and_votes_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [t for _, t, _ in corpus(30)] + ["", "a", "ab", "Aé 1!", "x" * 3000]

    def bucket(three):
        fold = [ord(" ") if c < 0x80 and not chr(c).isalnum() else ord("0") if chr(c).isdigit() and c < 0x80 else ord(chr(c).lower()) if c < 0x80 else c for c in three]
        return None if fold[:2] == [32, 32] else ((fold[0] | fold[1] << 8 | fold[2] << 16) * 2654435761 % 2**32) >> 19

    weights = np.array([[rng.uniform(-1, 1) for _ in range(4)] for _ in range(L.BUCKETS)] + [[0.0] * 4], np.float32)
    model = L.Model(["f", "g"], {"f": ["a", "b", "c"], "g": ["d"]}, weights, np.array([0.01, -0.02, 0.0, 0.03]), [(0, 1, 0)], {"f": [(0, 1, 1), (0, 2, 2), (1, 2, 3)], "g": []})
    got = L.judge(model, [t.encode() for t in texts])
    for t, lang, score in zip(texts, *got):
        data = t.encode() + b" "
        found = [b for i in range(len(data) - 2) if (b := bucket(data[i : i + 3])) is not None]
        if not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        m = [sum(float(weights[b, k]) for b in found) / max(1, len(found)) + float(model.bias[k]) for k in range(4)]
        sure = lambda v: 1 / (1 + np.exp(-L.SLOPE * v))
        if m[0] < 0:
            want = ("d", sure(-m[0]))
        else:
            votes = {"a": (m[1] >= 0) + (m[2] >= 0), "b": (m[1] < 0) + (m[3] >= 0), "c": (m[2] < 0) + (m[3] < 0)}
            if len(set(votes.values())) == 1:
                continue  # a circle: the sum of margins decides
            best = max(votes, key=votes.get)
            least = {"a": min(m[1], m[2]), "b": min(-m[1], m[3]), "c": min(-m[2], -m[3])}[best]
            want = (best, sure(m[0]) * sure(least))
        assert lang == want[0] and abs(score - want[1]) < 1e-4, t


def test_rare_languages_are_learned_and_machines_bounded(spark):
    rng = random.Random(6)
    rows, names = [], [f"q{k}" for k in range(30)]  # none is listed
    for k, name in enumerate(names):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)]
        for i in range(400 if k < 3 else 8):
            rows.append((len(rows), " ".join(rng.choice(own) for _ in range(30)), name))
    model = L.fit(documents(spark, rows))
    assert sorted(x for part in model.languages.values() for x in part) == sorted(names)
    assert max(map(len, model.languages.values())) <= L.FAMILY_MOST and model.weights.shape[1] <= 3 + 4 * 66
    got = L.identify(documents(spark, rows)).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out]) > 0.95


def test_stage_without_labels_keeps_texts_with_letters(spark):
    docs = documents(spark, [(1, "some text", None), (2, "12 !", None), (3, None, None)])
    assert [r.doc_id for r in L.keep_identified(docs).collect()] == [1]

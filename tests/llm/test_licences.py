import math
import random
import re

from kinblock.llm import licences as L

from .helpers import documents, edge_rows, words

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w, at, labels = W.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    pieces = ["under the MIT License", "apache license, version 2", "CC BY-NC", "mit license", "under the", "cc by", "nc", "version 2", "x", "apache", "é mit"]
    rows = edge_rows() + [(100 + i, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    got = L.op1(documents(spark, rows, clash=True)).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    have = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(map(key, have)) == sorted(key((d, *brute(t))) for d, t in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_method_labels(spark):
    rng = random.Random(4)
    body = words(rng, 60)
    rows = [(k, f"{body}\n{t.text}\n{body}") for k, t in enumerate(L.TEMPLATES)] + [(99, body), (98, "this license is public and general gnu version 3")]
    got = {r.doc_id: r for r in L.op1(documents(spark, rows)).collect()}
    for k, t in enumerate(L.TEMPLATES):
        assert t.label in got[k].labels.split(","), t
    assert got[99].labels == "" and got[99].score == 0.0 and got[98].labels == ""


def test_one_text_with_all_templates(spark):
    rng = random.Random(8)
    whole = "\n".join(f"{words(rng, 20)}\n{t.text}" for t in L.TEMPLATES)
    # the others give the licence words frequencies as in a corpus
    rows = [(0, whole), *[(1 + k, f"{words(rng, 30)} this software license public the of") for k in range(40)]]
    got = {r.doc_id: r for r in L.op1(documents(spark, rows)).collect()}
    assert got[0].labels == ",".join(sorted({t.label for t in L.TEMPLATES})) and got[1].labels == ""


def brute_labels(rows, templates):
    """(labels, score) of each text by all alignments of all templates, with frequencies counted here."""
    words_ = [W.findall((t or "").translate(LOWER)) for _, t in rows]
    vocab = L.vocabulary(templates)
    df = {w: sum(w in set(ws) for ws in words_) for w in vocab}
    idf = {w: math.log((len(rows) + 1) / (df[w] + 1)) + 0.01 for w in vocab}
    order = sorted(vocab, key=lambda w: (-idf[w], w))
    out = []
    for ws in words_:
        labels, best = set(), 0.0
        base = brute(" ".join(ws))[4]
        for t in templates:
            own = t.text.split()
            rare = [w for w in order if w in own][: L.PER_TEMPLATE]
            places = [k for k, w in enumerate(own) if w in rare]
            total = sum(idf[own[k]] for k in places)
            phrases = [p.split() for p in t.keys]
            starts = [next(k for k in range(len(own)) if own[k : k + len(p)] == p) for p in phrases]
            for d in range(-len(own), len(ws)):
                at = lambda k, d=d: ws[d + k] if 0 <= d + k < len(ws) else None
                weight = sum(idf[own[k]] for k in places if at(k) == own[k])
                if weight >= L.THRESHOLD * total * (1 - 1e-9) and all([at(s + k) for k in range(len(p))] == p for p, s in zip(phrases, starts)):
                    labels.add(t.label)
                    best = max(best, min(1.0, weight / total))
        out.append((",".join(sorted(labels | set(filter(None, base.split(","))))), 1.0 if base else best))
    return out


def test_labels_and_scores_equal_brute_force(spark):
    rng = random.Random(12)
    templates = [t for t in L.TEMPLATES if len(t.text.split()) < 60]
    rows = [(None, None), (1, "")]
    for k in range(60):
        parts = []
        for t in rng.sample(templates, rng.randint(1, 4)):
            own = t.text.split()
            for _ in range(rng.choice([0, 0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = words(rng, 1)
            if rng.random() < 0.2:
                del own[rng.randrange(len(own))]
            parts += [words(rng, rng.randint(0, 9)), " ".join(own)]
        rows.append((10 + k, " ".join(parts)))
    got = [(r.labels, r.score) for r in L.scan(documents(spark, rows, clash=True).coalesce(1), templates).collect()]
    want = brute_labels(rows, templates)
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))
    assert len({w[0] for w in want}) > 20 and any(w[0] == "" for w in want[2:])


def test_a_whole_alignment_after_a_broken_one(spark):
    whole = next(t.text for t in L.TEMPLATES if t.label == "isc" and len(t.text.split()) < 30)
    rows = [(1, whole.replace("and or", "or maybe") + " some words between " + whole), (2, whole.replace("and or", "or maybe")), (3, "x y z")]
    got = {r.doc_id: r.labels for r in L.op1(documents(spark, rows)).collect()}
    assert got == {1: "isc", 2: "", 3: ""}


def test_long_text_and_only_ascii_is_lowered(spark):
    text = "x " * 700_000 + "UNDER the MIT License \u212a" + " y" * 100_000
    r = L.op1(documents(spark, [(1, text), (2, "under the M\u0130T license")])).where("doc_id = 1").first()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (800_005, 1, 700_000, "mit")


def test_empty_table(spark):
    assert L.op1(documents(spark, [])).count() == 0


def test_small_parts_are_scanned_together(spark, monkeypatch):
    rows = [(k, f"text {k} under the MIT License") for k in range(200)] + [(None, None), (7, "")]
    parts = documents(spark, rows).repartition(60)
    few = L.op1(parts)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(L, "TASK_BYTES", 256)
    size = sum(len(t or "") for _, t in rows)
    many = L.op1(parts)
    assert many.rdd.getNumPartitions() == -(-size // 256) < 60
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == len(rows)
    monkeypatch.setattr(L, "TASK_BYTES", 1)
    assert L.op1(parts).rdd.getNumPartitions() == 60  # large parts stay as they are

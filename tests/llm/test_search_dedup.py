import random

import numpy as np
import xxhash

from kinblock.llm import common, simhash, topk

from .helpers import documents, edge_rows, words


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows, radius=3):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for (d, _), k in zip(rows, label):
        least[k] = min([x for x in (least.get(k), d) if x is not None], default=None)
    return [(d, f"{p:016x}", least[k]) for (d, _), p, k in zip(rows, prints, label)]


def near_rows():
    rng = random.Random(8)
    rows = list(edge_rows())
    for g in range(12):
        base = words(rng, 300).split()
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = words(rng, 1)
            rows.append((100 + len(rows), " ".join(text)))
    return rows


def test_simhash_equals_brute_force(spark):
    rows = near_rows()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = simhash.op10(documents(spark, rows, clash=True)).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_classes(rows)))
    small = simhash.classes(documents(spark, rows), tile=2).select("doc_id", "component_id").collect()  # many tiles a bucket
    assert sorted(map(key, small)) == sorted(key((d, c)) for d, _, c in brute_classes(rows))
    assert simhash.op10(documents(spark, [])).count() == 0


def near_copies(groups=40, n=120, changed=(1, 2, 4, 6)):
    """Originals and copies of them with some words replaced."""
    rng = random.Random(9)
    rows = []
    for g in range(groups):
        base = words(rng, n).split()
        rows.append((1000 + 10 * g, " ".join(base)))
        for k, m in enumerate(changed):
            text = list(base)
            for at in rng.sample(range(n), m):
                text[at] = words(rng, 1)
            rows.append((1001 + 10 * g + k, " ".join(text)))
    return rows


def brute_wide(rows):
    """The row that stays for each row, by all pairs that share a block and are within the radius."""
    bits = [simhash.wide_bits((t or "").encode()) for _, t in rows]
    blocks = [b[simhash.CHECK :].reshape(simhash.WIDE_BLOCKS, simhash.WIDE_BITS) for b in bits]
    near = lambda i, j: (bits[i] != bits[j])[: simhash.CHECK].sum() <= simhash.WIDE_RADIUS and (blocks[i] == blocks[j]).all(axis=1).any()
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near(i, j):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {}
    for (d, _), k in zip(rows, label):
        least[k] = min([x for x in (least.get(k), d) if x is not None], default=None)
    return [least[k] for k in label]


def test_one_of_each_group_stays(spark, monkeypatch):
    rows = near_rows() + near_copies(6)
    docs = documents(spark, rows, clash=True)
    want = sorted({c for c in brute_wide(rows) if c is not None})
    for most, hot in ((500_000, 500), (0, 2)):  # with and without broadcasts; with many and with few hot keys
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        monkeypatch.setattr(common, "HOT", hot)
        kept = simhash.one_of_each(docs)
        got = [r.doc_id for r in kept.collect()]
        assert kept.columns == docs.columns and sorted(x for x in got if x is not None) == want and got.count(None) == 1
    classes = {r.doc_id: r.component_id for r in simhash.wide_classes(docs, tile=2).collect()}  # many tiles a bucket
    assert {d: c for (d, _), c in zip(rows, brute_wide(rows)) if d is not None} == {d: c for d, c in classes.items() if d is not None}
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_near_copies_are_caught_and_others_stay(spark):
    rng = random.Random(10)
    rows = near_copies() + [(k, words(rng, rng.randint(20, 200))) for k in range(300)]
    shingles = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    alike = [d for d, t in rows if d >= 1000 and d % 10 and len(shingles(t) & (o := shingles(dict(rows)[d - d % 10]))) >= 0.8 * len(shingles(t) | o)]
    kept = {r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()}
    assert set(range(300)) <= kept and {1000 + 10 * g for g in range(40)} <= kept
    assert len(alike) > 100 and len(kept & set(alike)) <= 0.01 * len(alike)
    assert sum(d >= 1000 and d % 10 > 0 for d in kept) <= 0.1 * 160  # four copies each, the last of Jaccard 0.74


def test_repeated_ids_with_other_texts_stay(spark):
    rng = random.Random(11)
    a, b, c = (words(rng, 50) for _ in range(3))
    rows = [(2, a), (5, a), (5, b), (6, c), (6, c), (7, c), (None, a), (None, c)]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(documents(spark, rows, clash=True)).collect())
    assert kept == sorted([(2, a), (5, b), (6, c), (0, a), (0, c)])


def test_chain_is_one_class(spark):
    prints = [(1 << (2 * k)) - 1 for k in range(20)]  # neighbours differ in two bits
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    for tile in (1, 3, 1024):
        roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, tile=tile)).collect()}
        assert set(roots) == set(prints) and len(set(roots.values())) == 1


def test_components_equal_union_find(spark):
    rng = random.Random(12)
    order = rng.sample(range(3000), 3000)
    edges = [(order[i], order[i + 1]) for i in range(0, 900)] + [(order[i], order[i + 1]) for i in range(1000, 1020)]
    edges += [(order[2000], order[i]) for i in range(2001, 2500)] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(400)] + [(7, 7), (8, 9), (8, 9)]
    up = list(range(3000))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    want = {x: top(x) for e in edges if e[0] != e[1] for x in e}
    got = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_one_partition_take_no_rounds(spark, monkeypatch):
    rng = random.Random(13)
    order = rng.sample(range(400), 400)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(390) if i % 13], "a long, b long").repartition(7)
    want = sorted(map(tuple, simhash.components(edges).collect()))
    written, write = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, label, *a: written.append(label) or write(df, label, *a))
    assert sorted(map(tuple, simhash.components(edges, 400).collect())) == want and len({r for _, r in want}) == 30
    assert written == ["links"]  # each round is jobs, tasks and files that the driver keeps account of
    monkeypatch.setattr(simhash, "files", lambda rows: 3)
    assert sorted(map(tuple, simhash.components(edges, 400).collect())) == want and len(written) > 2


def test_large_and_small_tiles_agree():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base[:9] ^ np.uint64(1 << int(k)) for k in rng.integers(0, 64, 12)]]))
    one, two = simhash._Gathered(), simhash._Gathered()
    simhash._small_tiles([x], np.array([0]), np.array([len(x)]), 3, one)
    simhash._large_tile([x], np.ones(len(x), bool), 3, two)
    assert [c.tolist() for c in one.forest()] == [c.tolist() for c in two.forest()] and len(one.forest()[0]) > 50


def brute_top(rows, k=10):
    ok = [(r, i, np.floor(1024 * np.array(v, float))) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for r, q, a in ok:
        if q % 100 == 0:
            scores = [(-sum(int(x) * int(y) for x, y in zip(a, b)), c) for t, c, b in ok if t != r]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scores)[:k])]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS query_id", "4 AS n", "5 AS g")


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(450)]  # many ties
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")]), (504, [float("inf")]), (None, [1.0]), (600, [1.0, 2.0])]
    rows += [(100, [0.5, 0.5, 0.5, 0.5]), (100, [0.5, 0.5, 0.5, 0.5]), (7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0])]  # repeated ids
    assert sorted(map(tuple, topk.op7(vectors(spark, rows)).collect())) == sorted(brute_top(rows))


def test_top_k_few_rows_large_values_and_empty(spark):
    rows = [(0, [1e5, -3.0]), (1, [1e5, 1e5]), (100, [2e5, 5.0])]
    assert sorted(map(tuple, topk.op7(vectors(spark, rows)).collect())) == sorted(brute_top(rows))
    assert topk.op7(vectors(spark, [])).count() == 0 and topk.op7(vectors(spark, [(1, [1.0])])).count() == 0
    assert topk.op7(vectors(spark, [(0, [1.0])])).count() == 0


def test_tiles_and_shards_meet_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i if i % 3 else 100 * i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    monkeypatch.setattr(topk, "CELLS", 7)
    monkeypatch.setattr(topk, "FAN", 2)
    tile, shard = topk.TILE, topk.SHARD
    assert sorted(map(tuple, topk.op7(vectors(spark, rows).repartition(6)).collect())) == sorted(brute_top(rows))
    assert (tile, shard) == (512, 4096)
    for tiles, shards, cells in ((1, 1, 8), (3, 1000, 64), (1000, 3, 64), (50, 50, 64), (1, 9, 1)):
        r, c = topk.grid(tiles, shards, cells)
        assert 1 <= r <= max(1, tiles) and 1 <= c <= max(1, shards) and r * c <= max(1, cells)


def test_scores_stay_exact_beyond_doubles():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**15, 3.0]])
    assert topk._scores(q, c).tolist() == [[2**55 + 3]]
    assert topk._scores(np.array([[2.0**50]]), np.array([[2.0**50]])).tolist() == [[2**63 - 1]]

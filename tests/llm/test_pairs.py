"""Components, near duplicates and nearest vectors against brute force."""

import os
import random

import numpy as np
import pytest

from codeweir.llm import forest, neardup
from codeweir.llm.components import components


def groups_of(edges):
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in groups_of([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_estimates_similarity():
    h, seeds = neardup.WordHashes(), neardup._seeds(192)
    a = neardup.features(" ".join(f"w{i}" for i in range(300)), h)
    b = neardup.features(" ".join(f"w{i}" for i in range(60, 360)), h)
    sa, sb = neardup.sketch(a, seeds), neardup.sketch(b, seeds)
    assert abs(neardup.estimate(sa[None], sb[None], np.array([len(a)]), np.array([len(b)]))[0] - neardup.similarity(a, b)) < 0.15
    assert (np.maximum(sa, sb) == neardup.sketch(np.union1d(a, b), seeds)).all()  # registers merge
    assert len(neardup.features(None, h)) == len(neardup.features("two words", h)) == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    texts = {}
    for g in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        for v in range(rng.randint(1, 4)):
            own = list(words)
            for _ in range(v * 2):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            texts[f"g{g}v{v}"] = " ".join(own)
    texts |= {"null": None, "empty": "", "short": "a b", "copy1": texts["g0v0"], "copy2": texts["g0v0"].upper()}
    rows = [(k, t, 1) for k, t in texts.items()]
    df = spark.createDataFrame(rows + rows[:5], "id string, code string, links int")
    found = {(r["id_a"], r["id_b"]) for r in neardup.pairs_in_groups(neardup.near_duplicates(df)).collect()}
    h = neardup.WordHashes()
    sets = {k: neardup.features(t, h) for k, t in texts.items()}
    keys = [k for k in sets if len(sets[k])]
    label = groups_of([(a, b) for a in keys for b in keys if neardup.similarity(sets[a], sets[b]) >= 0.6])
    assert found == {(a, b) for a in keys for b in keys if a < b and label[a] == label[b]}
    assert neardup.pairs_in_groups(neardup.near_duplicates(df.limit(0))).count() == 0


def test_hot_buckets_are_divided(spark, monkeypatch):
    """Unlike records with a long part in common share buckets; the number of rounds does not follow theirs."""
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(f"d{i}", common + " " + " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(60))) for i in range(900)]
    rows += [(f"e{i}", rows[i][1].replace(" w", " v", 1)) for i in range(0, 900, 50)]
    df = spark.createDataFrame(rows, "id string, code string")
    rounds, verified, divided = [], neardup._verified, neardup._divided
    split = []
    monkeypatch.setattr(neardup, "_verified", lambda *a: rounds.append(1) or verified(*a))
    monkeypatch.setattr(neardup, "_divided", lambda hot, *a: split.append(hot.count()) or divided(hot, *a))
    pairs = {tuple(r) for r in neardup.pairs_in_groups(neardup.near_duplicates(df, many=4)).collect()}
    assert pairs == {(f"d{i}", f"e{i}") for i in range(0, 900, 50)}
    assert len(rounds) <= 2 * neardup.DEEPEST + 2 and sum(split) > 0


def test_hot_buckets_lose_no_pair(spark):
    """One band only, so that a pair has no other bucket than a hot one: every pair that shares it is found."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(60)]
    texts = {f"d{i:03}": [*common, *(f"w{rng.randint(0, 10**7)}" for _ in range(60 if i % 2 else 24))] for i in range(200)}
    texts |= {f"e{i:03}": [*texts[f"d{i:03}"][:-6], *(f"x{i}y{j}" for j in range(6 + i % 9))] for i in range(0, 200, 4)}
    texts |= {f"f{i}": [*common[:50], *(f"z{rng.randint(0, 9)}" for _ in range(40))] for i in range(40)}
    rows = [(k, " ".join(v)) for k, v in texts.items()]
    h, seeds = neardup.WordHashes(), neardup._seeds(1)
    sets = {k: neardup.features(t, h) for k, t in rows}
    band = {k: neardup.sketch(f, seeds)[0] for k, f in sets.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and band[a] == band[b] and neardup.similarity(sets[a], sets[b]) >= 0.6]
    label = groups_of(alike)
    want = {(a, b) for a in label for b in label if a < b and label[a] == label[b]}
    assert len(want) > 20
    df = spark.createDataFrame(rows, "id string, code string")
    pairs = {tuple(r) for r in neardup.pairs_in_groups(neardup.near_duplicates(df, bands=1, rows=1, many=2)).collect()}
    assert pairs == want


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50] = x[51] * 2
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, None)] + rows[:3]
    rows += [(1000 + i, rows[10][1]) for i in range(30)]  # a hot direction
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = {}
    for r in forest.nearest(df, size=8, k=5, digits=(4, 4)).collect():
        near.setdefault(r["vec_id_a"], []).append(r["vec_id_b"])
    usable = {i: np.array(v, float) for i, v in rows if v and len(v) == 8 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(usable)
    u = np.stack([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    s = np.round(u @ u.T, 5)
    hits = 0
    for n, i in enumerate(ids):
        assert len(near[i]) == 5 and i not in near[i]
        floor = sorted((s[n, m] for m in range(len(ids)) if m != n), reverse=True)[4]
        hits += sum(s[n, ids.index(j)] >= floor for j in near[i])
    assert hits / (5 * len(ids)) > 0.95 and set(near) == set(ids)
    assert sorted(near[1000]) == [10, 1001, 1002, 1003, 1004]
    assert forest.nearest(df.limit(0), size=8).count() == 0


def test_ascent_counts_whole_nodes():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 64, (500, 3))
    low = np.arange(64)
    tries = [forest.Trie(low, low + 1, np.concatenate(([0], np.cumsum(np.bincount(codes[:, t], minlength=64))))) for t in range(3)]
    for reach in (1, 20, 200, 1500, 1501):
        depth = forest.ascend(codes, tries, 6, reach)
        held = lambda i, d: sum((codes[:, t] >> (6 - d) == codes[i, t] >> (6 - d)).sum() for t in range(3))
        for i in range(0, 500, 50):
            assert depth[i] == max([d for d in range(7) if held(i, d) >= reach], default=0)


def clustered(n, rng):
    centres = rng.standard_normal((8, 16))
    return centres[rng.choice(8, n, p=[0.37] + [0.09] * 7)] + 0.3 * rng.standard_normal((n, 16))


def test_nearest_does_not_depend_on_partitions_or_blocks(spark):
    """A third of the rows is one cluster; recall is measured against brute force."""
    x = clustered(3000, np.random.default_rng(9))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = []
    for partitions, block in ((8, 16384), (200, 16384), (2000, 16384), (8, 100)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        found.append({(r[0], r[1], r[3]) for r in forest.nearest(df, size=16, k=10, block=block).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] == found[3]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(a, b) for a in range(3000) for b in np.argsort(-s[a])[:10]}
    assert len({(a, b) for a, b, _ in found[0]} & true) / len(true) >= 0.95


def test_nearest_on_a_table(spark):
    path = "/root/testdata/sf0.01/symbol_vectors.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    df = spark.read.parquet(path)
    near = {}
    for r in forest.nearest(df).collect():
        near.setdefault(r["vec_id_a"], set()).add(r["vec_id_b"])
    rows = forest.usable(df, "vec_id", "embedding", 64).dropDuplicates(["k"]).collect()
    u = np.array([r["v"] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = [len(near[r["k"]] & {rows[j]["k"] for j in np.argsort(-s[i])[:10]}) for i, r in enumerate(rows)]
    assert sum(hits) / (10 * len(rows)) >= 0.95


def test_nearest_of_few_rows_on_many_partitions(spark):
    x = np.random.default_rng(2).standard_normal((11, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        near = forest.nearest(df, size=8, k=10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["vec_id_a"], r["vec_id_b"]) for r in near} == {(a, b) for a in range(11) for b in range(11) if a != b}

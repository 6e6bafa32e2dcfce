"""Embedding near-dedup against brute force."""

import math

import numpy as np

from tidemark.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, copies int, v string"


def brute(rows, threshold=0.98):
    n, root = len(rows), list(range(len(rows)))
    ok, unit = [], []
    for _, v, label, *_ in rows:
        good = label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(good)
        unit.append(np.array(v, dtype=np.float32).astype(np.float64) / np.linalg.norm(np.array(v, dtype=np.float32).astype(np.float64)) if good else None)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted((r[0], links[i], least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(rows))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(150):
        vectors.append(rng.standard_normal(16))
    for k in (2, 3, 60):  # groups of near copies
        center = rng.standard_normal(16)
        vectors += [center + rng.standard_normal(16) * 0.12 for _ in range(k)]
    vectors += [vectors[0]] * 5 + [vectors[1] * 7]
    rows = [(i, [float(x) for x in np.float32(v)], int(rng.integers(0, 2)) if i < 150 else 1, 1, "clash") for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 1, 1, ""), (n + 1, [0.0] * 16, 1, 1, ""), (n + 2, [1.0, float("nan")], 1, 1, ""), (n + 3, [1.0, None], 1, 1, ""), (n + 4, rows[0][1], None, 1, ""), (n + 5, [float("inf")] * 16, 1, 1, ""), (n + 6, [1.0, 2.0], 1, 1, ""), (n + 7, [2.0, 4.0], 1, 1, ""), (n + 7, [], 1, 1, "")]
    got, recall = nn_descent.search(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert recall >= 0.99
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(8)
    rows = [(i, [float(x) for x in np.float32(center + rng.standard_normal(8) * 0.05)], 0, 1, "") for i in range(120)]
    got, _ = nn_descent.search(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_null_identifiers_and_nothing(spark):
    rows = [(None, [1.0, 0.0], 0, 1, ""), (None, [1.0, 0.0], 0, 1, ""), (5, [1.0, 0.001], 0, 1, "")]
    got, _ = nn_descent.search(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got.collect()) == [(0, 2, 5, False), (0, 2, 5, False), (5, 2, 5, True)]
    assert nn_descent.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def bundles(sizes, seed=5):
    """Bundles of cosine about 0.998 inside and 0.981 across, in 32 dimensions."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    centers, out = [axes[0], axes[0] * 0.983 + axes[1] * math.sqrt(1 - 0.983**2)], []
    for center, k in zip(centers, sizes):
        for _ in range(k):
            noise = rng.standard_normal(30) @ axes[2:]
            out.append(center + noise / np.linalg.norm(noise) * 0.0316)
    return out


def test_links_between_saturated_groups(spark):
    vectors = bundles((30, 30)) + list(np.random.default_rng(6).standard_normal((40, 32)))
    rows = [(i, [float(x) for x in np.float32(v)], 0, 1, "") for i, v in enumerate(vectors)]
    expected = brute(rows)
    assert [r[1] for r in expected[:60]] == [59] * 60
    got, _ = nn_descent.search(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_spaces_that_fall_short_are_compared_in_full(spark, monkeypatch):
    planted = nn_descent._planted
    monkeypatch.setattr(nn_descent, "_planted", lambda nodes, trees: planted(nodes, 1).where("false"))
    for name, value in (("ROUNDS", 0), ("ATTEMPTS", 1), ("AUDIT", 1)):
        monkeypatch.setattr(nn_descent, name, value)
    vectors = bundles((20, 3)) + list(np.random.default_rng(6).standard_normal((20, 32)))
    rows = [(i, [float(x) for x in np.float32(v)], i % 2, 1, "") for i, v in enumerate(vectors)]
    got, recall = nn_descent.search(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert recall == 1.0


def test_audit_is_not_diluted_by_copies(spark, monkeypatch):
    planted = nn_descent._planted
    monkeypatch.setattr(nn_descent, "_planted", lambda nodes, trees: planted(nodes, 1).where("false"))
    monkeypatch.setattr(nn_descent, "ROUNDS", 0)
    monkeypatch.setattr(nn_descent, "ATTEMPTS", 1)
    vectors = [[1.0, 0.0, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0]]
    rows = [(50 * i, v, 0, 1, "") for i, v in enumerate(vectors)] + [(i + 1000, [0.0, 0.0, 1.0, 0.0], 0, 1, "") for i in range(3000)]
    got, recall = nn_descent.search(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect() if r.vec_id < 100) == [(0, 1, 0), (50, 1, 0)]
    assert recall == 1.0


def test_rounds_end_when_lists_stay(spark, monkeypatch):
    rounds, refined = [], nn_descent._refined
    monkeypatch.setattr(nn_descent, "_refined", lambda nodes, lists: rounds.append(1) or refined(nodes, lists))
    vectors = list(np.random.default_rng(8).standard_normal((60, 16)))
    rows = [(i, [float(x) for x in np.float32(v)], 0, 1, "") for i, v in enumerate(vectors + [vectors[0] * 1.0 + 0.001])]
    got, _ = nn_descent.search(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows) and len(rounds) < nn_descent.ROUNDS
    old = spark.createDataFrame([(1, 2, 0.99), (1, 3, 0.5)], "a long, b long, sim double")
    new = spark.createDataFrame([(1, 2, 0.99), (2, 1, 0.99), (1, 4, 0.5)], "a long, b long, sim double")
    assert nn_descent._changed(old, new, 0.98) == 0.5 and nn_descent._changed(old, old, 0.98) == 0.0

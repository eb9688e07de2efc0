"""Links of vectors against brute force."""

import numpy as np

from framewright.llm import neighbours
from framewright.llm.jaccard import Groups


def brute(ids, x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    groups = Groups(len(x))
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        groups.union(int(a), int(b))
    return {i: (int(near[k].sum()) - 1, ids[groups.find(k)]) for k, i in enumerate(ids)}


def test_recall_and_no_false_link(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 24))
    x = np.concatenate([c + rng.standard_normal((k % 9, 24)) * 0.25 for k, c in enumerate(centres)] + [rng.standard_normal((300, 24))])
    x = x.astype(np.float32).astype(np.float64)
    x = np.concatenate([x, np.repeat(x[:1], 50, axis=0)])
    ids = list(range(1, len(x) + 1))
    data = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int")
    want = brute(ids, x, 0.9)
    rows = neighbours.near_duplicates(data, window=16, recall=0.99).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in ids)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    whole = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(data, window=1024).collect()}
    assert whole == want  # one block holds all


def test_unusable_vectors_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, None], 0),
            (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (10, [0.0, 1.0], 0)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, pass int").withColumnsRenamed({"pass": "block"})
    got = sorted(map(tuple, neighbours.near_duplicates(data).collect()))
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 11)])
    assert neighbours.near_duplicates(data.where("1 = 0")).count() == 0


def test_passes_grow_with_the_table():
    few, many = (neighbours.passes_for(n, 0.9, 512, 0.98) for n in (10_000, 1_000_000))
    assert 2 <= few < many and neighbours.passes_for(100, 0.9, 512, 0.98) == 1


def test_large_groups_count_every_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    x = np.concatenate([centre + rng.standard_normal((300, 16)) * 0.1, rng.standard_normal((100, 16))])
    ids = list(range(1, len(x) + 1))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = brute(ids, x, 0.9)
    assert sum(v[0] >= 290 for v in want.values()) >= 250  # many windows of 16
    for tile_rows in (4096, 40):  # the group in one tile, and in eight
        monkeypatch.setattr(neighbours, "TILE_BYTES", tile_rows * 16 * 8, raising=False)
        got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(data, window=16).collect()}
        assert got == want


def test_recall_in_a_crowded_cone(spark):
    rng = np.random.default_rng(5)
    dim, pairs, others = 128, 1000, 5000
    axis = np.eye(dim)[0]

    def across(n):
        r = rng.standard_normal((n, dim))
        r[:, 0] = 0
        return r / np.linalg.norm(r, axis=1, keepdims=True)
    r, turn = across(pairs), across(pairs)
    turn -= (turn * r).sum(axis=1, keepdims=True) * r
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    # Any two in the cone have a cosine of about 0.8, a planted pair 0.905.
    near = 0.525 * r + np.sqrt(1 - 0.525 ** 2) * turn
    cone = np.concatenate([np.sqrt(0.8) * axis + np.sqrt(0.2) * q for q in (r, near)])
    x = np.concatenate([cone, rng.standard_normal((others, dim))])
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v.vec_id: v.component_id for v in neighbours.near_duplicates(data, window=16).collect()}
    met = sum(got[i] == got[i + pairs] for i in range(pairs)) / pairs
    assert met >= 0.98, met

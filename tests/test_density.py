"""Neighbours, the spanning forest and density clusters against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from catalume.operators import density as D
from catalume.operators import similarity_join as J


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(4, 6))
    rows = [c + 0.05 * (1 + k) * draw.normal(size=6) for k, c in enumerate(centres) for _ in range(14)] + list(draw.normal(size=(9, 6)))
    rows += [rows[0], rows[0]]
    return {k * 3 + 1: np.float32(v) for k, v in enumerate(rows)}


def brute_neighbours(points, k):
    unit = {i: v.astype(float) / np.linalg.norm(v.astype(float)) for i, v in points.items()}
    return {a: sorted((round(float(np.sqrt(max(2 - 2 * unit[a] @ unit[b], 0))), 9), b) for b in points if b != a)[:k] for a in points}


def brute_edges(near):
    core = {a: max(d for d, _ in rows) for a, rows in near.items()}
    best = {}
    for a, rows in near.items():
        for d, b in rows:
            key = (min(a, b), max(a, b))
            best[key] = min(best.get(key, 9), d)
    return sorted((max(d, core[a], core[b]), a, b) for (a, b), d in best.items())


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a
        return a != b


def brute_clusters(forest, ids, least_size, n_levels):
    cut = D.levels(min(w for w, *_ in forest), max(w for w, *_ in forest), n_levels)
    sets, branch_of, branches = Sets(), {}, []
    for k, t in enumerate(cut):
        for w, a, b in forest:
            if w <= t:
                sets.join(a, b)
        comps = {}
        for i in ids:
            comps.setdefault(sets.find(i), []).append(i)
        gain, now = 1 / t - (1 / cut[k + 1] if k + 1 < n_levels else 0), {}
        for c, members in comps.items():
            if len(members) >= least_size:
                inside = sorted({id(b): b for i in members if (b := branch_of.get(i)) is not None}.items())
                if len(inside) == 1:
                    own = inside[0][1]
                else:
                    own = {"stable": 0.0, "inner": sum(max(b["stable"], b["inner"]) for _, b in inside)}
                    branches.append(own)
                own["stable"] += len(members) * gain
                own["members"], own["level"], own["comp"] = members, k, c
                now |= dict.fromkeys(members, own)
        branch_of = {**branch_of, **now}
    out = dict.fromkeys(ids, -1)
    for b in sorted(branches, key=lambda b: b["level"]):
        if b["stable"] >= b["inner"]:
            for i in b["members"]:
                out[i] = b["comp"]
    return out


def test_neighbours_and_forest_and_clusters(spark, points, monkeypatch):
    monkeypatch.setattr(J, "PIVOT_ROWS", 12)
    monkeypatch.setattr(D, "CHUNK_ROWS", 7)
    df = spark.createDataFrame([(i, [float(x) for x in v], "n") for i, v in points.items()], "asset_id long, embedding array<float>, kind string").repartition(3)
    near = D.neighbours(df, 4).cache()
    got = {}
    for r in near.collect():
        got.setdefault(r.a, []).append((r.d, r.b))
    want = brute_neighbours(points, 4)
    assert {a: sorted(v) for a, v in got.items()} == want
    edges = D.reachability(near, 4).cache()
    plain = brute_edges(want)
    assert sorted((r.w, r.a, r.b) for r in edges.collect()) == plain
    sets, forest = Sets(), []
    for w, a, b in plain:
        if sets.join(a, b):
            forest.append((w, a, b))
    tree = D.spanning_forest(edges).cache()
    assert sorted((r.w, r.a, r.b) for r in tree.collect()) == forest
    for least, n in ((5, 8), (3, 5)):
        found = {r.asset_id: r.cluster for r in D.clusters(tree, df, least, n).collect()}
        assert found == brute_clusters(forest, sorted(points), least, n)
    assert -1 in found.values() and len(set(found.values())) > 3


def test_map(spark, points):
    rows = [(i, [float(x) for x in v]) for i, v in points.items()] + [(1001, None), (1002, [0.0] * 6)]
    got = D.item_map(spark.createDataFrame(rows, "asset_id long, embedding array<float>"), k=4, n_levels=4, rounds=2).collect()
    assert {r.asset_id for r in got} == set(points) and all(np.isfinite([r.x, r.y]).all() for r in got)
    # Items of one cluster lie closer than items of two.
    at = {r.asset_id: np.array([r.x, r.y]) for r in got}
    of = {r.asset_id: r.cluster for r in got if r.cluster != -1}
    near = [np.linalg.norm(at[a] - at[b]) for a in of for b in of if a < b and of[a] == of[b]]
    far = [np.linalg.norm(at[a] - at[b]) for a in of for b in of if a < b and of[a] != of[b]]
    assert np.mean(near) < np.mean(far)
    assert D.item_map(spark.createDataFrame([], "asset_id long, embedding array<float>")).count() == 0


def test_places_and_least_entries(spark, points, monkeypatch):
    """Places follow the formula without a lambda for each pair of item and sample; least entries are those of a stable sort."""
    draw = np.random.default_rng(5)
    edges = [(a, b) for a in sorted(points)[:-5] for b in sorted(points)[:-5] if a < b and draw.random() < 0.05]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points.items()], "asset_id long, embedding array<float>").repartition(3)
    near = spark.createDataFrame(edges, "a long, b long")
    at = {r.asset_id: np.array([r.x, r.y]) for r in D.coordinates(df, near, rounds=0).collect()}

    def refuse(*_):
        raise AssertionError("a lambda for each pair")

    monkeypatch.setattr(D.F, "transform", refuse)
    got = {r.asset_id: np.array([r.x, r.y]) for r in D.coordinates(df, near, rounds=1, sample=len(points), step=0.3).collect()}
    for i, own in at.items():
        others = [at[b if a == i else a] for a, b in edges if i in (a, b)]
        push = np.mean([(own - s) / (0.1 + ((own - s) ** 2).sum()) for s in at.values()], axis=0)
        assert np.allclose(got[i], own + 0.3 * ((np.mean(others, axis=0) - own if others else 0) + push), atol=1e-9)
    for k in (1, 4, 40):
        d = draw.integers(0, 6, (30, 25)).astype(float)
        d[draw.random(d.shape) < 0.2] = np.inf
        row, column = D._least(d, k)
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert row.tolist() == np.repeat(np.arange(30), want.shape[1]).tolist() and column.tolist() == want.ravel().tolist()


def test_neighbours_are_exact_beyond_a_few_cells(spark, monkeypatch):
    """With many more cells than a vector could look into one by one, and with more copies of a vector than it has neighbours."""
    draw = np.random.default_rng(21)
    rows = list(draw.normal(size=(260, 16)))
    rows += [rows[3]] * 9 + [rows[7]] * 2
    points = {int(i): np.float32(v) for i, v in zip(draw.permutation(1000), rows)}
    monkeypatch.setattr(J, "PIVOT_ROWS", 8)
    monkeypatch.setattr(D, "LEAST_ROWS", 50)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points.items()], "asset_id long, embedding array<float>").repartition(3)
    got = {}
    for r in D.neighbours(df, 4).collect():
        got.setdefault(r.a, []).append((r.d, r.b))
    # Equal vectors are 0 apart.
    exact = {a: sorted((0.0 if (points[a] == points[b]).all() else d, b) for d, b in near) for a, near in brute_neighbours(points, len(points)).items()}
    for a, near in got.items():
        want = exact[a][:4]
        assert [b for _, b in sorted(near)] == [b for _, b in want] and np.allclose([d for d, _ in sorted(near)], [d for d, _ in want], atol=1e-8)
    assert set(got) == set(points)


def test_blocks_of_chunks_meet(monkeypatch):
    """Two blocks by themselves: bounds hold, nothing below them is lost, and few neighbours wait at a time."""
    draw = np.random.default_rng(22)
    monkeypatch.setattr(D, "CHUNK_ROWS", 7)
    monkeypatch.setattr(D, "BOUND_CHUNKS", 2)
    centres = draw.normal(size=(6, 5))
    v = np.concatenate([c + 0.1 * draw.normal(size=(12, 5)) for c in centres])
    v = np.concatenate((v, v[[4, 4, 4, 4, 4, 40]])).astype(np.float32)
    ids, v = draw.permutation(500)[: len(v)].astype(np.int64), D._unit(v.ravel(), len(v))
    d = D._distances(v @ v.T)
    np.fill_diagonal(d, np.inf)
    for most in (1 << 20, 30):
        monkeypatch.setattr(D, "MOST_HITS", most)
        sides = []
        for rows in (np.arange(len(v))[: 40], np.arange(len(v))[40:]):
            order = rows[D._ordered(ids[rows], rows)]
            bounds = D._bounds(v[order], 3)
            assert all(b >= np.sort(d[r][order])[2] - 1e-7 for r, b in zip(order, bounds))
            sides.append((ids[order], v[order], bounds))
        found = {}
        for x, y, same in ((0, 0, True), (0, 1, False), (1, 1, True)):
            for own, other, far in D._met(sides[x], sides[y], same, 3):
                for a, b, e in zip(own.tolist(), other.tolist(), far.tolist()):
                    found.setdefault(a, []).append((e, b))
        assert {a: [b for _, b in sorted(f)[:3]] for a, f in found.items()} == {int(i): ids[np.lexsort((ids, d[r]))[:3]].tolist() for r, i in enumerate(ids)}
    first, parts, place, n = D._blocked(D._unit(draw.normal(size=30), 10), {0: 5, 1: 30, 2: 4, 5: 8, 9: 1}, 10)
    assert parts[1] == 3 and sorted(place) == list(range(10)) and n == len({int(first[c]) + k for c in range(10) for k in range(parts[c])})
    assert D._unit(draw.normal(size=6), 2).shape == (2, 3)

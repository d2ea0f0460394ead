"""Embedding links against all pairs."""

import numpy as np
import pytest

from quillmill.llm import components as cc
from quillmill.llm import embedding_dedup as ed


def brute(rows, cosine=0.95):
    good = [(i, np.asarray(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(good)
    links, parent = [0] * n, list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = good[i][1], good[j][1]
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i in range(n):
        least[top(i)] = min(least.get(top(i), good[i][0]), good[i][0])
    out = {good[i][0]: (links[i], least[top(i)]) for i in range(n)}
    return sorted((i, *out.get(i, (0, i)), out.get(i, (0, i))[1] == i) for i, _ in rows)


def make(n, dim, groups, noise, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for g in range(groups):
        size = int(rng.integers(2, 9)) if g else n // 3
        base = rng.normal(size=dim)
        at = rng.choice(n, size, replace=False)
        x[at] = base + rng.normal(size=(size, dim)) * noise * np.linalg.norm(base) / np.sqrt(dim)
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("noise", [0.05, 0.15, 0.2])
def test_links_and_components(spark, noise):
    rows = make(400, 32, 12, noise)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got, want = sorted(map(tuple, ed.links(df).collect())), brute(rows)
    total = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.99 * total
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    if noise < 0.2:
        assert got == want


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    monkeypatch.setattr(ed, "TILE", 8)
    rows = make(300, 16, 6, 0.05)
    rows += [(i, rows[0][1]) for i in range(300, 340)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ed.links(df).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [1e-300, 2e-300]), (11, [1.0, 2.0]), (12, [-1.0, -2.0])]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, node string, n int")
    got = sorted(map(tuple, ed.links(df).collect()))
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 3, 7, True), (8, 3, 7, False), (9, 0, 9, True), (10, 3, 7, False), (11, 3, 7, False), (12, 0, 12, True)]
    assert ed.links(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ed.links(twice).collect()), key=str) == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, 1, False)]


def test_plan_grows_with_the_logarithm():
    assert ed.plan(10)[0] == ed.LEAST_HASHES and ed.plan(10**9)[0] > ed.plan(10**6)[0]
    assert abs(ed.agreement(0.3162) - 0.874) < 0.002


def test_recall_just_above_the_threshold(spark):
    """2,000 planted pairs of cosine 0.95 to 0.96 among 6,000 vectors; nothing else links."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base, other = unit(rng.normal(size=(2000, 64))), rng.normal(size=(2000, 64))
    other = unit(other - (other * base).sum(axis=1, keepdims=True) * base)
    c = rng.uniform(0.9501, 0.96, 2000)[:, None]
    rows = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other, rng.normal(size=(2000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = ed.links(df).toPandas().set_index("vec_id")
    found = (got.component_id[2000:4000].to_numpy() == np.arange(2000)).mean()
    assert found >= 0.995 and (got.n_links[4000:] == 0).all()


def test_tables_of_a_run_are_deleted(spark, tmp_path, monkeypatch):
    from quillmill.llm import common

    rows = make(100, 16, 4, 0.05)
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    with common.scratch() as s:
        ed.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
        assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["told"] and len(s.made) == 1
    assert not list(tmp_path.iterdir())


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (300, 2))] + [(7, 7)]
    got = dict(map(tuple, cc.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {v: v for e in edges for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: top(v) for v in linked}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Metrics and clusters over all pairs, against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodemill.operators import metrics, spatial

ROWS = "label int, id long, v array<double>"


def vectors():
    rng = np.random.default_rng(4)
    rows = [(int(i % 3), i, (rng.normal(size=5) + 1e3 * (i % 3)).tolist()) for i in range(150)]
    rows += [(1, 200 + i, rows[1][2]) for i in range(12)]  # copies
    rows += [(0, 300, None), (0, 301, [1.0, None, 0.0, 0.0, 0.0]), (0, 302, [1e200, 0.0, 0.0, 0.0, 0.0]), (2, 303, [1e3, 1e3])]
    return rows + [(7, 400, [0.0] * 5), (8, 401, None), (8, 402, [1.0] * 5), (None, 403, [1.0] * 5), (2, None, rows[2][2])]


def distance(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) if max(map(abs, a + b)) < 1e150 else (0.0 if a == b else math.inf)


def test_kernel_mean(spark, monkeypatch):
    monkeypatch.setattr(metrics._block_pairs, "__defaults__", ((), 40))  # many blocks
    rows = vectors()
    df = spark.createDataFrame(rows, ROWS)
    for p, q in ((0, 0), (1, 1), (0, 2), (1, 8), (5, 0)):
        d = [distance(a[2], b[2]) for a in rows if a[0] == p for b in rows if b[0] == q]
        want = [math.exp(-x * x / 2) for x in d if x is not None]
        got = metrics.kernel_mean(df.where(f"label = {p}"), df.where(f"label = {q}")).first()["m"]
        assert (got is None) == (not want) and (not want or abs(got - sum(want) / len(want)) < 1e-9)


def test_nearest_mean(spark, monkeypatch):
    monkeypatch.setattr(metrics._block_pairs, "__defaults__", ((), 40))
    rows = vectors() + [(0, 500, [0.5] * 5), (0, 500, [0.6] * 5), (1, 501, [1e3] * 5), (2, 501, [2e3] * 5)]  # ids that are no keys
    want = {}
    for label, i, v in rows:
        found = [(distance(v, b[2]), b[1]) for b in rows if None not in (i, label, b[1]) and b[0] == label and b[1] != i]
        if found:
            want.setdefault(i, []).extend((label, *x) for x in found)
    mean = {}
    for i, found in want.items():
        found.sort(key=lambda x: (x[1] is None, x[1] or 0.0, x[2]))
        for label in {x[0] for x in found[:8]}:
            d = [x[1] for x in found[:8] if x[0] == label and x[1] is not None]
            mean[label, i] = sum(d) / len(d) if d else None
    got = {(r["label"], r["id"]): r["d"] for r in metrics.nearest_mean(spark.createDataFrame(rows, ROWS), 8).collect()}
    assert got.keys() == mean.keys()
    assert all(d == mean[k] or abs(d - mean[k]) <= 1e-12 * mean[k] for k, d in got.items())


def brute_clusters(rows, radius, least):
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= radius
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    label = np.array([r[0] if c else 10**9 for r, c in zip(rows, core)])
    while True:
        low = np.where(near & core[:, None] & core, label, 10**9).min(1)
        if (low == label)[core].all():
            break
        label = np.where(core, low, label)
    border = np.where(near & core, label, 10**9).min(1)
    return {r[0]: int(label[i] if core[i] else -1 if border[i] == 10**9 else border[i]) for i, r in enumerate(rows)}


def test_density_clusters(spark, monkeypatch):
    monkeypatch.setattr(spatial, "point_pairs", None)  # pairs are not made
    rng = np.random.default_rng(8)
    for n, tile, sizes in ((2, 16, (300, 40.0)), (2, 3, (500, 30.0)), (3, 4, (400, 14.0)), (1, 5, (200, 300.0))):
        monkeypatch.setattr(spatial, "TILE", tile)
        flat = rng.uniform(-sizes[1], sizes[1], (sizes[0], n)).round(1).tolist() + rng.normal(5, 1, (60, n)).tolist() + np.round(rng.normal(-6, 3, (60, n))).tolist()
        flat += [[None] + [0.0] * (n - 1), [math.nan] * n, [math.inf] * n]
        ids = rng.permutation(len(flat)).tolist()
        rows = [(i, *v) for i, v in zip(ids, flat)]
        axes = ["x", "y", "z"][:n]
        df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{a} double" for a in axes))
        for radius, least in ((3.0, 4), (1.0, 2)) if n == 2 else ((3.0, 4),):
            got = {r["id"]: r["cluster"] for r in spatial.density_clusters(df, "id", axes, radius, least).collect()}
            want = brute_clusters(rows, radius, least)
            assert got == want and len(set(want.values())) > 3
    one = spark.createDataFrame([(5, 0.0), (7, None)], "id long, x double")
    assert {tuple(r) for r in spatial.density_clusters(one, "id", ["x"], 1.0, 1).collect()} == {(5, 5), (7, 7)}
    assert spatial.density_clusters(one.where("id < 0"), "id", ["x"], 1.0, 1).count() == 0
    dense = spark.range(200_000).select("id", (F.col("id") % 977 / 1000.0).alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    assert [tuple(r) for r in spatial.density_clusters(dense, "id", ["x", "y"], 1.5, 4).groupBy("cluster").count().collect()] == [(0, 200_000)]

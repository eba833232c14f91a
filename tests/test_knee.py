"""Knees of planted curves, nearest neighbours in blocks against all pairs."""

import numpy as np

from voxelia.operators import knee
from voxelia.operators import vector as V


def test_planted_histogram(spark):
    """Values that fall off exponentially up to 1000: the knee lies where they have become rare."""
    x = [float(-120 * np.log(1 - k / 20000)) for k in range(20000)]
    rows = [("fall", v) for v in x if v < 1000] + [("fall", 1000.0), ("fall", None), ("fall", float("nan"))] + [("flat", float(k)) for k in range(1000)] + [("one", 5.0)] * 3
    curve = knee.smoothed_histogram(spark.createDataFrame(rows, "g string, v double"), "g")
    found = {r.g: r.knee for r in knee.knees(curve, "g").collect()}
    assert 200 < found["fall"] < 450 and "one" not in found
    c = sorted((r.bin, r.edge, r.s) for r in curve.where("g = 'fall'").collect())
    n, edges = np.histogram([v for g, v in rows if g == "fall" and v is not None and not np.isnan(v)], bins=100)
    w = np.exp(-np.arange(-12, 13) ** 2 / 18)
    wide = np.pad(n.astype(float), 12, mode="symmetric")
    assert np.allclose([x[2] for x in c], [(wide[k : k + 25] * w).sum() / w.sum() for k in range(100)]) and np.allclose([x[1] for x in c], edges[1:])


def test_knee_of_a_broken_line(spark):
    """A steep line that turns into a shallow one at bin 20: that is the knee; a straight line and a constant have none."""
    rows = [("bent", k, float(k), 100.0 - 4.5 * min(k, 20) - 0.1 * max(k - 20, 0)) for k in range(100)] + [("straight", k, float(k), 100.0 - k) for k in range(100)] + [("constant", k, float(k), 3.0) for k in range(100)]
    found = {r.g: r.knee for r in knee.knees(spark.createDataFrame(rows, "g string, bin int, edge double, s double"), "g").collect()}
    assert found == {"bent": 20.0, "straight": None, "constant": None}


def test_nearest_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8))
    x[100:120] = x[:20]  # equal vectors: the smaller id first
    rows = [(i, i % 3, [float(v) for v in a]) for i, a in enumerate(x)] + [(1000, 1, None)]
    emb = V.unit(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"))
    monkeypatch.setattr(V, "BASE_BLOCK", 64)
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    got = {}
    for n in V.nearest(emb.where("vec_id % 10 = 0"), emb, 7).collect():
        got.setdefault(n.q, []).append((n["rank"], n.id, n.q_label, n.label))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 10):
        sim = np.round(u @ u[q], 12)
        best = sorted(range(300), key=lambda i: (-sim[i], i))[:7]
        assert sorted(got[q]) == [(k + 1, i, q % 3, i % 3) for k, i in enumerate(best)]
    assert 1000 not in got and len(got) == 30
    assert V.nearest(emb.limit(0), emb, 3).count() == 0 and V.nearest(emb.where("vec_id = 0"), emb.limit(0), 3).count() == 0

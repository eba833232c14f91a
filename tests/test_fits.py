"""Fitted models against plain forms: mean shift, assignments, coherent drift, cubic ridge."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from voxelia.operators import matching, modes, polynomial


def plain_shift(values, quantile=0.3):
    """Mean shift of single values, one seed after another."""
    x = np.sort(np.asarray(values, float))
    width = np.mean([np.sort(np.abs(x - v))[max(1, int(len(x) * quantile)) - 1] for v in x])
    ends = {}
    for v in x:
        place = v
        for _ in range(301):
            inside = x[(x >= place - width) & (x <= place + width)]
            if not len(inside):
                break
            before, place = place, inside.mean()
            if abs(place - before) <= 1e-3 * width:
                break
        ends[place] = max(len(inside), ends.get(place, 0))
    stay = []
    for p in sorted(ends, key=lambda p: (-ends[p], -p)):
        if all(abs(p - q) > width for q in stay):
            stay.append(p)
    which = np.abs(x[:, None] - np.array(stay)[None, :]).argmin(1)
    return [(k, c, np.abs(x[which == k] - c).std(), int((which == k).sum())) for k, c in enumerate(stay)]


def fit(spark, rows, resolution):
    frame = spark.createDataFrame([(g, v, "x") for g, v in rows], "g string, v double, label string")
    return modes.mean_shift(modes.histogram(frame, resolution, "g"), resolution, "g")


def test_two_blobs(spark):
    """100 values, the last 50 moved by 2: two modes, and every value is likelier in its own half's."""
    np.random.seed(555)
    x = np.random.rand(100)
    x[50:] += 2
    r = random.Random(4)
    groups = {"two": list(map(float, x)), "one": [5.0] * 40, "single": [3.25], "three": [r.gauss(m, 0.4) for m in (0, 3, 9) for _ in range(60)], None: [1.0, 1.5, 7.0]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("two", None), ("two", float("nan")), ("nothing", None)]
    got = fit(spark, rows, 1e-6).collect()
    for g, own in groups.items():
        found = sorted((r.label, r.centre, r.deviation, r.n) for r in got if r.g == g)
        wanted = plain_shift(own)
        assert [f[0] for f in found] == [w[0] for w in wanted] and [f[3] for f in found] == [w[3] for w in wanted]
        assert np.allclose([f[1:3] for f in found], [w[1:3] for w in wanted], atol=1e-5)
    assert "nothing" not in {r.g for r in got} and len([r for r in got if r.g == "two"]) == 2
    frame = spark.createDataFrame([("two", float(v)) for v in x], "g string, v double")
    labels = modes.assigned(frame, fit(spark, rows, 1e-6), "g").collect()
    low = {r.label for r in labels if r.v < 1.5}
    assert len(low) == 1 and low.isdisjoint({r.label for r in labels if r.v > 1.5}) and all(0 < r.membership <= 1 for r in labels)
    assert fit(spark, [], 1.0).count() == 0


def test_histogram_that_is_too_fine(spark, monkeypatch):
    monkeypatch.setattr(modes, "MOST_BINS", 10)  # goes to the tasks with the function
    with pytest.raises(Exception, match="coarser"):
        fit(spark, [("a", float(k)) for k in range(50)], 1.0).collect()


def test_second_level(spark):
    r = random.Random(5)
    own = [r.gauss(0, 0.05) for _ in range(100)] + [r.gauss(2, 0.05) for _ in range(80)] + [r.gauss(20, 0.1) for _ in range(150)]
    frame = spark.createDataFrame([("a", v) for v in own], "g string, v double")
    first = modes.mean_shift(modes.histogram(frame, 1e-4, "g"), 1e-4, "g")
    subs = modes.second_level(frame, first, 1e-4, "g")
    scored = pd.DataFrame([r.asDict() for r in modes.assigned(frame, first, "g").collect()])
    for label, part in scored.groupby("label"):
        wanted = plain_shift(np.round(part.membership / 1e-4) * 1e-4)
        found = sorted((x.sub, x.centre, x.n) for x in subs.collect() if x.label == label)
        assert [f[2] for f in found] == [w[3] for w in wanted] and np.allclose([f[1] for f in found], [w[1] for w in wanted], atol=1e-4)
    full = modes.full_labels(frame, first, subs, "g").collect()
    sizes = {x.label: 0 for x in subs.collect()}
    for x in subs.collect():
        sizes[x.label] += 1
    assert all(x.full == x.sub + sum(n for k, n in sizes.items() if k < x.label) for x in full) and len(full) == len(own)


def test_least_cost():
    r = np.random.default_rng(1)
    for t in range(200):
        n = int(r.integers(1, 8))
        m = n + int(r.integers(0, 2))
        c = r.random((n, m)) if t % 2 else r.integers(0, 4, (n, m)).astype(float)
        got = matching.least_cost(c)
        assert len(set(got)) == n
        assert abs(c[np.arange(n), got].sum() - min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))) < 1e-9
    x, y = np.sort(r.random(300)), np.sort(r.random(300))
    c = np.abs(x[:, None] - r.permutation(y)[None, :])
    assert abs(c[np.arange(300), matching.least_cost(c)].sum() - np.abs(x - y).sum()) < 1e-9  # on a line the order is the best


POINTS = "k string, id long, c0 double, c1 double, c2 double, d string"


def test_matched(spark):
    base = [(0.0, 0.0, 0.0), (1.0, 2.0, 3.0), (4.0, 1.0, 0.0)]
    order = [1, 2, 0]
    rows = {"perturbed": [tuple(v + 0.1 for v in base[i]) for i in order], "extra": [(90.0, 90.0, 90.0), *[base[i] for i in order]], "fewer": [base[2]], "none": [(None, 1.0, 1.0)]}
    t = spark.createDataFrame([(k, i, *p, "x") for k in [*rows, "alone"] for i, p in enumerate(base)], POINTS)
    s = spark.createDataFrame([(k, 10 + i, *p, "x") for k, own in rows.items() for i, p in enumerate(own)] + [("other", 1, 0.0, 0.0, 0.0, "x")], POINTS)
    got = {}
    for r in matching.matched(t, s, "k").collect():
        got.setdefault(r.k, []).append((r.target, r.source))
    assert {k: sorted(v) for k, v in got.items()} == {"perturbed": [(0, 12), (1, 10), (2, 11)], "extra": [(0, 13), (1, 11), (2, 12)], "fewer": [(2, 10)]}
    same = matching.matched(t, t.withColumn("id", t.id + 0), "k").collect()  # both sides of one origin
    assert len(same) == 15 and all(r.target == r.source and r.d == 0 for r in same)


def test_refused_sizes(monkeypatch):
    monkeypatch.setattr(matching, "MOST_TARGETS", 3)
    with pytest.raises(ValueError, match="sample"):
        matching.checked(2, 4)


def test_five_warped_points(spark):
    """Five points in a unit cube, moved by up to 0.1 and shuffled, come back in their order."""
    r = np.random.default_rng(555)
    x = r.random((5, 3))
    order = r.permutation(5)
    y = (x + 0.1 * r.random((5, 3)))[order]
    for alpha, beta in ((0.05, 30.0), (2.0, 2.0)):
        moved = matching.drift(x, y, alpha, beta, 1000, 1e-6, 300)
        assert list(matching.distances(moved, x).argmin(1)) == list(order)
    t = spark.createDataFrame([("a", i, *map(float, p), "x") for i, p in enumerate(x)], POINTS)
    s = spark.createDataFrame([("a", i, *map(float, p), "x") for i, p in enumerate(y)] + [("b", 7, 1.0, 2.0, 3.0, "x")], POINTS)
    got = {(r.k, r.source): (r.c0, r.c1, r.c2) for r in matching.drifted(t, s, "k").collect()}
    assert got["b", 7] == (1.0, 2.0, 3.0) and len(got) == 6
    assert np.allclose([got["a", i] for i in range(5)], matching.drift(x, y, 0.05, 30.0, 1000, 1e-5, 300))


def test_drift_in_blocks_is_the_same(monkeypatch):
    r = np.random.default_rng(3)
    x = r.uniform(0, 40, (300, 3))
    y = x[:200] + np.stack([np.sin(x[:200, 1] / 15), np.cos(x[:200, 2] / 20), 0.02 * x[:200, 0]], 1)
    whole = matching.drift(x, y, 0.05, 30.0, 1000, 1e-5, 300)
    monkeypatch.setattr(matching, "BLOCK_CELLS", 1000)
    assert np.allclose(matching.drift(x, y, 0.05, 30.0, 1000, 1e-5, 300), whole, atol=1e-6)
    assert (matching.distances(whole, x).argmin(1) == np.arange(200)).mean() > 0.97  # a third of the targets have no source


def plain_ridge(t, s, alpha):
    x = np.array([[math.prod(v**n for v, n in zip(p, e, strict=True)) for e in polynomial.TERMS] for p in t])
    a, b = x - x.mean(0), s - s.mean(0)
    w = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ b)
    return np.vstack([s.mean(0) - x.mean(0) @ w, w]).T, x


@pytest.mark.parametrize("far", [0.0, 400.0])
def test_cubic_ridge(spark, far, tmp_path):
    r = np.random.default_rng(8)
    t = r.uniform(0, 20, (150, 3)) + far
    s = t + 0.002 * t**2 + r.normal(0, 0.1, (150, 3))
    rows = [("a", *map(float, p), *map(float, q), i) for i, (p, q) in enumerate(zip(t, s, strict=True))] + [("a", None, 1.0, 1.0, 1.0, 1.0, 1.0, 900), ("b", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 901)]
    frame = spark.createDataFrame(rows, "k string, t0 double, t1 double, t2 double, s0 double, s1 double, s2 double, w long")
    fits = polynomial.fitted(frame, "k")
    got = {(x.k, x.axis): np.array(x.w) for x in fits.collect()}
    wanted, x = plain_ridge(t, s, 1.0)
    if not far:
        assert np.allclose([got["a", a] for a in range(3)], wanted, rtol=1e-5, atol=1e-8)
    assert np.allclose([got["b", a][0] for a in range(3)], [4, 5, 6]) and not np.any([got["b", a][1:] for a in range(3)])
    at = {r_.w: (r_.m0, r_.m1, r_.m2) for r_ in polynomial.mapped(frame, fits, "k").collect()}
    assert np.allclose([at[i] for i in range(150)], np.column_stack([np.ones(150), x]) @ wanted.T, atol=1e-3)
    polynomial.save(fits, str(tmp_path / "w"))
    assert sorted(map(repr, polynomial.load(spark, str(tmp_path / "w")).collect())) == sorted(map(repr, fits.collect()))
    frame.select("k").write.parquet(str(tmp_path / "keys"))
    with pytest.raises(ValueError, match="no weights"):
        polynomial.load(spark, str(tmp_path / "keys"))


def test_points_at_one_place_are_matched_in_order(spark):
    """Points that share a place, as targets, as sources and as both, with one target more than sources."""
    places = {k: (float(k % 7), float(k % 3), 0.0) for k in range(40)}
    t = spark.createDataFrame([(0, k, *p) for k, p in places.items()] + [(0, 40, *places[0])], "k long, id long, c0 double, c1 double, c2 double")
    s = spark.createDataFrame([(0, 100 + k, p[0], p[1], 0.001) for k, p in reversed(places.items())], "k long, id long, c0 double, c1 double, c2 double")
    assert sorted((r.target, r.source) for r in matching.matched(t, s, "k").collect()) == [(k, 100 + k) for k in range(40)]
    assert sorted((r.target, r.source) for r in matching.matched(s, t, "k").collect()) == [(100 + k, k) for k in range(40)]


def test_products_are_summed_where_rows_are_read(spark):
    """One row for a batch and key is exploded, not a row for each point and product."""
    points = spark.range(300).selectExpr("id % 2 AS k", *[f"id * {m} % 17 / 3 AS t{a}" for a, m in enumerate((3, 5, 7))], *[f"id * {m} % 13 / 2 AS s{a}" for a, m in enumerate((2, 6, 11))])
    plan = polynomial.moments(points, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and 0 <= plan.index("Generate posexplode") < plan.find("MapInArrow")
    rows = np.array([tuple(r) for r in points.where("k = 1").collect()])
    x = np.stack([np.prod(rows[:, 1:4] ** np.array(t), 1) for t in polynomial.TERMS] + [*rows[:, 4:].T], 1)
    x -= x.mean(0)
    (got,) = polynomial.moments(points, "k").where("k = 1").collect()
    assert got.n == 150 and np.allclose(got.sums, (x[:, :19].T @ x)[np.triu_indices(19, 0, 22)])


def test_drift_runs_once(spark):
    """The fit reads the matches several times, but points drift once."""
    runs = spark.sparkContext.accumulator(0)
    points = [(0, k, float(k % 5), float(k % 7), float(k % 3)) for k in range(60)]
    t = spark.createDataFrame(points, "k long, id long, c0 double, c1 double, c2 double")
    s = t.mapInPandas(lambda batches: ((runs.add(len(b)), b)[1] for b in batches), t.schema)
    assert matching.estimated(t, s, "k").count() == 3
    assert runs.value <= 3 * len(points)

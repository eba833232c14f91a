"""Density clusters against a plain search, components against union-find, bodies against the rule by hand."""

import math
import random

import pytest

from voxelia.operators import sections as S
from voxelia.operators.density import density_clusters
from voxelia.operators.graph import components

SCHEMA = "id long, group string, c0 double, c1 double, c2 double, label string"


def plain(rows, eps, least):
    """Labels as a search that grows one cluster after another gives them."""
    out = {}
    for group in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == group)
        fine = [r for r in own if all(v is not None and not math.isnan(v) for v in r[2:5])]
        near = {r[0]: [o[0] for o in fine if sum((a - b) ** 2 for a, b in zip(r[2:5], o[2:5], strict=True)) <= eps * eps] for r in fine}
        core = {k for k, n in near.items() if len(n) >= least}
        label, n = {}, 0
        for k in sorted(core):
            if k in label:
                continue
            label[k], todo = n, [k]
            while todo:
                for o in near[todo.pop()]:
                    if o not in label:
                        label[o] = n
                        if o in core:
                            todo.append(o)
            n += 1
        out |= {r[0]: (r[0] in core, label.get(r[0], -1)) for r in own}
    return out


def clusters(spark, rows, eps, least):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {r.id: (r.core, r.label) for r in density_clusters(frame, eps, least).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_against_a_plain_search(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(500):
        group = r.choice(["a", "b", None])
        place = [r.choice([1.0, 4.0, 9.0]) + r.gauss(0, 0.7) for _ in range(3)] if r.random() < 0.7 else [r.uniform(0, 12) for _ in range(3)]
        if seed % 2:
            place = [float(round(v)) for v in place]  # many equal places, and distances of exactly eps
        rows.append((k, group, *place))
    rows += [(600, "a", None, 1.0, 1.0), (601, "a", float("nan"), 1.0, 1.0), (602, "", 1.0, 1.0, 1.0), (603, "a", -0.0, 0.0, 0.0), (604, "a", 0.0, -0.0, 0.0)]
    assert clusters(spark, rows, 1.0 if seed % 2 else 0.8, 5) == plain(rows, 1.0 if seed % 2 else 0.8, 5)


def test_crowded_cells_link_by_boxes(spark):
    """Two crowds of 300 points in neighbouring cells: within eps only at one pair of corners, then nowhere."""
    r = random.Random(1)
    near = [(k, "a", *(r.uniform(0, 0.5) for _ in range(3))) for k in range(300)]
    far = [(k + 300, "a", r.uniform(1.5, 1.9), *(r.uniform(0, 0.5) for _ in range(2))) for k in range(300)]
    rows = near + far
    for eps in (1.02, 1.0, 0.9):
        assert clusters(spark, rows, eps, 5) == plain(rows, eps, 5)


def test_empty_and_single(spark):
    assert clusters(spark, [], 1.0, 5) == {}
    assert clusters(spark, [(1, "a", 0.0, 0.0, 0.0)], 1.0, 5) == {1: (False, -1)}
    assert clusters(spark, [(1, "a", 0.0, 0.0, 0.0)], 1.0, 1) == {1: (True, 0)}
    assert clusters(spark, [(k, "a", 2.0, 2.0, 2.0) for k in range(5)], 1.0, 5) == {k: (True, 0) for k in range(5)}


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 100)] + [(r.randint(2000, 2200), r.randint(2000, 2200)) for _ in range(120)] + [(5, 5), (None, 3), (7, None)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def ball(spark, rows):
    return {r.label: r.keep for r in S.bodies(spark.createDataFrame(rows, "label long, axis long, c0 double, c1 double, c2 double, area double")).collect()}


def test_bodies(spark):
    tube = [(0, 0, float(k), 5.0, 5.0, 100.0) for k in range(9)]  # one axis, no change of area
    cone = [(1, 0, float(k), 5.0, 5.0, 10.0 + 40.0 * k) for k in range(9)]  # one axis, areas shrink: the tenth percentile is far below
    round_ = [(2, a, 5.0 + d * (a == 0), 5.0 + d * (a == 1), 5.0 + d * (a == 2), 10.0) for a in range(3) for d in range(-3, 4)]
    point = [(3, 0, 5.0, 5.0, 5.0, 10.0)] * 6
    noise = [(-1, 0, 1.0, 1.0, 1.0, 5.0)]
    # the ratio of areas along a tube is 1, whose root is over 0.5: such a tube is kept, a cone isn't
    assert ball(spark, tube + cone + round_ + point + noise) == {0: True, 1: False, 2: True, 3: False}
    (row,) = S.bodies(spark.createDataFrame(round_, "label long, axis long, c0 double, c1 double, c2 double, area double")).collect()
    assert (row.c0, row.min_1, row.max_2, row.n_0, row.n_1, row.volume) == (5.0, 2.0, 8.0, 7, 7, 70.0)


def test_quantiles(spark):
    r = random.Random(3)
    rows = [(g, r.choice([1.0, 2.0, 2.0, 7.5]) if g else r.random()) for g in (0, 1) for _ in range(101)] + [(2, 4.0), (1, None)]
    got = {x.g: (x.a, x.b) for x in S.quantiles(spark.createDataFrame(rows, "g long, v double"), "v", {"a": 0.1, "b": 0.93}, "g").collect()}
    for g in (0, 1, 2):
        own = sorted(v for k, v in rows if k == g and v is not None)
        for q, found in zip((0.1, 0.93), got[g], strict=True):
            at = q * (len(own) - 1)
            lo = own[math.floor(at)]
            assert abs(found - (lo + (own[math.ceil(at)] - lo) * (at - math.floor(at)))) < 1e-12


def test_nothing_goes_through_the_driver(spark):
    """Cells kept in small files are joined by a shuffle: sent to the driver, their rows would take far more than the files."""
    from voxelia.operators.density import near_cells
    from voxelia.operators.graph import to_larger, to_smaller
    from voxelia.store import kept

    cells = kept(spark.range(50).selectExpr("id AS cell", "id % 3 AS grp", "id AS g0", "id AS g1"), "cells")
    links = kept(spark.range(50).selectExpr("id + 1 AS a", "id AS b"), "links")
    for df in (near_cells(cells, ("g0", "g1")), to_larger(links), to_smaller(links)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert near_cells(cells, ("g0", "g1")).count() == 0

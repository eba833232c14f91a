"""Borders against a walk over the image, ellipses against drawn ones, every rejection of the sieve."""

import math
import random

import pytest

from voxelia.operators import contours

SCHEMA = "plane long, y long, x long, label long, first string"
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def ellipse(cx, cy, short, long, angle, label=1, size=(100, 150)):
    t, out = math.radians(angle), {}
    for y in range(size[0]):
        for x in range(size[1]):
            p, q = (x - cx) * math.cos(t) + (y - cy) * math.sin(t), (y - cy) * math.cos(t) - (x - cx) * math.sin(t)
            if 4 * (p * p / short**2 + q * q / long**2) <= 1:
                out[y, x] = label
    return out


def rows(images):
    return [(k, y, x, v, "x") for k, image in images.items() for (y, x), v in image.items()]


def found(spark, images):
    return contours.borders(spark.createDataFrame(rows(images), SCHEMA).repartition(3), "plane")


def walked(image):
    """Borders of an image by walking around each with the region on the right, side by side of its pixels."""
    out = []
    for label in set(image.values()):
        own = {p for p, v in image.items() if v == label}
        left = {(p, d) for p in own for d in (0, 2, 4, 6) if (p[0] + AROUND[d][0], p[1] + AROUND[d][1]) not in own}
        while left:
            start = now = min(left)
            path = []
            while True:
                left.discard(now)
                (y, x), d = now
                ahead, beside = ((y + AROUND[k % 8][0], x + AROUND[k % 8][1]) for k in (d + 2, d + 1))
                now = (beside, (d + 6) % 8) if beside in own else (ahead, d) if ahead in own else ((y, x), (d + 2) % 8)
                if now[0] != (y, x):
                    path.append(now[0])
                if now == start:
                    break
            path = path or [start[0]]
            twice = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(path, path[1:] + path[:1], strict=True))
            out.append((label, *min(path), len(path), abs(twice) / 2, twice < 0))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_against_a_walk(spark, seed):
    r = random.Random(seed)
    images = {k: {(y, x): v for y in range(9) for x in range(9) if (v := r.choices([0, 1, 2], [2, 3, 1])[0])} for k in range(25)}
    images |= {100: {(5, 5): 1}, 101: {(2, x): 1 for x in range(6)}, 102: {(k, k): 2 for k in range(5)}, 103: {(-y, x - 3): 1 for y in range(4) for x in range(7)}}
    images[104] = {p: 1 for p in [(y, x) for y in range(7) for x in range(7)] if p not in ((2, 2), (2, 3), (4, 4))}
    got = {}
    for b in found(spark, images).collect():
        got.setdefault(b.plane, []).append((b.label, b.y0, b.x0, b.n, b.area, b.hole))
    assert {k: sorted((*v[:1], *v[3:]) for v in own) for k, own in got.items()} == {k: sorted((*v[:1], *v[3:]) for v in walked(image)) for k, image in images.items()}


def hull(points):
    """Area of the convex hull: the largest polygon of points by angle around the middle of those no triangle holds."""
    points = sorted(set(points))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = [(a, b) for a in points for b in points if a != b and all(turn(a, b, c) > 0 or (turn(a, b, c) == 0 and min(a, b) <= c <= max(a, b)) for c in points)]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in edges)) / 2


def test_hulls(spark):
    r = random.Random(9)
    images = {k: {(y, x): 1 for y, x in {(r.randint(0, 6), r.randint(0, 6)) for _ in range(25)}} for k in range(15)}
    for b in found(spark, images).where("not hole").collect():
        own, todo = set(), [(b.y0, b.x0)]
        while todo:
            p = todo.pop()
            if p in images[b.plane] and p not in own:
                own.add(p)
                todo += [(p[0] + dy, p[1] + dx) for dy, dx in AROUND]
        assert b.hull == pytest.approx(hull(list(own)))


def test_drawn_ellipse(spark):
    """The ellipse of 30 by 40 at an angle of 45, alone and with a smaller one of another label inside."""
    outer = ellipse(75, 50, 30, 40, 45)
    images = {0: outer, 1: outer | ellipse(75, 50, 20, 30, 45, 2), 2: ellipse(75, 50, 30, 40, 45, 1, (99, 149))}
    fits = contours.ellipses(found(spark, images))
    by = {}
    for e in contours.sieved(fits).collect():
        by.setdefault(e.plane, []).append(e)
    close = lambda e, *want: all(abs(a - b) <= 0.1 * b for a, b in zip((e.cx, e.cy, e.short, e.long, e.angle), want, strict=True))
    assert len(by[0]) == 1 and close(by[0][0], 75, 50, 30, 40, 45)
    assert any(close(e, 75, 50, 30, 40, 45) for e in by[1]) and any(close(e, 75, 50, 20, 30, 45) and e.label == 2 for e in by[1])
    assert (by[0][0].cx, by[0][0].long) == (by[2][0].cx, by[2][0].long)
    one = fits.where("plane = 0")
    for limits in ({"min_ratio": 0.9}, {"min_long": 100.0}, {"max_long": 1.0}, {"min_area": 5000.0}, {"max_area": 100.0}, {"max_far": -1.0}, {"min_area_ratio": 1.0}):
        assert contours.sieved(one, **limits).count() == 0, limits
    cut = {p: v for p, v in outer.items() if not (p[0] < 49 and p[1] < 74) and not (p[0] >= 51 and p[1] >= 76)}
    assert contours.sieved(contours.ellipses(found(spark, {0: cut}))).count() == 0


def test_small_tables(spark):
    assert found(spark, {}).count() == 0 and contours.ellipses(found(spark, {})).count() == 0
    bad = spark.createDataFrame([(0, None, 1, 1, "x"), (0, 1, 1, None, "x"), (None, 2, 2, 1, "x")], SCHEMA)
    (only,) = contours.ellipses(contours.borders(bad, "plane")).collect()
    assert (only.plane, only.n, only.area, only.com_x, only.cx) == (None, 1, 0.0, None, None)


def test_borders_through_tiles(spark):
    """Borders in many tiles, with a hole over an edge between them, and no row of single cracks where a border lies in one tile."""
    r = random.Random(4)
    images = {0: {(y, x): 1 for y in range(60, 70) for x in range(-5, 140) if r.random() < 0.8}, 1: {(y, x): 2 for y in range(-70, 70) for x in range(60, 68) if not (-2 <= y <= 1 and 62 <= x <= 65)}}
    got = {}
    for b in found(spark, images).collect():
        got.setdefault(b.plane, []).append((b.label, b.y0, b.x0, b.n, b.area, b.hole))
    assert {k: sorted(v) for k, v in got.items()} == {k: walked(image) for k, image in images.items()}
    small = spark.createDataFrame(rows({0: ellipse(30, 30, 20, 30, 10)}), SCHEMA)
    assert contours.tile_borders(contours.packed(small, "plane"), "plane").count() == 1

"""Queries on borders of regions and the ellipses fitted to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators import contours
from voxelia.registry import query

#: Pixel with its neighbours of the same label, cracks with their successors, cycles, and sums over them.
BORDERS = f"""WITH RECURSIVE {CTE['drawn']},
px AS MATERIALIZED (SELECT * FROM drawn WHERE label > 0),
near AS (SELECT p.plane, p.y, p.x, p.label, """ + ", ".join(f"bool_or(q.y - p.y = {dy} AND q.x - p.x = {dx}) AS {name}" for name, (dy, dx) in contours.STEPS.items()) + f"""
  FROM px p JOIN px q ON p.plane = q.plane AND p.label = q.label AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.plane, p.y, p.x, p.label),
code AS (SELECT *, (plane * {C.PLANE} + y) * {C.PLANE} + x AS id FROM near),
crack AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT plane, label, y, x, id * 4 + {k} AS a, CASE WHEN {left} THEN (id + {contours.STEPS[left][0]} * {C.PLANE} + {contours.STEPS[left][1]}) * 4 + {'ensw'.index(met)} WHEN {ahead} THEN (id + {contours.STEPS[ahead][0]} * {C.PLANE} + {contours.STEPS[ahead][1]}) * 4 + {k} ELSE id * 4 + {'ensw'.index(right)} END AS b FROM code WHERE NOT {side}"
    for side, (left, met, ahead, right) in contours.WALK.items() for k in ["ensw".index(side)]) + f"""),
cycle(a, c) USING KEY (a) AS (
  SELECT a, a FROM crack
  UNION
  SELECT k.b, min(r.c) FROM cycle r JOIN crack k ON k.a = r.a JOIN recurring.cycle o ON o.a = k.b WHERE r.c < o.c GROUP BY k.b),
step AS MATERIALIZED (SELECT k.plane, k.label, c, k.x - f.x AS u, k.y - f.y AS v, n.x - f.x AS p, n.y - f.y AS q, f.x AS x0, f.y AS y0
  FROM crack k JOIN cycle y ON y.a = k.a JOIN crack n ON n.a = k.b JOIN crack f ON f.a = y.c),
border AS MATERIALIZED (SELECT plane, label, c, x0, y0, greatest(count(*) FILTER (u <> p OR v <> q), 1) AS n, sum(u * q - p * v)::DOUBLE AS twice,
  sum((u + p) * (u * q - p * v))::DOUBLE AS mx, sum((v + q) * (u * q - p * v))::DOUBLE AS my FROM step GROUP BY ALL)"""


@query(BORDERS + " SELECT plane, label, y0, x0, n, twice < 0 AS hole, abs(twice) / 2 AS area, round(CASE WHEN twice <> 0 THEN my / (3 * twice) + y0 END, 5) AS com_y, round(CASE WHEN twice <> 0 THEN mx / (3 * twice) + x0 END, 5) AS com_x FROM border")
def region_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every border of every drawn region, outer or of a hole: first pixel, points, area, centre of mass."""
    b = contours.borders(C.drawn(spark, sf_dir).where("label > 0"), "plane")
    return b.select("plane", "label", F.col("y0").cast("long").alias("y0"), F.col("x0").cast("long").alias("x0"), "n", "hole", "area", F.round("com_y", 5).alias("com_y"), F.round("com_x", 5).alias("com_x"))


NAMES = ["x * x", "x * y", "y * y", "x", "y"]
#: Normal equations of the conic around the mean of the points, solved by elimination.
CONICS = BORDERS + f""",
mean AS (SELECT c, avg(p) AS mp, avg(q) AS mq FROM step WHERE u <> p OR v <> q GROUP BY c),
dot AS (SELECT s.c, s.p - m.mp AS x, s.q - m.mq AS y FROM step s JOIN mean m ON m.c = s.c JOIN border b ON b.c = s.c WHERE (u <> p OR v <> q) AND b.n >= 5 AND b.twice <> 0),
wide AS MATERIALIZED (SELECT c, [{', '.join(NAMES)}, 1]::DOUBLE[] AS t FROM dot),
start AS (SELECT c, i, j, sum(t[i + 1] * t[j + 1]) AS v FROM wide, range(5) a(i), range(6) b(j) GROUP BY c, i, j),
solve(c, k, i, j, v) AS (
  SELECT c, 0, i, j, v FROM start
  UNION ALL
  SELECT c, k + 1, i, j, CASE WHEN i = k THEN v / corner ELSE v - own * above / corner END FROM (
    SELECT *, max(v) FILTER (i = k) OVER (PARTITION BY c, j) AS above, max(v) FILTER (j = k) OVER (PARTITION BY c, i) AS own, max(v) FILTER (i = k AND j = k) OVER (PARTITION BY c) AS corner FROM solve WHERE k < 5)),
conic AS (SELECT c, {', '.join(f'max(v) FILTER (i = {i}) AS k{i}' for i in range(5))} FROM solve WHERE k = 5 AND j = 5 GROUP BY c),
centre AS (SELECT *, (k1 * k4 - 2 * k2 * k3) / (4 * k0 * k2 - k1 * k1) AS x, (k1 * k3 - 2 * k0 * k4) / (4 * k0 * k2 - k1 * k1) AS y FROM conic WHERE 4 * k0 * k2 - k1 * k1 > 0),
axis AS (SELECT *, 1 - (k3 * x + k4 * y) / 2 AS level, (k0 + k2) / 2 AS middle, sqrt(power((k0 - k2) / 2, 2) + power(k1 / 2, 2)) AS half FROM centre),
fit AS (SELECT b.plane, b.label, b.x0, b.y0, b.n, abs(twice) / 2 AS area, my / (3 * twice) + y0 AS com_y, mx / (3 * twice) + x0 AS com_x, x + mp + x0 AS cx, y + mq + y0 AS cy,
  2 * sqrt(level / (middle + half)) AS short, 2 * sqrt(level / (middle - half)) AS long, (degrees(atan2(k1, k0 - k2) / 2) + 180) % 180 AS angle
  FROM axis a JOIN border b ON a.c = b.c JOIN mean m ON m.c = a.c WHERE level / (middle + half) > 0 AND level / (middle - half) > 0)"""
FITTED = ", ".join(f"round({c}, 3) AS {c}" for c in ("cx", "cy", "short", "long"))


@query(CONICS + f" SELECT plane, label, y0, x0, {FITTED}, CASE WHEN long > 1.01::DOUBLE * short THEN round(least(angle % 180, 180 - angle % 180), 2) END AS tilt FROM fit WHERE short / long >= 0.5 AND sqrt((com_x - cx) ** 2 + (com_y - cy) ** 2) <= 10 AND area / (short * long * pi() / 4) > 0.75")
def fitted_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The borders of drawn regions that are ellipses, with the ellipse; the limits on the hull's area are off, and a circle has no tilt."""
    found = contours.ellipses(contours.borders(C.drawn(spark, sf_dir).where("label > 0"), "plane"))
    fine = contours.sieved(found, min_area=0.0)
    shown = [F.round(c, 3).alias(c) for c in ("cx", "cy", "short", "long")]
    return fine.select("plane", "label", F.col("y0").cast("long").alias("y0"), F.col("x0").cast("long").alias("x0"), *shown, F.when(F.col("long") > 1.01 * F.col("short"), rounded(F.least("angle", 180 - F.col("angle")), 2)).alias("tilt"))

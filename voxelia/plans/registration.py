"""Queries on matched points: assignments, filtered matches, cubic maps, coherent drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators import matching, polynomial
from voxelia.operators import sections as S
from voxelia.plans.sections import ELL
from voxelia.registry import query

AXES = ("c0", "c1", "c2")


def frames(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The ellipses of C.ell in space, in frames of so many ids."""
    return S.lifted(C.ell(spark, sf_dir)).withColumn("frame", F.floor(F.col("id") / size).cast("long"))


ORDERS = ["012", "021", "102", "120", "201", "210"]


@query(ELL + ", n AS (SELECT class, id // 24 AS frame, c0, c1, c2, (id // 4) % 6 AS k FROM lifted), s AS (SELECT class, frame, " + ", ".join(f"max({c}) FILTER (k = {k}) AS {c}_{k}" for k in range(6) for c in AXES) + " FROM n GROUP BY class, frame HAVING count(*) = 6) SELECT class, frame, round(least(" + ", ".join(" + ".join("sqrt(" + " + ".join(f"({c}_{i} - {c}_{3 + int(j)}) ** 2" for c in AXES) + ")" for i, j in enumerate(o)) for o in ORDERS) + "), 6) AS cost FROM s")
def assignment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least total distance of three centres of a class to its next three, for every six of a class in turn."""
    six = F.floor(F.col("id") / 4) % 6
    e = frames(spark, sf_dir, 24).select("class", "frame", "id", *AXES, six.alias("k"))
    pairs = matching.matched(e.where("k < 3"), e.where("k >= 3"), "class", "frame")
    return pairs.groupBy("class", "frame").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("cost")).where("n = 3").drop("n")


@query(ELL + ", n AS (SELECT id // 200 AS frame, id % 2 AS side, cx + short / 100 + id / 1e6 AS c FROM lifted), r AS (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY c) AS k FROM n) SELECT a.frame, count(*) AS n, round(sum(abs(a.c - b.c)), 6) AS cost FROM r a JOIN r b ON a.frame = b.frame AND a.k = b.k AND a.side = 0 AND b.side = 1 GROUP BY a.frame")
def assignment_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least total distance of two sides of 100 places on a line, where matching them in their order is known to be the best."""
    e = frames(spark, sf_dir, 200).select("frame", "id", (F.col("id") % 2).alias("side"), (F.col("cx") + F.col("short") / 100 + F.col("id") / 1e6).alias("c"))
    pairs = matching.matched(e.where("side = 0"), e.where("side = 1"), "frame", axes=("c",))
    return pairs.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("cost"))


#: Control points, at places where no two distances to a voxel are equal.
CONTROL = [(0, 1.137, 3.391, 4.713), (1, 4.219, 8.537, 8.091), (2, 6.371, 12.173, 11.417)]
HELD = f"WITH {CTE['pts']}, ctl(label, cz, cy, cx) AS (VALUES {', '.join(map(str, CONTROL))}), d AS MATERIALIZED (SELECT scan, z, y, x, label, sqrt((z - cz::DOUBLE) ** 2 + (y - cy::DOUBLE) ** 2 + (x - cx::DOUBLE) ** 2) AS d FROM pts CROSS JOIN ctl)"


@query(HELD + """, three AS (SELECT a.scan, [{'z': a.z, 'y': a.y, 'x': a.x, 'label': a.label, 'd': a.d}, {'z': b.z, 'y': b.y, 'x': b.x, 'label': b.label, 'd': b.d}, {'z': c.z, 'y': c.y, 'x': c.x, 'label': c.label, 'd': c.d}] AS m, a.d + b.d + c.d AS cost
  FROM d a JOIN d b ON a.scan = b.scan AND a.label = 0 AND b.label = 1 AND (a.z, a.y, a.x) <> (b.z, b.y, b.x) JOIN d c ON a.scan = c.scan AND c.label = 2 AND (c.z, c.y, c.x) <> (a.z, a.y, a.x) AND (c.z, c.y, c.x) <> (b.z, b.y, b.x))
SELECT scan, m.z AS z, m.y AS y, m.x AS x, m.label::BIGINT AS label, round(m.d, 6) + 0.0 AS d FROM (SELECT scan, unnest(arg_min(m, cost)) AS m FROM three GROUP BY scan) WHERE m.d < 5""")
def match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each control point's own bright voxel in the assignment of least total distance, where it is nearer than 5."""
    axes = ("z", "y", "x")
    points = C.pts(spark, sf_dir).withColumn("id", F.struct(*axes)).select("scan", F.to_json("id").alias("id"), *axes)
    control = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("id"), *[F.lit(v).alias(a) for a, v in zip(axes, place, strict=True)]) for k, *place in CONTROL]))
    controls = points.select("scan").distinct().select("scan", control.alias("c")).select("scan", "c.*")
    pairs = matching.matched(points, controls, "scan", axes=axes).where("d < 5")
    return pairs.select("scan", F.from_json("target", "z long, y long, x long").alias("p"), "source", "d").select("scan", "p.z", "p.y", "p.x", F.col("source").alias("label"), rounded("d").alias("d"))


def moved(c: dict[str, Column]) -> dict[str, Column]:
    """A smooth warp of a place in space."""
    return {"s0": c["c0"] + 0.05 * c["c1"] + 0.0004 * c["c1"] * c["c2"], "s1": c["c1"] - 0.001 * c["c0"] * c["c0"], "s2": c["c2"] + 0.00002 * c["c0"] * c["c1"] * c["c2"] + 0.5}


MOVED = "c0 + 0.05::DOUBLE * c1 + 0.0004::DOUBLE * c1 * c2 AS s0, c1 - 0.001::DOUBLE * c0 * c0 AS s1, c2 + 0.00002::DOUBLE * c0 * c1 * c2 + 0.5 AS s2"


def pairs_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, id, t0..t2, s0..s2): every ellipse's centre and its place after the warp and a jitter."""
    e = S.lifted(C.ell(spark, sf_dir))
    s = moved({a: F.col(a) for a in AXES})
    return e.select("scan", "id", *[F.col(a).alias(f"t{k}") for k, a in enumerate(AXES)], *[(v + F.col("angle") * (k + 1) / 1000).alias(n) for k, (n, v) in enumerate(s.items())])


NAMES = ["*".join(c for c, n in zip(("t0", "t1", "t2"), t, strict=True) for _ in range(n)) for t in polynomial.TERMS]
SIZE = len(NAMES)
#: The same terms, means, centred products and solution by elimination, without pivots as the matrix is positive definite.
RIDGE = f"""WITH RECURSIVE {ELL.removeprefix('WITH ')}, pairs AS (SELECT scan, id, c0 AS t0, c1 AS t1, c2 AS t2, s0 + angle / 1000 AS s0, s1 + angle * 2 / 1000 AS s1, s2 + angle * 3 / 1000 AS s2 FROM (SELECT *, {MOVED} FROM lifted)),
term AS MATERIALIZED (SELECT scan, id, k, v FROM (SELECT scan, id, unnest([{', '.join([*NAMES, 's0', 's1', 's2'])}]::DOUBLE[]) AS v, unnest(range({SIZE + 3})) AS k FROM pairs)),
mean AS MATERIALIZED (SELECT scan, k, avg(v) AS m FROM term GROUP BY ALL),
wide AS MATERIALIZED (SELECT scan, id, list(v - m ORDER BY k) AS x FROM term JOIN mean USING (scan, k) GROUP BY scan, id),
start AS (SELECT scan, i, j, sum(x[i + 1] * x[j + 1]) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM wide, range({SIZE}) a(i), range({SIZE + 3}) b(j) GROUP BY scan, i, j),
solve(scan, p, i, j, v) AS (
  SELECT scan, 0, i, j, v FROM start
  UNION ALL
  SELECT scan, p + 1, i, j, CASE WHEN i = p THEN v / corner ELSE v - own * above / corner END FROM (
    SELECT *, max(v) FILTER (i = p) OVER (PARTITION BY scan, j) AS above, max(v) FILTER (j = p) OVER (PARTITION BY scan, i) AS own, max(v) FILTER (i = p AND j = p) OVER (PARTITION BY scan) AS corner FROM solve WHERE p < {SIZE})),
weight AS MATERIALIZED (SELECT scan, j - {SIZE} AS axis, i AS term, v AS w FROM solve WHERE p = {SIZE} AND j >= {SIZE}),
fit AS MATERIALIZED (SELECT w.scan, axis, any_value(y.m) - sum(w * x.m) AS c, list(w ORDER BY term) AS w FROM weight w JOIN mean x ON x.scan = w.scan AND x.k = term JOIN mean y ON y.scan = w.scan AND y.k = axis + {SIZE} GROUP BY w.scan, axis)"""


@query(RIDGE + " SELECT scan, axis, unnest(range(len(w) + 1)) AS term, round(unnest(list_prepend(c, w)), 5) + 0.0 AS w FROM fit")
def cubic_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the cubic map that ridge regression fits to each scan's matched points; term 0 is the constant."""
    w = polynomial.fitted(pairs_of_points(spark, sf_dir), "scan")
    return w.select("scan", "axis", F.posexplode("w").alias("term", "w")).select("scan", "axis", F.col("term").cast("long").alias("term"), rounded("w", 5).alias("w"))


@query(RIDGE + f" SELECT id, scan, " + ", ".join(f"round(max(c + {' + '.join(f'w[{i + 1}] * {n}' for i, n in enumerate(NAMES))}) FILTER (axis = {a}), 4) + 0.0 AS m{a}" for a in range(3)) + " FROM pairs JOIN fit USING (scan) GROUP BY id, scan")  # noqa: F541
def cubic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matched point's place under its scan's fitted map."""
    p = pairs_of_points(spark, sf_dir)
    return polynomial.mapped(p, polynomial.fitted(p, "scan"), "scan").select("id", "scan", *[rounded(f"m{a}", 4).alias(f"m{a}") for a in range(3)])


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets and sources (frame, id, c0, c1, c2) in frames of 120 points: the sources are the targets after the warp, a source's id is one more."""
    t = frames(spark, sf_dir, 120).select("frame", "id", *AXES)
    s = moved({a: F.col(a) for a in AXES})
    return t, t.select("frame", (F.col("id") + 1).alias("id"), *[v.alias(a) for a, v in zip(AXES, s.values(), strict=True)])


FRAMES = ELL + " SELECT id // 120 AS frame, count(*) AS n, count(*) AS own FROM lifted GROUP BY frame"


@query(FRAMES)
def drift_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherent drift of warped points, then assignment: how many of each frame's matches are less than 1 apart, and how many join a point with its own image."""
    t, s = sides(spark, sf_dir)
    moved_ = matching.drifted(t, s, "frame").withColumnRenamed("source", "id")
    pairs = matching.matched(t, moved_, "frame").where("d < 1")
    return pairs.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("source") == F.col("target") + 1).alias("own"))


@query(FRAMES)
def drift_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cubic map estimated by drift, assignment and ridge: how many of a frame's points it takes to within 0.5 of their own image."""
    t, s = sides(spark, sf_dir)
    found = matching.estimated(t, s, "frame")
    p = polynomial.mapped(t, found, "frame", places=AXES).join(s.select("frame", (F.col("id") - 1).alias("id"), *[F.col(a).alias(f"s{k}") for k, a in enumerate(AXES)]), ["frame", "id"])
    near = sum(((F.col(f"m{k}") - F.col(f"s{k}")) ** 2 for k in range(3)), F.lit(0.0)) < 0.25
    return p.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(near).alias("own"))

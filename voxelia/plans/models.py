"""Queries on the data side of models and of the viewer: schedules, losses, hierarchical labels, reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators import sections as S
from voxelia.operators.density import density_clusters
from voxelia.plans.sections import CENTRES, ELL, VALUES
from voxelia.registry import query

#: Second-level centres of each first-level label.
SECOND = {0: [300.0, 600.0], 1: [1300.0, 1500.0, 1700.0], 2: [2500.0, 3500.0]}


@query(f"WITH {CTE['metric']}, t AS (SELECT name, step, count(*) OVER (PARTITION BY name) AS total, floor(count(*) OVER (PARTITION BY name) / 10) AS warm FROM metric) SELECT name, step, round(CASE WHEN step <= warm THEN 0.0005::DOUBLE * step / warm ELSE 0.00001::DOUBLE + 0.5::DOUBLE * (0.0005::DOUBLE - 0.00001::DOUBLE) * (1 + cos(pi() * (step - warm) / (total - warm))) END, 10) AS rate FROM t")
def cosine_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at every step of each metric's series: a linear rise to 0.0005 over its first tenth, then half a cosine down to 0.00001."""
    m = C.metric(spark, sf_dir).select("name", "step")
    t = m.join(C.small(m.groupBy("name").agg(F.count("*").alias("total"))), "name").withColumn("warm", F.floor(F.col("total") / 10))
    fall = 0.00001 + 0.5 * (0.0005 - 0.00001) * (1 + F.cos(math.pi * (F.col("step") - F.col("warm")) / (F.col("total") - F.col("warm"))))
    return t.select("name", "step", F.round(F.when(F.col("step") <= F.col("warm"), 0.0005 * F.col("step") / F.col("warm")).otherwise(fall), 10).alias("rate"))


@query(f"WITH {CTE['vox']}, p AS (SELECT a.z, a.y, a.x, a.v AS o, b.v AS l, (a.y BETWEEN 4 AND 11 AND a.x BETWEEN 4 AND 11)::INT AS mask FROM vox a JOIN vox b USING (z, y, x) WHERE a.scan = 0 AND b.scan = 1) SELECT z, round(avg((o - l) ** 2 * (1.25 - mask)), 4) AS loss FROM p GROUP BY z")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of squared differences, weighted by w less the mask of the inner window, w = (8 / 16)^2 + 1."""
    both = C.vox(spark, sf_dir).groupBy("z", "y", "x").agg(F.max(F.when(F.col("scan") == 0, F.col("v"))).alias("o"), F.max(F.when(F.col("scan") == 1, F.col("v"))).alias("l"))
    mask = (F.col("y").between(4, 11) & F.col("x").between(4, 11)).cast("int")
    return both.groupBy("z").agg(F.round(F.avg((F.col("o") - F.col("l")) ** 2 * (1.25 - mask)), 4).alias("loss"))


FIRST = f"WITH {CTE['vox']}, c(label, place, spread) AS (VALUES {VALUES}), f AS (SELECT v.*, label FROM vox v CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY scan, z, y, x ORDER BY abs(v - place), label) = 1)"
OFFSETS = {k: sum(len(SECOND[j]) for j in SECOND if j < k) for k in SECOND}
SECOND_SQL = ", ".join(f"({k}, {OFFSETS[k] + i}, {p})" for k, own in SECOND.items() for i, p in enumerate(own))


def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vox with label, the nearest first-level centre, and full, the number of the nearest centre below it among those of all labels."""
    first = S.nearest_centre(C.vox(spark, sf_dir), CENTRES)
    best = [F.least(*[F.struct(F.abs(F.col("v") - p).alias("d"), F.lit(OFFSETS[k] + i).alias("i")) for i, p in enumerate(own)])["i"] for k, own in SECOND.items()]
    full = F.coalesce(*[F.when(F.col("label") == k, b) for k, b in zip(SECOND, best, strict=True)], F.lit(-1))
    return first.withColumn("full", full.cast("long")).withColumn("label", F.col("label").cast("long"))


@query(FIRST + f", s(label, full_, place) AS (VALUES {SECOND_SQL}) SELECT scan, z, y, x, f.label::BIGINT AS label, s.full_::BIGINT AS \"full\" FROM f JOIN s USING (label) QUALIFY row_number() OVER (PARTITION BY scan, z, y, x ORDER BY abs(v - s.place), full_) = 1")
def hierarchical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchical(spark, sf_dir).select("scan", "z", "y", "x", "label", "full")


@query(FIRST + f", s(label, full_, place) AS (VALUES {SECOND_SQL}) SELECT scan, z, y, x, CASE WHEN v < 500 OR f.label <> 1 THEN -1 ELSE s.full_ END::BIGINT AS label FROM f JOIN s USING (label) QUALIFY row_number() OVER (PARTITION BY scan, z, y, x ORDER BY abs(v - s.place), full_) = 1")
def label_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-structure of class 1, -1 outside it and below the threshold of 500."""
    label = F.when((F.col("v") < 500) | (F.col("label") != 1), -1).otherwise(F.col("full"))
    return hierarchical(spark, sf_dir).select("scan", "z", "y", "x", label.cast("long").alias("label"))


@query(f"WITH {CTE['vox']}, c(label, place, spread) AS (VALUES {VALUES}) SELECT scan, z, y, x, label::BIGINT AS label, round(exp(-abs(v - place) / (1e-7 + spread)), 6) AS p FROM vox CROSS JOIN c")
def probability_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership of every voxel in every class; the centres are a constant and need no join."""
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("label"), F.round(F.exp(-F.abs(F.col("v") - p) / (1e-7 + s)), 6).alias("p")) for k, p, s in CENTRES]))
    return C.vox(spark, sf_dir).select("scan", "z", "y", "x", each.alias("e")).select("scan", "z", "y", "x", "e.label", "e.p")


@query(ELL + " SELECT id FROM lifted WHERE area BETWEEN 20 AND 2000 AND short / long >= 0.5 AND long BETWEEN 4 AND 60 AND sqrt((cx - 18) ** 2 + (cy - 20) ** 2) <= 10")
def ellipse_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses of fitting area, shape and length whose centre is within 10 of the place looked at."""
    fits = F.col("area").between(20, 2000) & (F.col("short") / F.col("long") >= 0.5) & F.col("long").between(4, 60)
    return S.lifted(C.ell(spark, sf_dir)).where(fits & (F.sqrt((F.col("cx") - 18) ** 2 + (F.col("cy") - 20) ** 2) <= 10)).select("id")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ellipses of C.body_ell in space, with core and label: density clusters of the centres of each scan and class."""
    e = S.lifted(C.body_ell(spark, sf_dir)).withColumn("group", F.struct("scan", "class"))
    return density_clusters(e, 2.0, 5).drop("group")


LIFT = "lifted AS (SELECT *, CASE axis WHEN 0 THEN layer ELSE cy END::DOUBLE AS c0, CASE axis WHEN 0 THEN cy WHEN 1 THEN layer ELSE cx END::DOUBLE AS c1, CASE axis WHEN 2 THEN layer ELSE cx END::DOUBLE AS c2, short * long * pi() / 4 AS area FROM body_ell)"
CLUSTERS = f"""WITH RECURSIVE {CTE['body_ell']}, {LIFT},
near AS MATERIALIZED (SELECT a.scan, a.class, a.id AS a, b.id AS b FROM lifted a JOIN lifted b ON a.scan = b.scan AND a.class = b.class AND (a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 <= 4),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
link AS MATERIALIZED (SELECT n.a, n.b FROM near n JOIN core x ON n.a = x.id JOIN core y ON n.b = y.id),
reach(id, c) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION
  SELECT l.b, min(r.c) FROM reach r JOIN link l ON l.a = r.id JOIN recurring.reach o ON o.id = l.b WHERE r.c < o.c GROUP BY l.b),
number AS (SELECT c, row_number() OVER (PARTITION BY scan, class ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM reach) JOIN lifted ON id = c),
owned AS (SELECT r.id, n.label FROM reach r JOIN number n USING (c)),
edge AS (SELECT n.a AS id, min(o.label) AS label FROM near n JOIN owned o ON n.b = o.id WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a),
labelled AS (SELECT l.*, o.id IS NOT NULL AS core, coalesce(o.label, e.label, -1) AS label FROM lifted l LEFT JOIN owned o USING (id) LEFT JOIN edge e USING (id))"""


@query(CLUSTERS + " SELECT id, scan, class, core, label FROM labelled")
def density_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and kind of every ellipse's centre."""
    return clustered(spark, sf_dir).select("id", "scan", "class", "core", "label")


def ellipsoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of clustered ellipses, by scan and class."""
    return S.bodies(clustered(spark, sf_dir), 0.5, "scan", "class")


BODIES = CLUSTERS + """,
areas AS (SELECT scan, class, label, axis, quantile_cont(area, 0.1) / quantile_cont(area, 0.9) AS ratio, sum(area) AS volume FROM labelled WHERE label >= 0 GROUP BY ALL),
b AS (SELECT scan, class, label, """ + ", ".join(f"avg(c{k}) AS c{k}, min(c{k}) AS min_{k}, max(c{k}) AS max_{k}, count(*) FILTER (axis = {k}) AS n_{k}" for k in range(3)) + """,
  list_sort([max(c0) - min(c0), max(c1) - min(c1), max(c2) - min(c2)]) AS s FROM labelled WHERE label >= 0 GROUP BY ALL),
found AS (SELECT b.*, a.volume, s[3] > 0 AND (s[2] / s[3] > 0.5 OR sqrt(a.ratio) > 0.5) AS keep FROM b JOIN (SELECT scan, class, label, max(volume) AS volume, min(ratio) AS ratio FROM areas GROUP BY ALL) a USING (scan, class, label))"""
CENTRE_SQL = ", ".join(f"round(c{k}, 4) + 0.0 AS c{k}, round(min_{k}, 4) + 0.0 AS min_{k}, round(max_{k}, 4) + 0.0 AS max_{k}, n_{k}" for k in range(3))


@query(BODIES + f" SELECT scan, class, label, {CENTRE_SQL}, round(volume, 2) AS volume, keep FROM found")
def ellipsoid_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [c for k in range(3) for c in (*[rounded(f"{n}{k}", 4).alias(f"{n}{k}") for n in ("c", "min_", "max_")], F.col(f"n_{k}"))]
    return ellipsoids(spark, sf_dir).select("scan", "class", "label", *shown, F.round("volume", 2).alias("volume"), "keep")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, scan, class, centre): the bodies kept, numbered in each scan, largest first."""
    place = F.row_number().over(W.partitionBy("scan").orderBy(F.desc(F.round("volume", 2)), "class", "label")) - 1
    centre = F.format_string("[%.2f %.2f %.2f]", F.round("c0", 2), F.round("c1", 2), F.round("c2", 2))
    return ellipsoids(spark, sf_dir).where("keep").select(place.cast("long").alias("id"), "scan", "class", centre.alias("centre"))


REPORT = BODIES + ", report AS (SELECT row_number() OVER (PARTITION BY scan ORDER BY round(volume, 2) DESC, class, label) - 1 AS id, scan, class, printf('[%.2f %.2f %.2f]', round(c0, 2), round(c1, 2), round(c2, 2)) AS centre FROM found WHERE keep)"


@query(REPORT + " SELECT * FROM report")
def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir)


@query(REPORT + ", p AS (SELECT scan, id, list_filter(string_split(trim(centre, '[]'), ' '), lambda t: t <> '') AS t FROM report) SELECT scan, id, round(t[1]::DOUBLE)::BIGINT AS c0, round(t[2]::DOUBLE)::BIGINT AS c1, round(t[3]::DOUBLE)::BIGINT AS c2 FROM p")
def centre_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's centres read back from their text."""
    parts = F.filter(F.split(F.trim("centre", F.lit("[]")), " "), lambda t: t != "")
    return report(spark, sf_dir).select("scan", "id", parts.alias("t")).select("scan", "id", *[F.round(F.col("t")[k].cast("double")).cast("long").alias(f"c{k}") for k in range(3)])


@query(ELL + ", o AS (SELECT scan, layer + d AS k, id, abs(d) AS far FROM lifted CROSS JOIN range(-2, 3) t(d) WHERE axis = 2) SELECT scan, k, arg_min(id, (far, id)) AS id, min(far) AS far FROM o GROUP BY scan, k")
def nearest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each slice, the ellipse of the axial plane on the nearest slice within two: a join by offset, not by range."""
    o = S.lifted(C.ell(spark, sf_dir)).where("axis = 2").select("scan", "layer", "id", F.explode(F.sequence(F.lit(-2).cast("long"), F.lit(2).cast("long"))).alias("d"))
    best = o.groupBy("scan", (F.col("layer") + F.col("d")).alias("k")).agg(F.min(F.struct(F.abs("d").alias("far"), F.col("id").alias("id"))).alias("m"))
    return best.select("scan", "k", F.col("m.id").alias("id"), F.col("m.far").alias("far"))


AWAY = "sqrt((c0 - 10) ** 2 + (c1 - 20) ** 2 + (c2 - 15) ** 2)"


@query(ELL + f" SELECT class, id, round({AWAY}, 6) AS away FROM lifted QUALIFY row_number() OVER (PARTITION BY class ORDER BY {AWAY}, id) <= 5")
def nearest_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five ellipses of each class nearest to a place (a top-k report)."""
    away = F.sqrt((F.col("c0") - 10) ** 2 + (F.col("c1") - 20) ** 2 + (F.col("c2") - 15) ** 2)
    e = S.lifted(C.ell(spark, sf_dir)).withColumn("away", away)
    return e.withColumn("k", F.row_number().over(W.partitionBy("class").orderBy("away", "id"))).where("k <= 5").select("class", "id", F.round("away", 6).alias("away"))


@query(ELL + f" SELECT class, scan, count(*) AS n, count(*) FILTER (area >= 225) AS large, round(min({AWAY}) FILTER (area >= 225), 6) AS nearest FROM lifted GROUP BY class, scan")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ellipses there are, how many are large, and how near the nearest large one is."""
    away = F.sqrt((F.col("c0") - 10) ** 2 + (F.col("c1") - 20) ** 2 + (F.col("c2") - 15) ** 2)
    large = F.col("area") >= 225
    return S.lifted(C.ell(spark, sf_dir)).groupBy("class", "scan").agg(F.count("*").alias("n"), F.count_if(large).alias("large"), F.round(F.min(F.when(large, away)), 6).alias("nearest"))


@query(f"WITH {CTE['vox']}, t AS (SELECT scan, z, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS t FROM vox WINDOW w AS (PARTITION BY scan, z)) SELECT scan, z, y, x, " + ", ".join(f"round(0.5 * t + 0.5 * least(greatest(1.5 - abs(4 * t - {k}), 0), 1), 6) AS {c}" for c, k in (("r", 3), ("g", 2), ("b", 1))) + " FROM t")
def heatmap_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half grey and half the blue-to-red colour of the value, scaled to the slice's range."""
    v = C.vox(spark, sf_dir)
    ends = v.groupBy("scan", "z").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    t = v.join(C.small(ends), ["scan", "z"]).select("scan", "z", "y", "x", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("t"))
    colour = lambda k: F.round(0.5 * F.col("t") + 0.5 * F.least(F.greatest(1.5 - F.abs(4 * F.col("t") - k), F.lit(0.0)), F.lit(1.0)), 6)
    return t.select("scan", "z", "y", "x", colour(3).alias("r"), colour(2).alias("g"), colour(1).alias("b"))

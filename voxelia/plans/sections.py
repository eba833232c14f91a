"""Queries on clusters and ellipses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators import sections as S
from voxelia.registry import query

ELL = f"WITH {CTE['ell']}, lifted AS (SELECT *, CASE axis WHEN 0 THEN layer WHEN 1 THEN cy ELSE cy END::DOUBLE AS c0, CASE axis WHEN 0 THEN cy WHEN 1 THEN layer ELSE cx END::DOUBLE AS c1, CASE axis WHEN 2 THEN layer ELSE cx END::DOUBLE AS c2, short * long * pi() / 4 AS area FROM ell)"
#: (label, place, spread) of the centres that the queries use.
CENTRES = [(0, 500.0, 300.0), (1, 1500.0, 250.0), (2, 3000.0, 800.0)]
VALUES = ", ".join(map(str, CENTRES))


@query(f"WITH {CTE['vox']}, c(label, place, spread) AS (VALUES {VALUES}), r AS (SELECT v.*, c.*, row_number() OVER (PARTITION BY scan, z, y, x ORDER BY abs(v - place), label) AS k FROM vox v, c) SELECT scan, z, y, x, label::BIGINT AS label, round(exp(-abs(v - place) / (1e-7 + spread)), 6) AS membership FROM r WHERE k = 1")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_centre(C.vox(spark, sf_dir), CENTRES).select("scan", "z", "y", "x", "label", rounded("membership").alias("membership"))


@query(ELL + " SELECT id, c0, c1, c2, round(area, 4) AS area FROM lifted")
def ellipse_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lifted(C.ell(spark, sf_dir)).select("id", "c0", "c1", "c2", F.round("area", 4).alias("area"))


@query(ELL + " SELECT a.class, a.c0, a.c1, a.c2, count(*) AS n, count(*) >= 5 AS core FROM (SELECT DISTINCT class, c0, c1, c2 FROM lifted) a JOIN lifted b ON a.class = b.class AND (a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 <= 4 GROUP BY ALL")
def density_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = S.lifted(C.ell(spark, sf_dir)).withColumnRenamed("class", "group")
    return S.neighbour_counts(points, 2.0, 5).withColumnRenamed("group", "class")


@query(ELL + " SELECT class, axis, round(quantile_cont(area, 0.1), 4) AS p10, round(quantile_cont(area, 0.9), 4) AS p90, round(min(area), 4) AS least, round(max(area), 4) AS most, round(sum(area), 2) AS volume, count(*) AS n, round(quantile_cont(area, 0.1) / quantile_cont(area, 0.9), 6) AS ratio FROM lifted GROUP BY class, axis")
def axial_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.area_statistics(S.lifted(C.ell(spark, sf_dir)), "class", "axis")
    return out.select("class", "axis", *[F.round(c, 4).alias(c) for c in ("p10", "p90", "least", "most")], F.round("volume", 2).alias("volume"), "n", F.round("ratio", 6).alias("ratio"))


@query(ELL + " SELECT id, sum(short) OVER (w ROWS UNBOUNDED PRECEDING) / sum(short) OVER (PARTITION BY class) > 0.4 AS keep FROM lifted WINDOW w AS (PARTITION BY class ORDER BY short, id)")
def mass_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.heavy(C.ell(spark, sf_dir).withColumn("v", F.col("short")), 0.6, "class", order="id").select("id", "keep")

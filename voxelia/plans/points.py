"""Queries on point sets and registration: extraction, distances, matches, shifts by phase correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators.sections import quantiles
from voxelia.registry import query

PTS = f"WITH {CTE['pts']}"
#: Control points (label, z, y, x) that points are held against.
CONTROL = [(0, 1.0, 3.0, 4.0), (1, 4.0, 8.0, 8.0), (2, 6.0, 12.0, 11.0)]
CONTROL_SQL = f"ctl(label, cz, cy, cx) AS (VALUES {', '.join(map(str, CONTROL))})"


def controls() -> F.Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("label", "cz", "cy", "cx"), p, strict=True)]) for p in CONTROL]))


@query(PTS + " SELECT scan, z, y, x, v FROM pts")
def bright_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pts(spark, sf_dir)


@query(PTS + " SELECT scan, z - 2 AS z, y - 2 AS y, x - 2 AS x FROM pts WHERE z BETWEEN 2 AND 5 AND y BETWEEN 2 AND 13 AND x BETWEEN 2 AND 13")
def interior_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that aren't within two voxels of the border, counted from there."""
    inside = (F.col("z").between(2, C.DEPTH - 3)) & F.col("y").between(2, C.SIDE - 3) & F.col("x").between(2, C.SIDE - 3)
    return C.pts(spark, sf_dir).where(inside).select("scan", *[(F.col(c) - 2).alias(c) for c in "zyx"])


@query(PTS + ", n AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY z, y, x) - 1 AS k, count(*) OVER (PARTITION BY scan) AS n FROM pts) SELECT scan, z, y, x FROM n WHERE n <= 10 OR k % (n // 10) = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n // 10th point of a scan that has more than ten."""
    w = W.partitionBy("scan")
    n = C.pts(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy("z", "y", "x")) - 1).withColumn("n", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    return n.where((F.col("n") <= 10) | (F.col("k") % step == 0)).select("scan", "z", "y", "x")


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.sqrt((F.col("z") - F.col("c.cz")) ** 2 + (F.col("y") - F.col("c.cy")) ** 2 + (F.col("x") - F.col("c.cx")) ** 2)
    return C.pts(spark, sf_dir).select("scan", "z", "y", "x", controls().alias("c")).select("scan", "z", "y", "x", F.col("c.label").cast("long").alias("label"), far.alias("d"))


DIST = PTS + f", {CONTROL_SQL}, dist AS (SELECT scan, z, y, x, label::BIGINT AS label, sqrt((z - cz) ** 2 + (y - cy) ** 2 + (x - cx) ** 2) AS d FROM pts CROSS JOIN ctl)"


@query(DIST + " SELECT scan, z, y, x, label, round(d, 6) + 0.0 AS d FROM dist")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all points to the control points, which are a constant and need no join."""
    return distances(spark, sf_dir).withColumn("d", rounded("d"))


@query(PTS + " SELECT scan, count(*) AS n, round(regr_slope(v, x), 4) + 0.0 AS slope, round(regr_intercept(v, x), 4) + 0.0 AS intercept FROM pts WHERE (z - 4) ** 2 + (y - 8) ** 2 + (x - 8) ** 2 < 64 GROUP BY scan")
def radial_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of the value on x, over the points within 8 of the middle."""
    near = C.pts(spark, sf_dir).where((F.col("z") - 4) ** 2 + (F.col("y") - 8) ** 2 + (F.col("x") - 8) ** 2 < 64)
    return near.groupBy("scan").agg(F.count("*").alias("n"), rounded(F.regr_slope("v", "x"), 4).alias("slope"), rounded(F.regr_intercept("v", "x"), 4).alias("intercept"))


def phase_shifts(voxels: DataFrame, group: str = "pair") -> DataFrame:
    """(group, dz, dy, dx): how far scan 1 of each group's two scans is rolled against scan 0, by phase correlation.

    Every group is one pair of dense volumes and one task's work, however many pairs there are.
    """

    def shift(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(["scan", "z", "y", "x"])
        shape = tuple(own[a].nunique() for a in "zyx")
        a, b = (np.fft.fftn(own.loc[own.scan == s, "v"].to_numpy().reshape(shape)) for s in (0, 1))
        cross = a * np.conj(b)
        peak = np.unravel_index(np.argmax(np.fft.ifftn(cross / (np.abs(cross) + 1e-10)).real.round(9)), shape)
        moved = [n - p if p > n / 2 else -p for p, n in zip(peak, shape, strict=True)]
        return pd.DataFrame([[rows[group].iloc[0], *map(int, moved)]], columns=[group, "dz", "dy", "dx"])

    return voxels.groupBy(group).applyInPandas(shift, f"{group} long, dz long, dy long, dx long")


SHIFTS = "SELECT (l_linestatus = 'F')::BIGINT AS pair, 2::BIGINT AS dz, -3::BIGINT AS dy, 4::BIGINT AS dx FROM lineitem GROUP BY ALL"


@query(SHIFTS)
def phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each pair's second volume is rolled, found again."""
    return phase_shifts(C.rolled(spark, sf_dir))


@query(f"SELECT pair * 2 + i AS pair, dz, dy, dx FROM ({SHIFTS}) CROSS JOIN range(2) t(i)")
def local_region_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a region of each volume alone: of 13 voxels a side, and of 14."""
    part = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("part")
    v = C.rolled(spark, sf_dir).select("*", part)
    region = F.col("z").between(1, 13 + F.col("part")) & F.col("y").between(0, 12 + F.col("part")) & F.col("x").between(2 - F.col("part"), 14)
    return phase_shifts(v.where(region).withColumn("pair", F.col("pair") * 2 + F.col("part")))


@query(f"WITH {CTE['rolled']}, c AS (SELECT pair, quantile_cont(v, 0.5) AS cut FROM rolled WHERE scan = 0 GROUP BY pair) SELECT a.pair, count(*) AS n FROM rolled a JOIN c ON a.pair = c.pair JOIN rolled b ON a.pair = b.pair AND a.scan = 0 AND b.scan = 1 AND a.z = b.z - 2 AND a.y = b.y + 3 AND a.x = b.x - 4 WHERE a.v > cut AND b.v > cut GROUP BY a.pair")
def aligned_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels above the median that a pair's scans share once the second is moved back by its phase shift."""
    v = C.rolled(spark, sf_dir)
    cut = quantiles(v.where("scan = 0"), "v", {"cut": 0.5}, "pair")
    bright = v.join(C.small(cut), "pair").where("v > cut").select("pair", "scan", "z", "y", "x")
    shift = C.small(phase_shifts(v))  # a row for each pair
    b = bright.where("scan = 1").join(shift, "pair").select("pair", *[(F.col(c) - F.col(f"d{c}")).alias(c) for c in "zyx"])
    return bright.where("scan = 0").drop("scan").join(b, ["pair", "z", "y", "x"]).groupBy("pair").agg(F.count("*").alias("n"))

"""Queries on large kernels: the mean over a ball, and the bank of texton kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators import blocks
from voxelia.registry import query

SIZES = {"z": C.DEPTH, "y": C.SIDE, "x": C.SIDE}
BALL = f"WITH {CTE['vox']}, d AS (SELECT a.scan, a.z, a.y, a.x, a.v, b.v AS w, (b.z - a.z + 12) % 8 - 4 AS dz, (b.y - a.y + 24) % 16 - 8 AS dy, (b.x - a.x + 24) % 16 - 8 AS dx FROM vox a JOIN vox b ON a.scan = b.scan), m AS (SELECT scan, z, y, x, v, v - abs(avg(w)) AS left_ FROM d WHERE dz * dz + dy * dy + dx * dx <= 100 GROUP BY scan, z, y, x, v)"


@query(BALL + " SELECT scan, z, y, x, round(CASE WHEN abs(left_) < 1e-10 THEN 0 ELSE left_ END, 5) + 0.0 AS v FROM m")
def ball_mean_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume less its mean over a ball of radius 10, by blocks of 8 cells with halos."""
    return blocks.less_ball_mean(C.vox(spark, sf_dir), 10, SIZES, ("scan",), block=8).select("scan", *SIZES, rounded("v", 5).alias("v"))


@query(BALL + ", c AS (SELECT scan, quantile_cont(left_, 0.98) AS cut FROM m GROUP BY scan) SELECT scan, z, y, x FROM m JOIN c USING (scan) WHERE left_ > cut + 1e-9 AND z BETWEEN 2 AND 5 AND y BETWEEN 2 AND 13 AND x BETWEEN 2 AND 13")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels more than two from the border whose value, less the mean over the ball, is above the 98th percentile of its scan."""
    from voxelia.operators.sections import quantiles

    v = blocks.less_ball_mean(C.vox(spark, sf_dir), 10, SIZES, ("scan",), block=8)
    inside = F.col("z").between(2, C.DEPTH - 3) & F.col("y").between(2, C.SIDE - 3) & F.col("x").between(2, C.SIDE - 3)
    return v.join(quantiles(v, "v", {"cut": 0.98}, "scan"), "scan").where(inside & (F.col("v") > F.col("cut") + 1e-9)).select("scan", *SIZES)


MIRRORED = "CASE WHEN {0} + {1} < 0 THEN -({0} + {1}) WHEN {0} + {1} >= 16 THEN 30 - ({0} + {1}) ELSE {0} + {1} END"
TEXTONS = f"""WITH {CTE['vox']},
waves AS (SELECT 'gabor_' || a || '_' || s || '_' || f AS kernel, pi() * a / 7 AS t, (1 + s)::DOUBLE AS sigma, 0.9::DOUBLE + 2.3::DOUBLE * f AS f FROM range(8) a(a), range(2) b(s), range(2) c(f)),
ends AS (SELECT *, ceil(greatest(abs(3 * sigma * cos(t)), abs(3 * sigma * sin(t)), 1)) AS r FROM waves),
rings AS (SELECT 'ring_' || f AS kernel, dy, dx, abs(cos(sqrt(dy * dy + dx * dx) * (2 + 3 * f)) * exp(-(dy * dy + dx * dx) / 9.0::DOUBLE)) AS w FROM range(2) c(f), range(-3, 4) p(dy), range(-3, 4) q(dx)),
bank AS (
  SELECT kernel, dy, dx, exp(-0.5::DOUBLE * (dx * dx + dy * dy) / (sigma * sigma)) / (2 * pi() * sigma * sigma) * cos(2 * pi() * f * (dx * cos(t) + dy * sin(t))) AS w FROM ends, range(-6, 7) p(dy), range(-6, 7) q(dx) WHERE abs(dy) <= r AND abs(dx) <= r
  UNION ALL SELECT kernel, dy, dx, w / sum(w) OVER (PARTITION BY kernel) FROM rings
  UNION ALL SELECT 'intensity', 0, 0, 1.0::DOUBLE),
place AS (SELECT scan, z, y, x, dy, dx, {MIRRORED.format('y', 'dy')} AS ny, {MIRRORED.format('x', 'dx')} AS nx FROM vox, range(-6, 7) p(dy), range(-6, 7) q(dx)),
near AS MATERIALIZED (SELECT p.scan, p.z, p.y, p.x, dy, dx, n.v FROM place p JOIN vox n ON n.scan = p.scan AND n.z = p.z AND n.y = p.ny AND n.x = p.nx)"""


@query(TEXTONS + " SELECT scan, z, y, x, kernel, round(sum(w * v), 4) + 0.0 AS response FROM near JOIN bank USING (dy, dx) GROUP BY scan, z, y, x, kernel")
def texton_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response of every slice to each of the 35 texton kernels, mirrored at the edges."""
    found = blocks.correlated(C.vox(spark, sf_dir), blocks.bank(), {"y": C.SIDE, "x": C.SIDE}, "reflect", ("scan", "z"), block=16)
    long = found.unpivot(["scan", "z", "y", "x"], list(blocks.bank()), "kernel", "response")
    return long.withColumn("response", rounded(F.col("response"), 4))

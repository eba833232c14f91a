"""Queries on clusters that are fitted to the data: mean shift, labels from it, a second level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators import modes as M
from voxelia.registry import query


def shifted(hist: str, name: str, unit: float) -> str:
    """CTEs that fit mean-shift clusters to hist (g, bin, n); the last, ``name``, has (g, label, centre, deviation, n)."""
    n = name
    return f"""
{n}_size AS (SELECT g, sum(n)::BIGINT AS total, greatest(1, floor(sum(n)::DOUBLE * 0.3::DOUBLE))::BIGINT AS k FROM {hist} GROUP BY g),
{n}_far AS (SELECT g, bin, n, d, sum(m) OVER (PARTITION BY g, bin ORDER BY d) AS upto FROM (SELECT a.g, a.bin, a.n, abs(a.bin - b.bin) AS d, b.n AS m FROM {hist} a JOIN {hist} b ON a.g = b.g)),
{n}_kth AS (SELECT f.g, f.bin, any_value(f.n) AS n, min(d) AS d FROM {n}_far f JOIN {n}_size s ON f.g = s.g AND f.upto >= s.k GROUP BY f.g, f.bin),
{n}_width AS MATERIALIZED (SELECT t.g, sum(t.n * t.d)::DOUBLE / any_value(s.total) AS width FROM {n}_kth t JOIN {n}_size s ON t.g = s.g GROUP BY t.g),
{n}_walk(g, seed, place, inside, moving, k) AS (
  SELECT g, bin, bin::DOUBLE, 0::HUGEINT, true, 0 FROM {hist}
  UNION ALL
  SELECT w.g, w.seed, sum(h.n * h.bin)::DOUBLE / sum(h.n)::DOUBLE, sum(h.n)::HUGEINT, abs(sum(h.n * h.bin)::DOUBLE / sum(h.n)::DOUBLE - w.place) > 1e-3::DOUBLE * x.width, w.k + 1
  FROM {n}_walk w JOIN {n}_width x ON x.g = w.g JOIN {hist} h ON h.g = w.g AND h.bin BETWEEN w.place - x.width AND w.place + x.width
  WHERE w.moving AND w.k <= 300 GROUP BY w.g, w.seed, w.place, w.k, x.width),
{n}_end AS (SELECT g, place, max(inside) AS inside FROM {n}_walk w JOIN (SELECT g, seed, max(k) AS k FROM {n}_walk GROUP BY g, seed) l USING (g, seed, k) GROUP BY g, place),
{n}_rank AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY inside DESC, place DESC) AS r FROM {n}_end),
{n}_pick(g, r, stay) AS (
  SELECT g, 1, [place] FROM {n}_rank WHERE r = 1
  UNION ALL
  SELECT p.g, p.r + 1, CASE WHEN len(list_filter(p.stay, lambda q: abs(q - k.place) <= x.width)) = 0 THEN list_append(p.stay, k.place) ELSE p.stay END
  FROM {n}_pick p JOIN {n}_rank k ON k.g = p.g AND k.r = p.r + 1 JOIN {n}_width x ON x.g = p.g),
{n}_modes AS (SELECT g, unnest(stay) AS place, generate_subscripts(stay, 1) - 1 AS label FROM (SELECT g, arg_max(stay, r) AS stay FROM {n}_pick GROUP BY g)),
{n}_own AS (SELECT h.g, h.bin, h.n, m.label, abs(h.bin - m.place) AS d FROM {hist} h JOIN {n}_modes m ON h.g = m.g QUALIFY row_number() OVER (PARTITION BY h.g, h.bin ORDER BY abs(h.bin - m.place), m.label) = 1),
{n} AS MATERIALIZED (SELECT m.g, m.label, any_value(m.place) * {unit}::DOUBLE AS centre, sqrt(greatest(sum(o.n * o.d * o.d) / sum(o.n) - (sum(o.n * o.d) / sum(o.n)) ** 2, 0)) * {unit}::DOUBLE AS deviation, sum(o.n)::BIGINT AS n
  FROM {n}_modes m JOIN {n}_own o ON o.g = m.g AND o.label = m.label GROUP BY m.g, m.label)"""


UNIT, SUB_UNIT = 1.0, 0.001
FITTED = f"WITH RECURSIVE {CTE['vox']}, hist AS MATERIALIZED (SELECT scan AS g, round(v / {UNIT}::DOUBLE)::BIGINT AS bin, count(*) AS n FROM vox GROUP BY ALL), {shifted('hist', 'fits', UNIT)}"


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_shift(M.histogram(C.vox(spark, sf_dir), UNIT, "scan"), UNIT, "scan")


@query(FITTED + " SELECT g AS scan, label, round(centre, 4) AS centre, round(deviation, 4) AS deviation, n FROM fits")
def mean_shift_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each scan's values."""
    return fits(spark, sf_dir).select("scan", "label", F.round("centre", 4).alias("centre"), F.round("deviation", 4).alias("deviation"), "n")


LABELS = FITTED + ", score AS MATERIALIZED (SELECT scan, z, y, x, label, exp(-abs(v - centre) / (1e-7::DOUBLE + deviation)) AS membership FROM vox JOIN fits ON scan = g QUALIFY row_number() OVER (PARTITION BY scan, z, y, x ORDER BY abs(v - centre), label) = 1)"


@query(LABELS + " SELECT scan, z, y, x, label, round(membership, 6) AS membership FROM score")
def fitted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted cluster of every voxel and its membership there."""
    found = M.assigned(C.vox(spark, sf_dir), fits(spark, sf_dir), "scan")
    return found.select("scan", "z", "y", "x", "label", rounded("membership").alias("membership"))


HIERARCHY = LABELS + f", sub_hist AS MATERIALIZED (SELECT {{'scan': scan, 'label': label}} AS g, round(membership / {SUB_UNIT}::DOUBLE)::BIGINT AS bin, count(*) AS n FROM score GROUP BY ALL), {shifted('sub_hist', 'subs', SUB_UNIT)}"


@query(HIERARCHY + " SELECT g.scan AS scan, g.label AS label, label AS sub, round(centre, 4) AS centre, round(deviation, 4) AS deviation, n FROM subs")
def hierarchical_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-level clusters, fitted to the memberships of each first-level cluster's own voxels."""
    out = M.second_level(C.vox(spark, sf_dir), fits(spark, sf_dir), SUB_UNIT, "scan")
    return out.select("scan", "label", "sub", F.round("centre", 4).alias("centre"), F.round("deviation", 4).alias("deviation"), "n")


@query(HIERARCHY + """, place AS (SELECT g.scan AS scan, g.label AS first, count(*) AS k FROM subs GROUP BY ALL),
offsets AS (SELECT scan, first, coalesce(sum(k) OVER (PARTITION BY scan ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM place),
best AS (SELECT s.scan, s.z, s.y, s.x, s.label AS first, u.label AS sub FROM score s JOIN subs u ON u.g.scan = s.scan AND u.g.label = s.label QUALIFY row_number() OVER (PARTITION BY s.scan, s.z, s.y, s.x ORDER BY abs(s.membership - u.centre), u.label) = 1)
SELECT b.scan, z, y, x, b.first AS label, sub, (sub + below)::BIGINT AS "full" FROM best b JOIN offsets o ON b.scan = o.scan AND b.first = o.first""")
def fitted_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels' labels of every voxel, from fitted centres."""
    v, first = C.vox(spark, sf_dir), fits(spark, sf_dir)
    subs = M.second_level(v, first, SUB_UNIT, "scan")
    return M.full_labels(v, first, subs, "scan").select("scan", "z", "y", "x", "label", "sub", "full")

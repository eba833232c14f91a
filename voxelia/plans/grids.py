"""Queries on voxel grids: intensity, neighbourhoods, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.operators import grid as G
from voxelia.operators.knee import knees, smoothed_histogram
from voxelia.registry import query

VOX = f"WITH {CTE['vox']}"
CELL = ["scan", "z", "y", "x"]
IMAGE = ("scan", "z")
PLANE = {"y": 16, "x": 16}
SPACE = {"z": 8, "y": 16, "x": 16}


@query(VOX + " SELECT scan, z, y, x, CASE WHEN max(v) OVER w > min(v) OVER w THEN floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255)::BIGINT ELSE 0 END AS u8 FROM vox WINDOW w AS (PARTITION BY scan, z)")
def minmax_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.minmax_u8(C.vox(spark, sf_dir), "scan", "z").select(*CELL, F.col("u8").cast("long").alias("u8"))


@query(VOX + " SELECT scan, z, y, x, floor(least(v, 2000.0) / 2000.0 * 255)::BIGINT AS u8 FROM vox")
def clip_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clip_u8(C.vox(spark, sf_dir), 2000.0).select(*CELL, "u8")


@query(VOX + " SELECT scan, z, y, x, round(v * (1 / max(v) OVER (PARTITION BY scan)), 6) AS share FROM vox")
def divide_by_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.by_max(C.vox(spark, sf_dir), "scan").select(*CELL, F.round("share", 6).alias("share"))


@query(VOX + " SELECT scan, z, y, x, round(v / (greatest(max(v) OVER w, 1.0) - min(v) OVER w), 6) AS scaled FROM vox WINDOW w AS (PARTITION BY scan)")
def range_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.by_range(C.vox(spark, sf_dir), "scan").select(*CELL, F.round("scaled", 6).alias("scaled"))


@query(VOX + " SELECT scan, z, y, x, CASE WHEN v < 500 THEN 0.0 ELSE v END AS v FROM vox")
def threshold_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zero_below(C.vox(spark, sf_dir), 500.0).select(*CELL, "v")


@query(VOX + ", m AS (SELECT avg(v) AS m FROM vox WHERE scan = 0) SELECT a.z, a.y, a.x, round(b.v / (m + abs(a.v - m)), 6) AS a FROM vox a JOIN vox b USING (z, y, x), m WHERE a.scan = 0 AND b.scan = 1")
def anomaly_renormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.vox(spark, sf_dir)
    scan, anomaly = v.where("scan = 0"), v.where("scan = 1").select("z", "y", "x", F.col("v").alias("a"))
    mean = F.broadcast(scan.agg(F.avg("v").alias("m")))  # one row
    return scan.join(anomaly, ["z", "y", "x"]).join(mean).select("z", "y", "x", F.round(F.col("a") / (F.col("m") + F.abs(F.col("v") - F.col("m"))), 6).alias("a"))


@query(VOX + ", c(z, mean, std) AS (VALUES (0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)) SELECT scan, z, y, x, round((v / 2000.0 - mean) / std, 6) AS n FROM vox JOIN c USING (z)")
def channel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.broadcast(spark.createDataFrame([(0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)], "z long, mean double, std double"))
    return C.vox(spark, sf_dir).join(c, "z").select(*CELL, F.round((F.col("v") / 2000.0 - F.col("mean")) / F.col("std"), 6).alias("n"))


@query(VOX + ", s AS (SELECT *, v - min(v) OVER w AS d, max(v) OVER w AS top FROM vox WINDOW w AS (PARTITION BY scan, z)) SELECT scan, z, y, x, round(CASE WHEN top > 0 THEN CASE WHEN max(d) OVER w2 > 0 THEN d / max(d) OVER w2 ELSE d END ELSE v END, 6) AS m FROM s WINDOW w2 AS (PARTITION BY scan, z)")
def mask_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("scan", "z")
    d = C.vox(spark, sf_dir).withColumn("d", F.col("v") - F.min("v").over(w)).withColumn("top", F.max("v").over(w)).withColumn("most", F.max("d").over(w))
    scaled = F.when(F.col("most") > 0, F.col("d") / F.col("most")).otherwise(F.col("d"))
    return d.select(*CELL, F.round(F.when(F.col("top") > 0, scaled).otherwise(F.col("v")), 6).alias("m"))


@query(VOX + " SELECT k, z, y, coalesce(v, 0.0) AS v FROM (SELECT k, z, y FROM (VALUES (3), (20)) t(k), (SELECT DISTINCT z, y FROM vox)) g LEFT JOIN (SELECT x AS k, z, y, v FROM vox WHERE scan = 0) f USING (k, z, y)")
def plane_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sagittal planes; the one beyond the volume is blank."""
    k = spark.createDataFrame([(3,), (20,)], "k long")
    cells = C.grid(spark, z=8, y=16).join(F.broadcast(k))
    plane = C.vox(spark, sf_dir).where("scan = 0").select(F.col("x").alias("k"), "z", "y", "v")
    return cells.join(plane, ["k", "z", "y"], "left").select("k", "z", "y", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(VOX + " SELECT z, y, x, CASE z WHEN 4 THEN 255 ELSE floor(v)::BIGINT END AS v, CASE z WHEN 4 THEN 64 ELSE 255 END::BIGINT AS alpha FROM vox WHERE scan = 0 AND z >= 4")
def half_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume from a plane on, with the plane itself overwritten half transparent."""
    at = F.col("z") == 4
    return C.vox(spark, sf_dir).where("scan = 0 and z >= 4").select("z", "y", "x", F.when(at, F.lit(255).cast("long")).otherwise(F.floor("v")).alias("v"), F.when(at, 64).otherwise(255).cast("long").alias("alpha"))


@query("SELECT p_partkey, c, (p_partkey % 4 = c)::BIGINT AS hot FROM part, range(4) t(c)")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: (F.col("p_partkey") % 4 == c).cast("long"))
    return C.table(spark, sf_dir, "part").select("p_partkey", F.posexplode(hot).alias("c", "hot")).withColumn("c", F.col("c").cast("long"))


@query(VOX + ", u AS (SELECT *, floor(least(v, 2000.0) / 2000.0 * 255)::BIGINT AS u FROM vox) SELECT scan, z, y, x, CASE WHEN u >= 128 THEN 255 - u ELSE u END AS s FROM u")
def solarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u8")
    return G.clip_u8(C.vox(spark, sf_dir), 2000.0).select(*CELL, F.when(u >= 128, 255 - u).otherwise(u).alias("s"))


@query(VOX + ", u AS (SELECT *, floor(least(v, 2000.0) / 2000.0 * 255) AS u FROM vox), c(scan, r, g, b) AS (VALUES (0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.5)) SELECT z, y, x, round(sum(u * r), 6) AS r, round(sum(u * g), 6) AS g, round(sum(u * b), 6) AS b, round(sum(power(u / 255, 2) * 255 * 0.6), 6) AS a FROM u JOIN c USING (scan) GROUP BY z, y, x")
def rgba_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.broadcast(spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.5)], "scan long, r double, g double, b double"))
    u = G.clip_u8(C.vox(spark, sf_dir), 2000.0).join(c, "scan")
    cols = [F.round(F.sum(F.col("u8") * F.col(k)), 6).alias(k) for k in "rgb"]
    return u.groupBy("z", "y", "x").agg(*cols, F.round(F.sum(F.pow(F.col("u8") / 255, 2) * 255 * 0.6), 6).alias("a"))


@query(VOX + " SELECT scan, z, y, x, round(v * (1 - 0.5 * (v > 1000)::INT) + 0.5 * (v > 1000)::INT * 0.25 * 255, 6) AS c FROM vox")
def alpha_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.col("v") > 1000).cast("int")
    return C.vox(spark, sf_dir).select(*CELL, F.round(F.col("v") * (1 - 0.5 * m) + 0.5 * m * 0.25 * 255, 6).alias("c"))


@query(VOX + ", u AS (SELECT *, floor(least(v, 2000.0) / 2000.0 * 255)::BIGINT AS u FROM vox), h AS (SELECT scan, z, u, sum(count(*)) OVER (PARTITION BY scan, z ORDER BY u) AS below FROM u GROUP BY scan, z, u), k AS (SELECT *, min(below) OVER (PARTITION BY scan, z) AS least FROM h) SELECT scan, z, u, round((below - least)::DOUBLE / greatest(256 - least, 1) * 255)::BIGINT AS e FROM k")
def equalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram equalisation table of every slice, by level."""
    n = G.clip_u8(C.vox(spark, sf_dir), 2000.0).groupBy("scan", "z", F.col("u8").alias("u")).count()
    below = n.withColumn("below", F.sum("count").over(W.partitionBy("scan", "z").orderBy("u"))).withColumn("least", F.min("below").over(W.partitionBy("scan", "z")))
    return below.select("scan", "z", "u", F.round((F.col("below") - F.col("least")) / F.greatest(256 - F.col("least"), F.lit(1)) * 255).cast("long").alias("e"))


@query(VOX + " SELECT scan, z, y, x, CASE WHEN power(least(y, 16 - y), 2) + power(least(x, 16 - x), 2) <= 25 THEN v ELSE 0.0 END AS v FROM vox")
def disk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slice cut to a disk of radius 5 around its first cell, the slice wrapping round."""
    d = [F.least(F.col(a), C.SIDE - F.col(a)) for a in "yx"]
    return C.vox(spark, sf_dir).select(*CELL, F.when(d[0] * d[0] + d[1] * d[1] <= 25, F.col("v")).otherwise(0.0).alias("v"))


@query(VOX + " SELECT scan, z, y, x, CASE WHEN power(least(z, 8 - z), 2) + power(least(y, 16 - y), 2) + power(least(x, 16 - x), 2) <= 16 THEN v ELSE 0.0 END AS v FROM vox")
def ball_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume cut to a ball of radius 4 around its first cell, the volume wrapping round."""
    d = [F.least(F.col(a), n - F.col(a)) for a, n in (("z", C.DEPTH), ("y", C.SIDE), ("x", C.SIDE))]
    return C.vox(spark, sf_dir).select(*CELL, F.when(sum((k * k for k in d), F.lit(0)) <= 16, F.col("v")).otherwise(0.0).alias("v"))


@query(VOX + " SELECT i.scan, i.z, i.y, i.x, sum(n.v) AS s FROM vox i CROSS JOIN range(-2, 3) p(dy) CROSS JOIN range(-2, 3) q(dx) JOIN vox n ON n.scan = i.scan AND n.z = i.z AND n.y = (i.y + dy + 16) % 16 AND n.x = (i.x + dx + 16) % 16 WHERE dy * dy + dx * dx <= 4 GROUP BY i.scan, i.z, i.y, i.x")
def circular_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.weighted_sum(G.neighbours(C.vox(spark, sf_dir), G.disk(2), PLANE, "wrap", IMAGE), *CELL)


LMR = """, near AS (SELECT i.scan, i.z, i.y, i.x, avg(n.v) AS m FROM vox i CROSS JOIN range(-3, 4) p(dy) CROSS JOIN range(-3, 4) q(dx) JOIN vox n ON n.scan = i.scan AND n.z = i.z AND n.y = (i.y + dy + 16) % 16 AND n.x = (i.x + dx + 16) % 16 WHERE dy * dy + dx * dx <= 9 GROUP BY i.scan, i.z, i.y, i.x),
lmr AS (SELECT scan, z, y, x, CASE WHEN abs(v - abs(m)) < 1e-10 THEN 0.0 ELSE v - abs(m) END AS v FROM vox JOIN near USING (scan, z, y, x))"""


@query(VOX + LMR + " SELECT scan, z, y, x, round(v, 6) + 0.0 AS v FROM lmr")
def local_mean_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.less_local_mean(C.vox(spark, sf_dir), G.disk(3), PLANE, IMAGE).select(*CELL, rounded("v").alias("v"))


CROSS = """, hit AS (SELECT DISTINCT i.scan, i.z, i.y, i.x FROM lmr i CROSS JOIN range(2) p(dy) CROSS JOIN range(2) q(dx) JOIN lmr n ON n.scan = i.scan AND n.z = i.z AND n.y = i.y + dy AND n.x = i.x + dx WHERE dy + dx > 0 AND i.y < 15 AND i.x < 15 AND abs(i.v - n.v) > 50 AND i.v * n.v < 0)"""


@query(VOX + LMR + CROSS + " SELECT scan, z, y, x, (h.y IS NOT NULL)::BIGINT AS crossing, round(CASE WHEN h.y IS NOT NULL THEN l.v ELSE 0.0 END, 6) + 0.0 AS weighted FROM lmr l LEFT JOIN hit h USING (scan, z, y, x)")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero crossings of every slice after local mean removal, and the slice where they are."""
    found = G.zero_crossings(G.less_local_mean(C.vox(spark, sf_dir), G.disk(3), PLANE, IMAGE), PLANE, 50.0, IMAGE)
    return found.select(*CELL, F.col("crossing").cast("long").alias("crossing"), rounded(F.when(F.col("crossing"), F.col("v")).otherwise(0.0)).alias("weighted"))


REFLECT = "(CASE WHEN {a} < 0 THEN -({a}) WHEN {a} >= 16 THEN 30 - ({a}) ELSE {a} END)"
AT = f"n.y = {REFLECT.format(a='i.y + dy')} AND n.x = {REFLECT.format(a='i.x + dx')}"


@query(VOX + f" SELECT i.scan, i.z, i.y, i.x, round(sum(n.v) / 9, 6) AS b FROM vox i CROSS JOIN range(-1, 2) p(dy) CROSS JOIN range(-1, 2) q(dx) JOIN vox n ON n.scan = i.scan AND n.z = i.z AND {AT} GROUP BY i.scan, i.z, i.y, i.x")
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.weighted_sum(G.neighbours(C.vox(spark, sf_dir), [(y, x, 1.0) for y, x, _ in G.box(3)], PLANE, "reflect", IMAGE), *CELL)
    return s.select(*CELL, F.round(F.col("s") / 9, 6).alias("b"))


@query(VOX + f", k AS (SELECT dy, dx, abs(cos(sqrt(dy * dy + dx * dx) * pi() / 4) * exp(-(dy * dy + dx * dx) / 4.0::DOUBLE)) AS w FROM range(-3, 4) p(dy), range(-3, 4) q(dx)) SELECT i.scan, i.z, i.y, i.x, round(sum(n.v * w) / (SELECT sum(w) FROM k), 6) + 0.0 AS f FROM vox i CROSS JOIN k JOIN vox n ON n.scan = i.scan AND n.z = i.z AND {AT} GROUP BY i.scan, i.z, i.y, i.x")
def circular_cosine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring cosine of frequency pi / 4 that decays with sigma 2, over its sum, on every slice."""
    from math import pi

    from voxelia.operators.blocks import correlated, ring_cosine

    found = correlated(C.vox(spark, sf_dir), {"f": ring_cosine(pi / 4, 2.0)}, PLANE, "reflect", IMAGE, block=8)
    return found.select(*CELL, rounded("f").alias("f"))


@query(VOX + " SELECT i.scan, i.z, i.y, i.x, median(coalesce(n.v, 0.0)) AS m FROM vox i CROSS JOIN range(-1, 2) p(dy) CROSS JOIN range(-1, 2) q(dx) LEFT JOIN vox n ON n.scan = i.scan AND n.z = i.z AND n.y = i.y + dy AND n.x = i.x + dx GROUP BY i.scan, i.z, i.y, i.x")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of 3 x 3, zeros outside: those that are missing at the border are put in by number."""
    near = G.neighbours(C.vox(spark, sf_dir), G.box(3), PLANE, "zero", IMAGE).groupBy(*CELL).agg(F.collect_list("value").alias("all"))
    full = F.sort_array(F.concat("all", F.array_repeat(F.lit(0.0), 9 - F.size("all"))))
    return near.select(*CELL, F.get(full, F.lit(4)).alias("m"))


HIST = "h AS (SELECT least(99, floor((value - lo) / ((hi - lo) / 100)))::BIGINT AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY ALL)"


@query(f"WITH {HIST} SELECT bin, coalesce(n, 0)::BIGINT AS n FROM range(100) t(bin) LEFT JOIN h USING (bin)")
def histogram_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir)


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    ends = F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))  # one row
    n = e.join(ends).groupBy(F.least(F.lit(99), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 100))).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(100).select(F.col("id").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {HIST}, f AS (SELECT bin, coalesce(n, 0) AS n FROM range(100) t(bin) LEFT JOIN h USING (bin)), k AS (SELECT d, exp(-d * d / 18.0) AS w FROM range(-12, 13) t(d)) SELECT f.bin, round(sum(g.n * w) / (SELECT sum(w) FROM k), 6) AS s FROM f CROSS JOIN k JOIN f g ON g.bin = greatest(0, least(99, f.bin + d)) GROUP BY f.bin")
def histogram_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian smoothing of the histogram, sigma 3, four sigmas each way, ends repeated."""
    from math import exp

    weights = [(d, exp(-d * d / 18.0)) for d in range(-12, 13)]
    k = G.offsets(spark, weights, "d int, w double")
    h = histogram(spark, sf_dir)
    near = h.select("bin").join(k).withColumn("at", F.greatest(F.lit(0), F.least(F.lit(99), F.col("bin") + F.col("d"))).cast("long"))
    s = near.join(h.select(F.col("bin").alias("at"), "n"), "at").groupBy("bin").agg((F.sum(F.col("n") * F.col("w")) / sum(w for _, w in weights)).alias("s"))
    return s.select("bin", F.round("s", 6).alias("s"))


@query(VOX + " SELECT scan, z, y, x, CASE WHEN y BETWEEN 6 AND 9 AND x BETWEEN 6 AND 9 THEN 0.0 ELSE v END AS v FROM vox")
def centre_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slice with the middle quarter of its sides blanked."""
    inside = F.col("y").between(6, 9) & F.col("x").between(6, 9)
    return C.vox(spark, sf_dir).select(*CELL, F.when(inside, 0.0).otherwise(F.col("v")).alias("v"))


@query(f"WITH {CTE['pts']} SELECT a.scan, a.z, a.y, a.x, count(*) AS n FROM pts a JOIN pts b ON a.scan = b.scan AND abs(a.z - b.z) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL")
def neighbourhood_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright voxels within two steps of each on all axes, itself included, by offsets and not by comparing all pairs."""
    p = C.pts(spark, sf_dir).select(*CELL)
    step = lambda a: F.explode(F.sequence(F.col(a) - 2, F.col(a) + 2)).alias(f"n_{a}")
    wide = p.select(*CELL, step("z")).select("*", step("y")).select("*", step("x"))
    return wide.join(p.select("scan", *[F.col(a).alias(f"n_{a}") for a in "zyx"]), ["scan", "n_z", "n_y", "n_x"]).groupBy(*CELL).agg(F.count("*").alias("n"))


@query(VOX + ", m AS (SELECT scan, z, avg(v) AS m FROM vox GROUP BY scan, z) SELECT scan, z, p.y AS y, q.x AS x, round(coalesce(i.v, m), 6) AS v FROM m CROSS JOIN range(18) p(y) CROSS JOIN range(20) q(x) LEFT JOIN (SELECT scan AS s, z AS k, y AS r, x AS c, v FROM vox) i ON i.s = scan AND i.k = z AND i.r = p.y AND i.c = q.x")
def pad_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.padded_with_mean(C.vox(spark, sf_dir), {"y": 18, "x": 20}, IMAGE).select(*CELL, F.round("v", 6).alias("v"))


@query(VOX + " SELECT max(z) + 1 AS z, max(y) + 1 AS y, max(x) + 1 AS x FROM vox WHERE v > 500")
def max_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vox(spark, sf_dir).where("v > 500").agg(*[(F.max(a) + 1).alias(a) for a in "zyx"])


@query(VOX + ", a AS (SELECT y, x, v / (SELECT max(v) FROM vox WHERE scan = 0 AND z = 0 AND y < 12) AS r FROM vox WHERE scan = 0 AND z = 0 AND y < 12), b AS (SELECT y, x, v / (SELECT max(v) FROM vox WHERE scan = 1 AND z = 0 AND x < 10) AS g FROM vox WHERE scan = 1 AND z = 0 AND x < 10) SELECT y, x, round(coalesce(r, 0), 6) AS r, round(coalesce(g, 0), 6) AS g FROM a FULL JOIN b USING (y, x)")
def overlay_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two planes of different shape over each other, each over its maximum, zero where one has no cell."""
    v = C.vox(spark, sf_dir).where("z = 0")
    a, b = (G.by_max(part, "scan").select("y", "x", F.col("share").alias(n)) for part, n in ((v.where("scan = 0 and y < 12"), "r"), (v.where("scan = 1 and x < 10"), "g")))
    return a.join(b, ["y", "x"], "full").select("y", "x", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("r"), F.round(F.coalesce("g", F.lit(0.0)), 6).alias("g"))


@query(VOX + " SELECT z, y, x, coalesce(f.v, 0.0) AS v FROM (SELECT z, y, x FROM vox WHERE scan = 0) g LEFT JOIN (SELECT z + 2 AS z, y - 3 AS y, x + 1 AS x, v FROM vox WHERE scan = 0) f USING (z, y, x)")
def shift_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shifted(C.vox(spark, sf_dir).where("scan = 0").select("z", "y", "x", "v"), {"z": 2, "y": -3, "x": 1}, SPACE)


@query(VOX + " SELECT g.scan, g.z, g.y, g.x, round(coalesce(sum(n.v * (CASE dy WHEN 0 THEN 0.75 ELSE 0.25 END) * (CASE dx WHEN 0 THEN 0.5 ELSE 0.5 END)), 0), 6) AS v FROM vox g CROSS JOIN range(2) p(dy) CROSS JOIN range(2) q(dx) LEFT JOIN vox n ON n.scan = g.scan AND n.z = g.z AND n.y = g.y - 1 - dy AND n.x = g.x + 1 - dx GROUP BY g.scan, g.z, g.y, g.x")
def bilinear_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved by (1.25, -0.5): one and a quarter down, half to the left."""
    return G.bilinear_shift(C.vox(spark, sf_dir), 1.25, -0.5, PLANE, IMAGE).select(*CELL, F.round("v", 6).alias("v"))


def slope(cell: str, by: str, along: str, value: str = "v") -> str:
    """SQL of the central difference of a value along an axis, one-sided at the ends."""
    b, a = (f"{f}({value}) OVER (PARTITION BY {by} ORDER BY {along})" for f in ("lag", "lead"))
    return f"CASE WHEN {b} IS NULL THEN {a} - {value} WHEN {a} IS NULL THEN {value} - {b} ELSE ({a} - {b}) / 2 END AS {cell}"


AFFINE = {"z": ("z * 0.5 + 2", lambda z, y, x: z * 0.5 + 2), "y": ("y * 0.9 + x * 0.1", lambda z, y, x: y * 0.9 + x * 0.1), "x": ("x * 1.1 - 1", lambda z, y, x: x * 1.1 - 1)}


@query(VOX + ", g AS (SELECT scan, z, y, x, " + ", ".join(f"floor(({e})::DOUBLE + 0.5)::BIGINT AS n{a}" for a, (e, _) in AFFINE.items()) + " FROM vox) SELECT g.scan, g.z, g.y, g.x, coalesce(s.v, 0.0) AS v FROM g LEFT JOIN vox s ON s.scan = g.scan AND s.z = nz AND s.y = ny AND s.x = nx")
def nearest_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume resampled by an affine map, the nearest value or zero outside."""
    at = {a: f(F.col("z"), F.col("y"), F.col("x")) for a, (_, f) in AFFINE.items()}
    return G.resampled(C.vox(spark, sf_dir), at, ("scan",))


@query(VOX + ", s AS (SELECT scan, max(z) + 1 AS n0, max(y) + 1 AS n1, max(x) + 1 AS n2 FROM vox WHERE v > 0 GROUP BY scan) SELECT scan, a.z + 2 AS z, b.y AS y, c.x AS x FROM s, range(8) a(z), range(16) b(y), range(16) c(x) WHERE a.z < n0 AND b.y < n1 AND c.x < n2")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grid points of each scan's shape, which is where its values end, the slices counted from 2."""
    shape = C.vox(spark, sf_dir).where("v > 0").groupBy("scan").agg(*[F.max(a).alias(a) for a in "zyx"])
    along = lambda a, first=0: F.explode(F.sequence(F.lit(first).cast("long"), F.col(a) + first)).alias(f"p_{a}")
    return shape.select("*", along("z", 2)).select("*", along("y")).select("*", along("x")).select("scan", *[F.col(f"p_{a}").alias(a) for a in "zyx"])


@query(VOX + f""", w AS (SELECT scan, z, y, x, z // 3 AS chunk, 2 * z + v / 5000 AS c0, y * (1 + scan) + v / 7000 AS c1, x - v / 9000 AS c2 FROM vox),
  g AS (SELECT scan, z, y, x, {slope('a', 'scan, chunk, y, x', 'z', 'c0')}, {slope('b', 'scan, z, x', 'y', 'c1')}, {slope('c', 'scan, z, y', 'x', 'c2')} FROM w)
  SELECT scan, z, y, x, round(1 / (a * b * c) - 1, 5) + 0.0 AS warp FROM g""")
def warp_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume change where every voxel goes to coordinates that its value disturbs, over chunks of three slices."""
    v, out = C.vox(spark, sf_dir), None
    for scan in (0, 1):
        coords = v.where(F.col("scan") == scan).select("z", "y", "x", (2 * F.col("z") + F.col("v") / 5000).alias("c0"), (F.col("y") * (1 + scan) + F.col("v") / 7000).alias("c1"), (F.col("x") - F.col("v") / 9000).alias("c2"))
        part = G.warp_magnitude(coords, 3).select(F.lit(scan).cast("long").alias("scan"), "z", "y", "x", rounded("warp", 5).alias("warp"))
        out = part if out is None else out.union(part)
    return out


@query(VOX + ", w AS (SELECT k AS z, greatest(0, least(7, floor((k + 0.5) * 0.5 - 0.5)))::BIGINT AS z0, greatest(0, least(7, floor((k + 0.5) * 0.5 - 0.5) + 1))::BIGINT AS z1, ((k + 0.5) * 0.5 - 0.5) - floor((k + 0.5) * 0.5 - 0.5) AS f FROM range(16) t(k)) SELECT w.z, y, x, round(sum(CASE p WHEN 0 THEN v.v * (1 - f) ELSE v.v * f END), 6) AS v FROM w CROSS JOIN range(2) t(p) JOIN vox v ON v.z = (CASE p WHEN 0 THEN z0 ELSE z1 END) AND scan = 0 GROUP BY w.z, y, x")
def depth_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices at twice the number by a table of weights (here linear, ends repeated)."""
    rows = []
    for k in range(16):
        at = (k + 0.5) * 0.5 - 0.5
        low = int(at // 1)
        rows += [(k, max(0, min(7, low)), 1 - (at - low)), (k, max(0, min(7, low + 1)), at - low)]
    w = F.broadcast(spark.createDataFrame(rows, "out long, z long, w double"))
    s = C.vox(spark, sf_dir).where("scan = 0").join(w, "z").groupBy("out", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return s.select(F.col("out").alias("z"), "y", "x", F.round("v", 6).alias("v"))


@query(VOX + " SELECT plane, r, c, coalesce(v, 0.0) AS v FROM (SELECT 'axial' AS plane, r, c, 3 AS z, 12 + r AS y, 10 + c AS x FROM range(8) a(r), range(8) b(c) UNION ALL SELECT 'coronal', r, c, 2 + r, 5, 12 + c FROM range(8) a(r), range(8) b(c) UNION ALL SELECT 'sagittal', r, c, 4 + r, 3 + c, 7 FROM range(8) a(r), range(8) b(c)) g LEFT JOIN (SELECT z, y, x, v FROM vox WHERE scan = 0) f USING (z, y, x)")
def plane_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 crops on the three planes, zero where they leave the volume."""
    v = C.vox(spark, sf_dir).where("scan = 0").select("z", "y", "x", "v")
    cells = C.grid(spark, r=8, c=8)
    r, c = F.col("r"), F.col("c")
    out = None
    for name, z, y, x in (("axial", F.lit(3), r + 12, c + 10), ("coronal", r + 2, F.lit(5), c + 12), ("sagittal", r + 4, c + 3, F.lit(7))):
        part = cells.select(F.lit(name).alias("plane"), "r", "c", z.cast("long").alias("z"), y.cast("long").alias("y"), x.cast("long").alias("x"))
        out = part if out is None else out.union(part)
    return out.join(v, ["z", "y", "x"], "left").select("plane", "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(VOX + f", w AS (SELECT *, v * (1 + z) AS f0, v - 3 * y AS f1, v * v / 100 AS f2 FROM vox), s AS (SELECT scan, z, y, x, {slope('gz', 'scan, y, x', 'z', 'f0')}, {slope('gy', 'scan, z, x', 'y', 'f1')}, {slope('gx', 'scan, z, y', 'x', 'f2')} FROM w) SELECT scan, z, y, x, round(gz + gy + gx, 6) + 0.0 AS divergence FROM s")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of a vector field of three components made from each voxel: the sum of their differences, each along its own axis."""
    v, total = F.col("v"), F.lit(0.0)
    field = {"z": v * (1 + F.col("z")), "y": v - 3 * F.col("y"), "x": v * v / 100}
    cells = C.vox(spark, sf_dir).select(*CELL, *[f.alias(f"f_{a}") for a, f in field.items()])
    for along, by in (("z", ("scan", "y", "x")), ("y", ("scan", "z", "x")), ("x", ("scan", "z", "y"))):
        w, f = W.partitionBy(*by).orderBy(along), F.col(f"f_{along}")
        b, a = F.lag(f).over(w), F.lead(f).over(w)
        total = total + F.when(b.isNull(), a - f).when(a.isNull(), f - b).otherwise((a - b) / 2)
    return cells.select(*CELL, rounded(total).alias("divergence"))


@query(VOX + ", t AS (SELECT scan, z, y, x, v, y // 4 - i AS ty, x // 4 - j AS tx FROM vox CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j)), d AS (SELECT *, v - avg(v) OVER (PARTITION BY scan, z, ty, tx) AS diff FROM t) SELECT scan, z, y, x, round(sum(diff) / 4, 4) + 0.0 AS anomaly FROM d GROUP BY scan, z, y, x")
def overlapping_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly by tiles of 8 x 8 that overlap by half, padded at the edges: each voxel less its tile's mean, the
    baseline predictor, summed over its four tiles and divided by the overlap squared. A voxel names its tiles
    itself, so tiles and voxels meet without a range join."""
    tiles = C.vox(spark, sf_dir)
    for axis in ("y", "x"):
        first = F.floor(F.col(axis) / 4)
        tiles = tiles.withColumn(f"t{axis}", F.explode(F.array(first - 1, first)))
    off = tiles.withColumn("diff", F.col("v") - F.avg("v").over(W.partitionBy("scan", "z", "ty", "tx")))
    return off.groupBy(*CELL).agg(rounded(F.sum("diff") / 4, 4).alias("anomaly"))


#: 3 x 3 kernels by row: the image itself, differences along x and y, the Laplacian.
BANK = {"identity": (0, 0, 0, 0, 1, 0, 0, 0, 0), "along_x": (-1, 0, 1, -2, 0, 2, -1, 0, 1), "along_y": (-1, -2, -1, 0, 0, 0, 1, 2, 1), "laplacian": (0, 1, 0, 1, -4, 1, 0, 1, 0)}
BANK_ROWS = ", ".join(f"('{k}', {i // 3 - 1}, {i % 3 - 1}, {w})" for k, own in BANK.items() for i, w in enumerate(own) if w)


@query(VOX + f", k(kernel, dy, dx, w) AS (VALUES {BANK_ROWS}) SELECT i.scan, i.z, i.y, i.x, kernel, round(sum(w * n.v), 4) + 0.0 AS response FROM vox i CROSS JOIN k JOIN vox n ON n.scan = i.scan AND n.z = i.z AND {AT} GROUP BY i.scan, i.z, i.y, i.x, kernel")
def filter_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response of every slice to each kernel of the bank, mirrored at the edges. A neighbour is fetched once for all
    kernels, which are constants in the sums."""
    def mirrored(at):
        return F.when(at < 0, -at).when(at >= 16, 30 - at).otherwise(at)

    v = C.vox(spark, sf_dir).select(*CELL, "v")
    offset = F.explode(F.array(*[F.struct(F.lit(i // 3 - 1).alias("dy"), F.lit(i % 3 - 1).alias("dx"), F.lit(i).alias("i")) for i in range(9)]))
    near = v.select(*CELL, offset.alias("o")).select(*CELL, "o.i", mirrored(F.col("y") + F.col("o.dy")).alias("ny"), mirrored(F.col("x") + F.col("o.dx")).alias("nx"))
    values = v.select("scan", "z", F.col("y").alias("ny"), F.col("x").alias("nx"), "v")
    sums = [F.sum(F.element_at(F.array(*[F.lit(float(w)) for w in own]), F.col("i") + 1) * F.col("v")).alias(k) for k, own in BANK.items()]
    wide = near.join(values, ["scan", "z", "ny", "nx"]).groupBy(*CELL).agg(*sums)
    return wide.unpivot(CELL, list(BANK), "kernel", "response").withColumn("response", rounded(F.col("response"), 4))


#: Kneedle over the smoothed histograms of what each line was sold for, by ship status.
KNEES = """WITH v AS (SELECT l_linestatus AS status, l_extendedprice * l_discount * l_discount AS v FROM lineitem), e AS (SELECT status, min(v) AS lo, max(v) AS hi FROM v GROUP BY status),
h AS (SELECT status, least(99, floor((v - lo) / ((hi - lo) / 100)))::BIGINT AS b, count(*) AS n FROM v JOIN e USING (status) GROUP BY ALL),
k AS (SELECT d, exp(-d * d / 18.0::DOUBLE) / sum(exp(-d * d / 18.0::DOUBLE)) OVER () AS w FROM range(-12, 13) t(d)),
c AS (SELECT e.status, t.bin, lo + (t.bin + 1) * (hi - lo) / 100 AS edge, coalesce(sum(n * w), 0) AS s FROM e CROSS JOIN range(100) t(bin) CROSS JOIN k
  LEFT JOIN h ON h.status = e.status AND h.b = CASE WHEN t.bin + d < 0 THEN -1 - t.bin - d WHEN t.bin + d > 99 THEN 199 - t.bin - d ELSE t.bin + d END GROUP BY e.status, t.bin, lo, hi),
d AS (SELECT status, bin, edge, (max(s) OVER w - s) / (max(s) OVER w - min(s) OVER w) - bin / 99 AS d FROM c WINDOW w AS (PARTITION BY status)),
m AS (SELECT *, d > lag(d) OVER o AND d > lead(d) OVER o AS top, d < lag(d) OVER o AND d < lead(d) OVER o AS dip FROM d WINDOW o AS (PARTITION BY status ORDER BY bin)),
n AS (SELECT *, coalesce(min(bin) FILTER (top) OVER o, 1000) AS next_top, coalesce(min(bin) FILTER (dip) OVER o, 1000) AS next_dip FROM m WINDOW o AS (PARTITION BY status ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
found AS (SELECT a.status, min(a.bin) AS bin FROM n a JOIN m b ON a.status = b.status AND b.bin > a.bin AND b.bin <= a.next_top AND b.d < CASE WHEN b.bin > a.next_dip THEN 0 ELSE a.d - 1 / 99 END WHERE a.top GROUP BY a.status)"""


@query(KNEES + " SELECT e.status, round(c.edge, 4) AS knee FROM e LEFT JOIN found f USING (status) LEFT JOIN c ON c.status = f.status AND c.bin = f.bin")
def histogram_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value above which values are rare, for each line status."""
    v = C.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), (F.col("l_extendedprice") * F.col("l_discount") * F.col("l_discount")).alias("v"))
    return knees(smoothed_histogram(v, "status"), "status").select("status", F.round("knee", 4).alias("knee"))

"""Relations that stand in for scans, slices, points and vectors, made from the driver's tables.

Each has a DataFrame form and the same thing as a SQL common table expression, CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEPTH, SIDE = 8, 16
CTE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, **axes: int) -> DataFrame:
    """All index tuples of the given axes, each 0 to n-1, as long columns; one range, no join."""
    total = 1
    for n in axes.values():
        total *= n
    out, step = [], total
    for name, n in axes.items():
        step //= n
        out.append((F.floor(F.col("id") / step) % n).cast("long").alias(name))
    return spark.range(total).select(*out)


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, z, y, x, v): two dense 8 x 16 x 16 volumes of summed quantities."""
    found = table(spark, sf_dir, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("long").alias("scan"),
        (F.col("l_orderkey") % DEPTH).alias("z"), (F.col("l_partkey") % SIDE).alias("y"), (F.col("l_suppkey") % SIDE).alias("x"),
    ).agg(F.sum("l_quantity").alias("v"))
    return grid(spark, scan=2, z=DEPTH, y=SIDE, x=SIDE).join(found, ["scan", "z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


CTE["vox"] = """vox AS (
  SELECT g.scan, g.z, g.y, g.x, coalesce(f.v, 0.0)::DOUBLE AS v
  FROM (SELECT s.i AS scan, z.i AS z, y.i AS y, x.i AS x FROM range(2) s(i), range(8) z(i), range(16) y(i), range(16) x(i)) g
  LEFT JOIN (SELECT (l_linestatus = 'F')::BIGINT AS scan, l_orderkey % 8 AS z, l_partkey % 16 AS y, l_suppkey % 16 AS x, sum(l_quantity) AS v
             FROM lineitem GROUP BY ALL) f USING (scan, z, y, x))"""


#: How far the second scan of C.rolled is moved.
ROLL = (2, -3, 4)


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, scan, z, y, x, v): a 16^3 volume of summed quantities for each line status, and the same rolled by ROLL as scan 1."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("long").alias("pair"), *[(F.col(c) % 16).alias(a) for a, c in zip("zyx", ("l_orderkey", "l_partkey", "l_suppkey"), strict=True)]).agg(F.sum("l_quantity").alias("v"))
    first = grid(spark, pair=2, z=16, y=16, x=16).join(found, ["pair", "z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    each = first.select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("scan"))
    return each.select("pair", "scan", *[F.pmod(F.col(a) + F.col("scan") * r, F.lit(16)).cast("long").alias(a) for a, r in zip("zyx", ROLL, strict=True)], "v")


CTE["rolled"] = """rolled AS (
  SELECT g.pair, s.i AS scan, (g.z + s.i * 2) % 16 AS z, (g.y - s.i * 3 + 16) % 16 AS y, (g.x + s.i * 4) % 16 AS x, coalesce(f.v, 0.0)::DOUBLE AS v
  FROM (SELECT p.i AS pair, z.i AS z, y.i AS y, x.i AS x FROM range(2) p(i), range(16) z(i), range(16) y(i), range(16) x(i)) g
  LEFT JOIN (SELECT (l_linestatus = 'F')::BIGINT AS pair, l_orderkey % 16 AS z, l_partkey % 16 AS y, l_suppkey % 16 AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) f USING (pair, z, y, x), range(2) s(i))"""


def slice_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, z, location): a numbered location series for each event type."""
    w = W.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.row_number().over(w).cast("long").alias("z"), F.col("value").alias("location"))


CTE["slice_series"] = "slice_series AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS z, value AS location FROM events)"


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, z, y, x, v): voxels above the exact 98th percentile of their scan."""
    v = vox(spark, sf_dir)
    cut = v.groupBy("scan").agg(F.percentile("v", F.lit(0.98)).alias("cut"))
    return v.join(cut, "scan").where("v > cut").select("scan", "z", "y", "x", "v")


CTE["pts"] = CTE["vox"] + ", pts AS (SELECT v.* FROM vox v JOIN (SELECT scan, quantile_cont(v, 0.98) AS cut FROM vox GROUP BY scan) c USING (scan) WHERE v.v > c.cut)"


def annot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Patient, Scan, Slice, X, Y): annotation rows as a CSV would have them, with unusable values."""
    k = F.col("o_orderkey")
    text = lambda n, bad, least: F.when(k % bad == 0, "n/a").when(k % bad == 1, "-1").when(k % bad == 2, "12.7").otherwise((k % n + least).cast("string"))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("Patient"), F.concat(F.lit("Abdo"), (k % 2 + 1).cast("string")).alias("Scan"),
        text(40, 11, 0).alias("Slice"), text(50, 13, 1).alias("X"), text(60, 17, 2).alias("Y"))


CTE["annot"] = "annot AS (SELECT o_custkey % 20 AS Patient, 'Abdo' || (o_orderkey % 2 + 1)::VARCHAR AS Scan, " + ", ".join(
    f"CASE o_orderkey % {bad} WHEN 0 THEN 'n/a' WHEN 1 THEN '-1' WHEN 2 THEN '12.7' ELSE (o_orderkey % {n} + {least})::VARCHAR END AS {c}" for c, n, bad, least in (("Slice", 40, 11, 0), ("X", 50, 13, 1), ("Y", 60, 17, 2))) + " FROM orders)"


def ell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, scan, axis, layer, cx, cy, short, long, angle, class): plane ellipses from parts."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 2).alias("scan"), (k % 3).alias("axis"), (F.floor(k / 3) % 40).cast("long").alias("layer"),
        (k % 37).cast("double").alias("cx"), (k % 41).cast("double").alias("cy"), F.col("p_size").cast("double").alias("short"),
        (F.col("p_size") + k % 9).cast("double").alias("long"), (k % 180).cast("double").alias("angle"), (k % 4).alias("class"))


CTE["ell"] = "ell AS (SELECT p_partkey AS id, p_partkey % 2 AS scan, p_partkey % 3 AS axis, (p_partkey // 3) % 40 AS layer, (p_partkey % 37)::DOUBLE AS cx, (p_partkey % 41)::DOUBLE AS cy, p_size::DOUBLE AS short, (p_size + p_partkey % 9)::DOUBLE AS long, (p_partkey % 180)::DOUBLE AS angle, p_partkey % 4 AS class FROM part)"


#: Ellipses of so many bodies.
BODIES = 60


def body_ell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ell, from orders: every customer's orders are ellipses of one of BODIES bodies, seen in three
    planes and shrinking from the middle; every sixth body is a tube in one plane, every eleventh order lies anywhere."""
    k, b, cents = F.col("o_orderkey"), F.col("o_custkey") % BODIES, F.floor(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), b.alias("b"), (F.floor(k / 3) % 7 - 3).alias("d"), (cents % 97 / 97 - 0.5).alias("u"), (cents % 89 / 89 - 0.5).alias("w"), F.when(b % 6 == 0, 0).otherwise(k % 3).alias("axis"), (k % 11 == 0).alias("odd"))
    b, d = F.col("b"), F.col("d")
    rows = rows.select("*", (b * 37 % 61 + 10).alias("b0"), (b * 53 % 67 + 10).alias("b1"), (b * 29 % 59 + 10).alias("b2"), F.when(b % 6 == 0, 8.0).otherwise((2 * (5 + b % 5)) * F.sqrt(1 - (d / 4) ** 2)).alias("short"))
    on = lambda x, y, z: F.when(F.col("axis") == 0, x).when(F.col("axis") == 1, y).otherwise(z)
    away = lambda m: F.when(F.col("odd"), F.col("id") % m).otherwise(0)
    return rows.select(
        "id", (F.floor(b / 4) % 2).cast("long").alias("scan"), F.col("axis").cast("long").alias("axis"), (on(F.col("b0"), F.col("b1"), F.col("b2")) + d).cast("long").alias("layer"),
        (on(F.col("b2"), F.col("b2"), F.col("b1")) + F.col("w") + away(23)).cast("double").alias("cx"), (on(F.col("b1"), F.col("b0"), F.col("b0")) + F.col("u") + away(19)).cast("double").alias("cy"),
        "short", (F.col("short") * (1 + F.col("id") % 5 / 10)).alias("long"), (F.col("id") % 180).cast("double").alias("angle"), (b % 4).alias("class"))


CTE["body_ell"] = f"""body_rows AS (
  SELECT o_orderkey AS id, o_custkey % {BODIES} AS b, (o_orderkey // 3) % 7 - 3 AS d, floor(o_totalprice * 100)::BIGINT % 97 / 97 - 0.5 AS u, floor(o_totalprice * 100)::BIGINT % 89 / 89 - 0.5 AS w,
    CASE WHEN o_custkey % {BODIES} % 6 = 0 THEN 0 ELSE o_orderkey % 3 END AS axis, o_orderkey % 11 = 0 AS odd FROM orders),
body_ell AS (
  SELECT id, (b // 4) % 2 AS scan, axis, CASE axis WHEN 0 THEN b * 37 % 61 + 10 WHEN 1 THEN b * 53 % 67 + 10 ELSE b * 29 % 59 + 10 END + d AS layer,
    (CASE axis WHEN 2 THEN b * 53 % 67 + 10 ELSE b * 29 % 59 + 10 END + w + CASE WHEN odd THEN id % 23 ELSE 0 END)::DOUBLE AS cx,
    (CASE axis WHEN 0 THEN b * 53 % 67 + 10 ELSE b * 37 % 61 + 10 END + u + CASE WHEN odd THEN id % 19 ELSE 0 END)::DOUBLE AS cy,
    s AS short, s * (1 + id % 5 / 10) AS long, (id % 180)::DOUBLE AS angle, b % 4 AS class
  FROM (SELECT *, CASE WHEN b % 6 = 0 THEN 8.0::DOUBLE ELSE 2 * (5 + b % 5) * sqrt(1 - (d / 4) ** 2) END AS s FROM body_rows))"""


#: Planes of drawn ellipses have so many pixels a side.
PLANE = 48


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plane, y, x, label): a plane for each part with its filled ellipse, label 1; every third has a smaller one in it,
    label 2, every fourth a hole, every seventh lacks its lower half."""
    k = F.col("p_partkey")
    short = (F.col("p_size") % 12 + 9).cast("double")
    rows = table(spark, sf_dir, "part").select(k.alias("plane"), short.alias("s"), (short * (1 + k % 6 / 5)).alias("l"), F.radians((k * 7 % 180 + 0.5)).alias("t"), (23.5 + k % 5).alias("mx"), (24.5 - k % 4).alias("my"))
    box = F.explode(F.sequence(F.lit(0), F.lit(PLANE * PLANE - 1))).alias("i")
    at = rows.select("*", box).select("*", F.floor(F.col("i") / PLANE).alias("y"), (F.col("i") % PLANE).cast("long").alias("x"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    p, q = dx * F.cos("t") + dy * F.sin("t"), dy * F.cos("t") - dx * F.sin("t")
    r = at.withColumn("r", 4 * (p * p / (F.col("s") * F.col("s")) + q * q / (F.col("l") * F.col("l"))))
    label = F.when((F.col("plane") % 7 == 0) & (F.col("y") > 24), 0).when(F.col("r") > 1.0101, 0).when((F.col("plane") % 4 == 0) & (F.col("r") < 0.1011), 0).when((F.col("plane") % 3 == 0) & (F.col("r") < 0.4111), 2).otherwise(1)
    return r.select("plane", "y", "x", label.cast("long").alias("label"))


CTE["drawn"] = f"""drawn AS (
  SELECT plane, y, x, CASE WHEN plane % 7 = 0 AND y > 24 THEN 0 WHEN r > 1.0101::DOUBLE THEN 0 WHEN plane % 4 = 0 AND r < 0.1011::DOUBLE THEN 0 WHEN plane % 3 = 0 AND r < 0.4111::DOUBLE THEN 2 ELSE 1 END::BIGINT AS label
  FROM (SELECT plane, y, x, 4 * (power(dx * cos(t) + dy * sin(t), 2) / (s * s) + power(dy * cos(t) - dx * sin(t), 2) / (l * l)) AS r
        FROM (SELECT plane, s, s * (1 + plane % 6 / 5) AS l, t, y.i AS y, x.i AS x, x.i - mx AS dx, y.i - my AS dy
              FROM (SELECT p_partkey AS plane, (p_size % 12 + 9)::DOUBLE AS s, radians(p_partkey * 7 % 180 + 0.5::DOUBLE) AS t, 23.5::DOUBLE + p_partkey % 5 AS mx, 24.5::DOUBLE - p_partkey % 4 AS my FROM part), range({PLANE}) y(i), range({PLANE}) x(i))))"""


def metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, step, value): a metric series for each event type."""
    return slice_series(spark, sf_dir).select(F.col("series").alias("name"), F.col("z").alias("step"), F.col("location").alias("value"))


CTE["metric"] = CTE["slice_series"] + ", metric AS (SELECT series AS name, z AS step, location AS value FROM slice_series)"


def rounded(col, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(col, digits) + F.lit(0.0)


def small(frame: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """frame with a broadcast hint if it has at most most_rows rows; else as it is, for a shuffled join."""
    return F.broadcast(frame) if frame.limit(most_rows + 1).count() <= most_rows else frame

"""Queries that resize planes, find straight edges and outlines, fill windows and carry frames on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.registry import query

CELL = ("scan", "z", "y", "x")


def cubic_weights(n: int, out: int) -> list[list[tuple[int, float]]]:
    """For each of n samples the (place, weight) pairs it adds to out resized ones: cubic convolution with
    a = -0.75, half-pixel centres, the edge repeated."""
    found: list[dict[int, float]] = [{} for _ in range(n)]
    for o in range(out):
        at = (o + 0.5) * n / out - 0.5
        low = math.floor(at)
        for i in range(low - 1, low + 3):
            d = abs(at - i)
            w = (1.25 * d - 2.25) * d * d + 1 if d <= 1 else ((-0.75 * d + 3.75) * d - 6) * d + 3
            k = min(max(i, 0), n - 1)
            found[k][o] = found[k].get(o, 0.0) + w
    return [sorted(f.items()) for f in found]


def resized(planes: DataFrame, axis: str, weights: list[list[tuple[int, float]]], value: str = "v") -> DataFrame:
    """planes with axis resized: every cell adds to the few cells it has weights for, which are constants."""
    table = F.array(*[F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(w).alias("w")) for o, w in own]) for own in weights])
    keys = [c for c in planes.columns if c not in (axis, value)]
    spread = planes.select(*keys, value, F.explode(F.element_at(table, (F.col(axis) + 1).cast("int"))).alias("to"))
    return spread.groupBy(*keys, F.col("to.o").alias(axis)).agg(F.sum(F.col(value) * F.col("to.w")).alias(value))


RESIZED = 12  # 16 pixels of 0.75 mm
WEIGHTS = cubic_weights(C.SIDE, RESIZED)
WEIGHTS_SQL = ", ".join(f"({i}, {o}, {w!r}::DOUBLE)" for i, own in enumerate(WEIGHTS) for o, w in own)


@query(f"WITH {CTE['vox']}, w(i, o, w) AS (VALUES {WEIGHTS_SQL}) SELECT scan, z, b.o::BIGINT AS y, a.o::BIGINT AS x, round(sum(v * a.w * b.w), 4) + 0.0 AS v FROM vox JOIN w a ON a.i = x JOIN w b ON b.i = y GROUP BY scan, z, b.o, a.o")
def in_plane_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices at one pixel a millimetre, cubic, one axis after the other."""
    return resized(resized(C.vox(spark, sf_dir), "x", WEIGHTS), "y", WEIGHTS).select(*CELL, rounded("v", 4).alias("v"))


def beside(value: Column, w) -> tuple[Column, Column]:
    """The values before and after along a line; at its ends the one on the other side."""
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.coalesce(before, after), F.coalesce(after, before)


BED = f"WITH {CTE['vox']}, b AS (SELECT scan, z, y, x, (v + CASE WHEN x >= 10 + y // 8 THEN 1000 ELSE 0 END > 800)::INT AS b FROM vox)"


@query(BED + """, s AS (SELECT *, coalesce(lag(b) OVER q, lead(b) OVER q) + 2 * b + coalesce(lead(b) OVER q, lag(b) OVER q) AS s FROM b WINDOW q AS (PARTITION BY scan, z, x ORDER BY y)),
  e AS (SELECT *, coalesce(lead(s) OVER r, lag(s) OVER r) - coalesce(lag(s) OVER r, lead(s) OVER r) AS d FROM s WINDOW r AS (PARTITION BY scan, z, y ORDER BY x)),
  h AS (SELECT scan, z, t.i AS theta, floor(round(x * cos(t.i * pi() / 180) + y * sin(t.i * pi() / 180), 6) + 0.5)::BIGINT AS rho, count(*) AS votes FROM e, range(180) t(i) WHERE d > 0 GROUP BY ALL)
  SELECT scan, z, min(rho) AS rho, count(*) AS n_lines FROM h WHERE votes >= 8 GROUP BY scan, z""")
def table_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the bed in each slice: rising edges along x of the bright cells vote for lines through
    them, one a degree, and of lines with votes of half the rows the one with the smallest distance counts."""
    bed = F.when(F.col("x") >= 10 + F.floor(F.col("y") / 8), 1000).otherwise(0)
    b = C.vox(spark, sf_dir).select(*CELL, (F.col("v") + bed > 800).cast("int").alias("b"))
    above, below = beside(F.col("b"), W.partitionBy("scan", "z", "x").orderBy("y"))
    s = b.withColumn("s", above + 2 * F.col("b") + below)
    left, right = beside(F.col("s"), W.partitionBy("scan", "z", "y").orderBy("x"))
    edges = s.withColumn("d", right - left).where("d > 0").select(*CELL, F.explode(F.sequence(F.lit(0), F.lit(179))).alias("theta"))
    turn = F.col("theta") * math.pi / 180
    rho = F.floor(F.round(F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn), 6) + 0.5)
    lines = edges.groupBy("scan", "z", "theta", rho.alias("rho")).count().where(F.col("count") >= C.SIDE // 2)
    return lines.groupBy("scan", "z").agg(F.min("rho").alias("rho"), F.count("*").alias("n_lines"))


OUT = {a: "NOT coalesce(lag(i) OVER {0}, false) OR NOT coalesce(lead(i) OVER {0}, false)".format(f"w{a}") for a in "zyx"}


@query(f"""WITH {CTE['vox']}, m AS (SELECT scan, z, y, x, v > 200 AS i FROM vox),
  o AS (SELECT scan, z, y, x, i, {OUT['z']} AS ez, {OUT['y']} AS ey, {OUT['x']} AS ex FROM m
        WINDOW wz AS (PARTITION BY scan, y, x ORDER BY z), wy AS (PARTITION BY scan, z, x ORDER BY y), wx AS (PARTITION BY scan, z, y ORDER BY x))
  SELECT scan, z, y, x, (ey OR ex)::BIGINT + (ez OR ex)::BIGINT + (ez OR ey)::BIGINT AS votes FROM o WHERE i AND (ez OR ey OR ex)""")
def wall_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cell of a body, in how many of the planes along the three axes it lies on the outline."""
    out = C.vox(spark, sf_dir).withColumn("i", F.col("v") > 200)
    for a, rest in (("z", "yx"), ("y", "zx"), ("x", "zy")):
        w = W.partitionBy("scan", *rest).orderBy(a)
        out = out.withColumn(f"e{a}", ~F.coalesce(F.lag("i").over(w), F.lit(False)) | ~F.coalesce(F.lead("i").over(w), F.lit(False)))
    votes = sum(((F.col(f"e{a}") | F.col(f"e{b}")).cast("long") for a, b in ("yx", "zx", "zy")), F.lit(0).cast("long"))
    return out.where("i and (ez or ey or ex)").select(*CELL, votes.alias("votes"))


@query("""WITH f AS (SELECT user_id, row_number() OVER w - 1 AS frame, first_value(value) OVER w AS first, count(value) OVER p AS n, coalesce(sum(value) OVER p, 0.0) AS total FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  SELECT user_id, frame, n AS n_before, round((first + total) / (1 + n), 6) + 0.0 AS context FROM f""")
def frame_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each frame of a film is told by: the first frame and up to seven before it."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = w.rowsBetween(-7, -1)
    films = C.table(spark, sf_dir, "events").select(
        "user_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.first("value").over(w).alias("first"),
        F.count("value").over(before).alias("n_before"), F.coalesce(F.sum("value").over(before), F.lit(0.0)).alias("total"))
    return films.select("user_id", "frame", "n_before", rounded((F.col("first") + F.col("total")) / (1 + F.col("n_before")), 6).alias("context"))


@query(f"WITH {CTE['vox']}, r AS (SELECT scan, z, avg(v) AS f FROM vox WHERE y BETWEEN 3 AND 12 AND x BETWEEN 3 AND 12 AND NOT (y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11) GROUP BY scan, z) SELECT scan, z, y, x, round(f, 4) AS filled, round(abs(v - f), 4) AS apart FROM vox JOIN r USING (scan, z) WHERE y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11")
def border_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain baseline for learned infilling: the masked window filled with the mean of the ring around it."""
    v = C.vox(spark, sf_dir)
    within = F.col("y").between(4, 11) & F.col("x").between(4, 11)
    ring = v.where(F.col("y").between(3, 12) & F.col("x").between(3, 12) & ~within).groupBy("scan", "z").agg(F.avg("v").alias("f"))
    return v.where(within).join(ring, ["scan", "z"]).select(*CELL, F.round("f", 4).alias("filled"), F.round(F.abs(F.col("v") - F.col("f")), 4).alias("apart"))


@query(f"WITH {CTE['vox']}, m AS (SELECT scan, greatest(max(v), 1.0) - min(v) AS m FROM vox GROUP BY scan) SELECT scan, z, y, x, round(v / m, 6) AS v FROM vox JOIN m USING (scan)")
def stored_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as a scan is stored: over its range, of which the upper end is at least one."""
    v = C.vox(spark, sf_dir)
    range_ = v.groupBy("scan").agg((F.greatest(F.max("v"), F.lit(1.0)) - F.min("v")).alias("m"))
    return v.join(range_, "scan").select(*CELL, F.round(F.col("v") / F.col("m"), 6).alias("v"))


#: Cells that one task makes, about.
TASK_CELLS = 4_000_000


def made_cells(patients: DataFrame, scans: int, slices: int, rows: int, columns: int) -> DataFrame:
    """(pid, scan, z, y, x, location, v): test scans of unsigned 16-bit noise for each pid of patients, slices 0.7 apart. A value
    depends on its place alone, so a task that runs again makes the same cells."""
    size = scans * slices * rows * columns
    # a table of patients is one small file, so one task would make all the cells
    patients = patients.select("pid").repartition(max(1, -(-patients.count() * size // TASK_CELLS)), "pid")
    at = lambda below, n: (F.floor(F.col("i") / below) % n).cast("long")
    cells = patients.select("pid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("i")).select("*", at(slices * rows * columns, scans).alias("scan"), at(rows * columns, slices).alias("z"), at(columns, rows).alias("y"), at(1, columns).alias("x"))
    noise = ((F.col("pid") * size + F.col("i")) % 2147483647 * 48271 + 12345) % 2147483647 * 69621 % 2147483647 % 65536
    return cells.select("pid", *CELL, F.round(F.col("z") * 0.7, 1).alias("location"), noise.alias("v"))


@query("""WITH c AS (SELECT s_suppkey AS pid, s.i AS scan, z.i AS z, y.i AS y, x.i AS x, (((s_suppkey * 2 + s.i) * 2 + z.i) * 24 + y.i) * 32 + x.i AS k FROM supplier, range(2) s(i), range(2) z(i), range(24) y(i), range(32) x(i)),
  v AS (SELECT *, (k % 2147483647 * 48271 + 12345) % 2147483647 * 69621 % 2147483647 % 65536 AS v FROM c)
  SELECT pid, scan, z, round(z * 0.7, 1)::DOUBLE AS location, y, min(v) AS least, max(v) AS most, sum(v * (x + 1))::BIGINT AS mark FROM v GROUP BY pid, scan, z, y""")
def made_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of two slices for every supplier as patient; a row of cells told by its ends and a weighted sum."""
    patients = C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"))
    cells = made_cells(patients, 2, 2, 24, 32)
    return cells.groupBy("pid", "scan", "z", "location", "y").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v") * (F.col("x") + 1)).alias("mark"))

"""Queries on slice series and metric streams: cursors, acceptance, running statistics, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE, rounded
from voxelia.registry import query
from voxelia.sources import annotations, files
from voxelia.streaming import slices

VOX, SERIES, METRIC = f"WITH {CTE['vox']}", f"WITH {CTE['slice_series']}", f"WITH {CTE['metric']}"


@query(SERIES + ", d AS (SELECT series, location - lag(location) OVER (PARTITION BY series ORDER BY z) AS d FROM slice_series) SELECT series, round(avg(d), 6) + 0.0 AS thickness FROM d GROUP BY series")
def layer_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean step of the locations: last less first over the steps, from two values a series."""
    s = C.slice_series(spark, sf_dir).groupBy("series").agg(F.min_by("location", "z").alias("a"), F.max_by("location", "z").alias("b"), F.count("*").alias("n"))
    return s.select("series", rounded((F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("thickness"))


@query(SERIES + ", h AS (SELECT series, z % 2 + 1 AS scan, z, location FROM slice_series), t AS (SELECT series, scan, (arg_max(location, z) - arg_min(location, z)) / (count(*) - 1) AS t FROM h GROUP BY ALL) SELECT a.series, round(CASE WHEN abs(a.t - b.t) < 1e-10 THEN 0.0 ELSE a.t - b.t END, 6) + 0.0 AS diff FROM t a JOIN t b USING (series) WHERE a.scan = 1 AND b.scan = 2")
def thickness_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thickness of a series' first scan less that of its second, by pivoting and not by a join."""
    s = C.slice_series(spark, sf_dir).withColumn("scan", F.col("z") % 2 + 1).groupBy("series", "scan").agg(((F.max_by("location", "z") - F.min_by("location", "z")) / (F.count("*") - 1)).alias("t"))
    d = s.groupBy("series").agg((F.max(F.when(F.col("scan") == 1, F.col("t"))) - F.max(F.when(F.col("scan") == 2, F.col("t")))).alias("d"))
    return d.select("series", rounded(F.when(F.abs("d") < 1e-10, 0.0).otherwise(F.col("d"))).alias("diff"))


@query(SERIES + " SELECT series, z, round(CASE WHEN b IS NULL THEN a - location WHEN a IS NULL THEN location - b ELSE (a - b) / 2 END, 6) + 0.0 AS g FROM (SELECT *, lag(location) OVER w AS b, lead(location) OVER w AS a FROM slice_series WINDOW w AS (PARTITION BY series ORDER BY z))")
def gradient_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("series").orderBy("z")
    b, a, x = F.lag("location").over(w), F.lead("location").over(w), F.col("location")
    return C.slice_series(spark, sf_dir).select("series", "z", rounded(F.when(b.isNull(), a - x).when(a.isNull(), x - b).otherwise((a - b) / 2)).alias("g"))


@query(SERIES + ", s AS (SELECT series, z, row_number() OVER (ORDER BY series, z) - 1 AS k FROM slice_series), n AS (SELECT count(*) AS n FROM s) SELECT pull, series, z FROM range(500) t(pull) CROSS JOIN n JOIN s ON s.k = pull % n.n")
def axial_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th pull of an endless cursor over all slices in order is slice k mod n.

    The numbers come from counts of the series before and the place within the series, so no task sorts
    all slices."""
    s = C.slice_series(spark, sf_dir)
    sizes = s.groupBy("series").agg(F.count("*").alias("m"))  # a row for each series
    before = sizes.select("series", F.coalesce(F.sum("m").over(W.orderBy("series").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(W.partitionBy()).alias("n"))
    numbered = s.join(before, "series").select("series", "z", (F.col("before") + F.col("z") - 1).alias("k"), "n")
    n = before.select("n").limit(1)
    pulls = spark.range(500).select(F.col("id").alias("pull")).join(F.broadcast(n)).select("pull", (F.col("pull") % F.col("n")).alias("k"))
    return pulls.join(numbered.drop("n"), "k").select("pull", "series", "z")


ACCEPT = VOX + ", t AS (SELECT quantile_cont(v, 0.999) AS t FROM vox), k AS (SELECT scan, z FROM vox, t GROUP BY scan, z, t HAVING max(v) >= t) SELECT scan, z, y, x, CASE WHEN v < t THEN 0.0 ELSE v END AS v FROM vox JOIN k USING (scan, z), t"


@query(ACCEPT)
def slice_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices whose greatest value reaches the threshold, with lesser values set to zero."""
    v = C.vox(spark, sf_dir)
    return slices.accepted(v, cut(v, 0.999)).select("scan", "z", "y", "x", "v")


def cut(v: DataFrame, share: float) -> float:
    """The exact percentile of v: one number."""
    return v.agg(F.percentile("v", F.lit(share))).first()[0]


def cents():
    """Values as whole hundredths, so that sums don't depend on order."""
    return F.round(F.col("value") * 100).cast("long")


@query(METRIC + " SELECT name, step, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT / (100.0::DOUBLE * count(*) OVER w) AS mean FROM metric WINDOW w AS (PARTITION BY name ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def running_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("name").orderBy("step").rowsBetween(-99, 0)
    mean = F.sum(cents()).over(w) / (F.lit(100.0) * F.count("*").over(w))
    return C.metric(spark, sf_dir).select("name", "step", mean.alias("mean"))


@query(METRIC + ", f AS (SELECT name, step, value, list_sort(list(value) OVER w) AS l, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT / (100.0::DOUBLE * count(*) OVER w) AS mean, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY name ORDER BY step))::BIGINT / (100.0::DOUBLE * step) AS g FROM metric WINDOW w AS (PARTITION BY name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT name, step, l[(len(l) - 1) // 2 + 1] AS median, mean, list_max(l) AS top, g AS global_mean FROM f")
def smoothed_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last twenty values the lower middle one, mean and greatest; and the mean of all so far."""
    w = W.partitionBy("name").orderBy("step")
    last = F.sort_array(F.collect_list("value").over(w.rowsBetween(-19, 0)))
    few = w.rowsBetween(-19, 0)
    mean = F.sum(cents()).over(few) / (F.lit(100.0) * F.count("*").over(few))
    all_ = F.sum(cents()).over(w) / (F.lit(100.0) * F.col("step"))
    m = C.metric(spark, sf_dir).select("name", "step", last.alias("l"), mean.alias("mean"), all_.alias("global_mean"))
    return m.select("name", "step", F.get("l", F.floor((F.size("l") - 1) / 2).cast("int")).alias("median"), "mean", F.array_max("l").alias("top"), "global_mean")


@query(METRIC + ", p AS (SELECT name, step % 4 AS rank, sum(value) AS total, count(*) AS n FROM metric GROUP BY ALL) SELECT name, round(sum(total) / sum(n), 6) + 0.0 AS mean, sum(n)::BIGINT AS n FROM p GROUP BY name")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all workers from their totals and counts."""
    p = C.metric(spark, sf_dir).groupBy("name", (F.col("step") % 4).alias("rank")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return p.groupBy("name").agg(rounded(F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


@query(METRIC + ", w AS (SELECT name, value, step, max(step) OVER (PARTITION BY name) AS n FROM metric) SELECT name, round(sum(CASE WHEN step = 1 THEN power(0.9, n - 1) ELSE 0.1 * power(0.9, n - step) END * value), 6) + 0.0 AS ema FROM w GROUP BY name")
def exponential_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s = 0.9 s + 0.1 x in order, as a sum of weighted values, which can be combined in any order."""
    n = F.max("step").over(W.partitionBy("name"))
    m = C.metric(spark, sf_dir).withColumn("n", n)
    power = F.pow(F.lit(0.9), F.col("n") - F.col("step"))
    return m.groupBy("name").agg(rounded(F.sum(F.when(F.col("step") == 1, power).otherwise(0.1 * power) * F.col("value"))).alias("ema"))


@query(VOX + ", t AS (SELECT quantile_cont(v, 0.9) AS t FROM vox) SELECT scan, z, y, x, v FROM vox, t WHERE v > t QUALIFY row_number() OVER (PARTITION BY scan, z ORDER BY md5(concat_ws(':', 7, scan, z, y, x)), y, x) <= 8")
def pixel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight pixels above the threshold from each image, by the order of a seeded hash."""
    v = C.vox(spark, sf_dir)
    bright = v.where(F.col("v") > cut(v, 0.9))
    w = W.partitionBy("scan", "z").orderBy(F.md5(F.concat_ws(":", F.lit(7), "scan", "z", "y", "x")), "y", "x")
    return bright.withColumn("r", F.row_number().over(w)).where("r <= 8").select("scan", "z", "y", "x", "v")


DRAW = "('0x' || left(md5({salt} || ':' || id), 8))::BIGINT / 4294967296"


@query(f"""WITH {CTE['slice_series']}, n AS (SELECT series, count(*) AS n, row_number() OVER (ORDER BY series) - 1 AS k FROM slice_series GROUP BY series),
d AS (SELECT id, {DRAW.format(salt=1)} AS a, {DRAW.format(salt=2)} AS b FROM range(200) t(id))
SELECT id AS pull, series, floor(b * n)::BIGINT + 1 AS z FROM d JOIN n ON k = floor(a * (SELECT count(*) FROM n))""")
def random_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred draws, each uniform over series and then over the slices of the series."""
    n = C.slice_series(spark, sf_dir).groupBy("series").agg(F.count("*").alias("n"))
    listed = F.broadcast(n.agg(F.sort_array(F.collect_list(F.struct("series", "n"))).alias("all")))  # one row, a struct for each series
    draw = lambda salt: F.conv(F.left(F.md5(F.concat_ws(":", F.lit(salt), "id")), F.lit(8)), 16, 10).cast("long") / (1 << 32)
    pick = spark.range(200).join(listed).select("id", F.get("all", F.floor(draw(1) * F.size("all")).cast("int")).alias("s"))
    return pick.select(F.col("id").alias("pull"), F.col("s.series").alias("series"), (F.floor(draw(2) * F.col("s.n")) + 1).alias("z"))


GOOD = "regexp_full_match({c}, '[+-]?[0-9]+')"


@query(f"WITH {CTE['annot']} SELECT Patient AS patient, left(Scan, length(Scan) - 1) AS body_part, right(Scan, 1)::BIGINT AS scan, Slice::BIGINT AS axial, Y::BIGINT AS coronal, X::BIGINT AS sagittal, count(*) AS n FROM annot WHERE {GOOD.format(c='Slice')} AND {GOOD.format(c='X')} AND {GOOD.format(c='Y')} AND X <> '-1' AND Y <> '-1' GROUP BY ALL")
def annotation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable annotation rows as numbers; X or Y of -1 drop out, a slice of -1 stays."""
    rows = annotations.parsed(C.annot(spark, sf_dir))
    return rows.groupBy("patient", "body_part", "scan", "axial", "coronal", "sagittal").agg(F.count("*").alias("n"))


@query("SELECT 'I' || (o_orderkey % 120)::VARCHAR AS name, o_orderkey % 120 AS number, row_number() OVER (ORDER BY o_orderkey % 120, o_orderkey) AS place FROM orders")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names by the number in them: I10 after I2. A place is the count of lower numbers and the place within the own one."""
    o = C.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("I"), (F.col("o_orderkey") % 120).cast("string")).alias("name"))
    o = o.withColumn("number", files.number(F.col("name")))
    counts = o.groupBy("number").agg(F.count("*").alias("m"))  # a row for each number
    before = counts.select("number", F.coalesce(F.sum("m").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("number").orderBy("o_orderkey"))
    return o.withColumn("own", own).join(before, "number").select("name", "number", (F.col("before") + F.col("own")).cast("long").alias("place"))


@query(SERIES + " SELECT series, arg_min(location, z) AS location, min(z) AS z FROM slice_series GROUP BY series")
def scan_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first slice of a series says."""
    return C.slice_series(spark, sf_dir).groupBy("series").agg(F.min_by("location", "z").alias("location"), F.min("z").alias("z"))


@query("SELECT c_custkey, split_part(p, '^', 1) || ', ' || split_part(p, '^', 2) AS name FROM (SELECT c_custkey, replace(c_name, '#', '^') AS p FROM customer)")
def patient_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and given name from a caret-separated name."""
    return C.table(spark, sf_dir, "customer").select("c_custkey", files.person(F.regexp_replace("c_name", "#", "^")).alias("name"))


@query("SELECT p_partkey, 'orig__' || (p_partkey % 60)::VARCHAR || '_' || p_size::VARCHAR || '_7' AS stem, p_partkey % 60 AS a, p_size::BIGINT AS b, 7::BIGINT AS c FROM part")
def memmap_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape that a file stem carries after two underscores."""
    stem = files.shaped_name(F.lit("orig.npy"), F.col("p_partkey") % 60, F.col("p_size"), F.lit(7))
    p = C.table(spark, sf_dir, "part").select("p_partkey", stem.alias("stem")).withColumn("shape", files.shape(F.col("stem")))
    return p.select("p_partkey", "stem", *[F.get("shape", F.lit(k)).alias(n) for k, n in enumerate("abc")])


@query("SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'ppm', 'bmp', 'pgm', 'tif', 'tiff', 'webp') AS image, split_part(split_part(url, '://', 2), '/', 1) AS block FROM pages")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path names an image, and the block (first folder) it is in."""
    return C.table(spark, sf_dir, "pages").select("page_id", files.is_image(F.col("url")).alias("image"), F.get(F.split(F.get(F.split("url", "://"), F.lit(1)), "/"), F.lit(0)).alias("block"))


@query("SELECT p_partkey, ((p_size * 13) // 64 * 64)::BIGINT AS h, ((p_size * 29) // 64 * 64)::BIGINT AS w, round(p_size * 0.5)::BIGINT AS rows_mm, round(p_size * 0.7 * 10 / 0.7 / 7)::BIGINT AS depth FROM part")
def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame sizes rounded down to multiples of 64, and sizes in millimetres and slices after scaling."""
    s = F.col("p_size")
    down = lambda n: (F.floor(n / 64) * 64).cast("long")
    return C.table(spark, sf_dir, "part").select("p_partkey", down(s * 13).alias("h"), down(s * 29).alias("w"), F.round(s * F.lit(0.5)).cast("long").alias("rows_mm"), F.round(s * F.lit(0.7) * 10 / 0.7 / 7).cast("long").alias("depth"))


@query(METRIC + " SELECT name, step, '{\"name\":\"' || name || '\",\"step\":' || step::VARCHAR || '}' AS line FROM metric")
def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.metric(spark, sf_dir).select("name", "step", F.to_json(F.struct("name", "step")).alias("line"))


@query(ACCEPT)
def streamed_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice_accept's rows by a file stream of slices, one row a slice."""
    v = C.vox(spark, sf_dir)
    return slices.streamed(v, cut(v, 0.999))

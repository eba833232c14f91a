"""Intensity arithmetic and neighbourhoods on voxel relations (…, z, y, x, v)."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia.carriers import grid


def minmax_u8(v: DataFrame, *keys: str) -> DataFrame:
    """Linear from the least to 0 and the greatest to 255, cut; a constant image gives 0."""
    w = W.partitionBy(*keys)
    low, high = F.min("v").over(w), F.max("v").over(w)
    return v.withColumn("u8", F.when(high > low, F.floor((F.col("v") - low) / (high - low) * 255)).otherwise(0))


def clip_u8(v: DataFrame, top: float) -> DataFrame:
    return v.withColumn("u8", F.floor(F.least("v", F.lit(top)) / top * 255))


def by_max(v: DataFrame, *keys: str) -> DataFrame:
    return v.withColumn("share", F.col("v") * (1 / F.max("v").over(W.partitionBy(*keys))))


def by_range(v: DataFrame, *keys: str) -> DataFrame:
    """v over (greatest of max and 1, less min); the min is not taken off v."""
    w = W.partitionBy(*keys)
    return v.withColumn("scaled", F.col("v") / (F.greatest(F.max("v").over(w), F.lit(1.0)) - F.min("v").over(w)))


def zero_below(v: DataFrame, cut: float) -> DataFrame:
    return v.withColumn("v", F.when(F.col("v") < cut, 0.0).otherwise(F.col("v")))


def offsets(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A kernel: one row for each offset. Kernels are fixed by their radius, so they are broadcast."""
    return F.broadcast(spark.createDataFrame(rows, names))


def bounded(at: Column, n: int, border: str) -> Column:
    """Index at on an axis of n under a border rule: wrap, reflect (edge not repeated), replicate, or zero (null outside)."""
    if border == "wrap":
        return F.pmod(at, F.lit(n))
    if border == "reflect":
        return F.when(at < 0, -at).when(at >= n, 2 * (n - 1) - at).otherwise(at)
    if border == "replicate":
        return F.greatest(F.lit(0), F.least(at, F.lit(n - 1)))
    return F.when((at >= 0) & (at < n), at)


def neighbours(v: DataFrame, kernel: list[tuple], sizes: dict[str, int], border: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, axes, value, w): for every cell, a row for each kernel offset with the neighbour's value.

    kernel rows are (offset per axis, weight). Cells are sent to the places that need them, so one equi-free
    explode replaces a range join; outside cells under "zero" are left out, which is a zero in any sum.
    """
    axes = list(sizes)
    spark = v.sparkSession
    k = offsets(spark, kernel, ", ".join(f"d{a} int" for a in axes) + ", w double")
    cells = grid(spark, **sizes)
    if keys:
        cells = cells.join(F.broadcast(v.select(*keys).distinct()))  # a row for each image
    wanted = cells.join(k).select(*keys, *axes, "w", *[bounded(F.col(a) + F.col(f"d{a}"), sizes[a], border).cast("long").alias(f"n_{a}") for a in axes])
    source = v.select(*keys, *[F.col(a).alias(f"n_{a}") for a in axes], F.col("v").alias("value"))
    return wanted.join(source, [*keys, *[f"n_{a}" for a in axes]]).select(*keys, *axes, "value", "w")


def disk(radius: int) -> list[tuple]:
    return [(y, x, 1.0) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]


def ball(radius: int) -> list[tuple]:
    return [(z, y, x, 1.0) for z in range(-radius, radius + 1) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if z * z + y * y + x * x <= radius * radius]


def box(k: int) -> list[tuple]:
    h = k // 2
    return [(y, x, 1.0 / (k * k)) for y in range(-h, h + 1) for x in range(-h, h + 1)]


def weighted_sum(n: DataFrame, *keys: str) -> DataFrame:
    return n.groupBy(*keys).agg(F.sum(F.col("value") * F.col("w")).alias("s"))


def less_local_mean(v: DataFrame, kernel: list[tuple], sizes: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """v less the mean over the kernel, wrapping round; under 1e-10 in size, zero."""
    axes = list(sizes)
    mean = neighbours(v, kernel, sizes, "wrap", keys).groupBy(*keys, *axes).agg(F.abs(F.avg("value")).alias("m"))
    left = F.col("v") - F.col("m")
    return v.join(mean, [*keys, *axes]).select(*keys, *axes, F.when(F.abs(left) < 1e-10, 0.0).otherwise(left).alias("v"))


def zero_crossings(v: DataFrame, sizes: dict[str, int], threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """crossing: some forward neighbour has the other sign and is further off than threshold."""
    axes = list(sizes)
    cell = [*keys, *axes]
    steps = [tuple((k >> i) & 1 for i in range(len(axes))) + (1.0,) for k in range(1, 1 << len(axes))]
    # the last row of each axis has no forward neighbour on it and stays false
    inner = [F.col(a) < n - 1 for a, n in sizes.items()]
    near = neighbours(v, steps, sizes, "zero", keys)
    both = near.join(v, cell).where((F.abs(F.col("v") - F.col("value")) > threshold) & (F.col("v") * F.col("value") < 0))
    hits = both.select(*cell).distinct().withColumn("hit", F.lit(True))
    ok = inner[0]
    for c in inner[1:]:
        ok = ok & c
    return v.join(hits, cell, "left").select(*cell, "v", (F.coalesce("hit", F.lit(False)) & ok).alias("crossing"))


def every_cell(v: DataFrame, sizes: dict[str, int], keys: tuple[str, ...]) -> DataFrame:
    """(keys, axes): all cells of a grid for each image of v."""
    cells = grid(v.sparkSession, **sizes)
    return v.select(*keys).distinct().join(F.broadcast(cells)) if keys else cells  # the grid of one image is a constant


def padded_with_mean(v: DataFrame, sizes: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """v on a larger grid; new cells hold the mean of the given ones of their image."""
    mean = v.groupBy(*keys).agg(F.avg("v").alias("mean"))
    wide = every_cell(v, sizes, keys).join(v, [*keys, *sizes], "left")
    both = wide.join(mean, list(keys)) if keys else wide.join(F.broadcast(mean))  # one row
    return both.select(*keys, *sizes, F.coalesce("v", "mean").alias("v"))


def shifted(v: DataFrame, by: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """v moved by whole cells; what comes in from outside is zero."""
    axes = list(sizes)
    moved = v.select(*[(F.col(a) + by[a]).alias(a) for a in axes], "v")
    return grid(v.sparkSession, **sizes).join(moved, axes, "left").select(*axes, F.coalesce("v", F.lit(0.0)).alias("v"))


def bilinear_shift(v: DataFrame, dy: float, dx: float, sizes: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """v(y - dy, x - dx) by bilinear weights, zero outside."""
    iy, ix = int(dy // 1), int(dx // 1)
    fy, fx = dy - iy, dx - ix
    corners = [(a, b, (1 - fy if a == -iy else fy) * (1 - fx if b == -ix else fx)) for a in (-iy, -iy - 1) for b in (-ix, -ix - 1)]
    got = weighted_sum(neighbours(v, corners, sizes, "zero", keys), *keys, "y", "x")
    return every_cell(v, sizes, keys).join(got, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("s", F.lit(0.0)).alias("v"))


def resampled(v: DataFrame, at: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """For every cell of v the nearest value of its image at the point that at gives, zero outside; .5 rounds up."""
    axes = list(at)
    cells = v.select(*keys, *axes, *[F.floor(at[a] + 0.5).alias(f"n_{a}") for a in axes])
    source = v.select(*keys, *[F.col(a).alias(f"n_{a}") for a in axes], "v")
    return cells.join(source, [*keys, *[f"n_{a}" for a in axes]], "left").select(*keys, *axes, F.coalesce("v", F.lit(0.0)).alias("v"))


def warp_magnitude(coords: DataFrame, chunk: int) -> DataFrame:
    """warp: fractional change of volume from the gradients of coordinates c0, c1, c2 at (z, y, x); along z
    the gradient is one-sided at the ends of every chunk of slices."""
    one = F.lit(1.0)

    def gradient(c: str, by: str, *over) -> Column:
        w = W.partitionBy(*over).orderBy(by)
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    cut = coords.withColumn("chunk", F.floor(F.col("z") / chunk))
    e = cut.select("z", "y", "x", (gradient("c0", "z", "chunk", "y", "x") - one).alias("a"), (gradient("c1", "y", "z", "x") - one).alias("b"), (gradient("c2", "x", "z", "y") - one).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    s = a + b + c + a * b + a * c + b * c + a * b * c
    return e.select("z", "y", "x", (1 / (1 + s) - 1).alias("warp"))


def total(sizes: dict[str, int]) -> int:
    return prod(sizes.values())

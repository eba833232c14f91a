"""Clusters, ellipses in space and their statistics."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_centre(values: DataFrame, centres: list[tuple[int, float, float]]) -> DataFrame:
    """values(v) with the label of the nearest centre, the lesser label among equals, and the membership
    exp(-d / (1e-7 + spread)) in that cluster. centres: (label, place, spread), a list the caller bounds."""
    each = [F.struct(F.abs(F.col("v") - c).alias("d"), F.lit(k).cast("long").alias("label"), F.lit(s).alias("spread")) for k, c, s in centres]
    best = values.withColumn("best", F.array_min(F.array(*each)))
    return best.withColumn("label", F.col("best.label")).withColumn("membership", F.exp(-F.col("best.d") / (F.col("best.spread") + 1e-7))).drop("best")


def lifted(ellipses: DataFrame) -> DataFrame:
    """Ellipses of planes (axis, layer, cx, cy, short, long) with their centre (c0, c1, c2) in space and area."""
    y, x, layer = F.col("cy"), F.col("cx"), F.col("layer").cast("double")
    order = lambda a, b, c: F.when(F.col("axis") == 0, a).when(F.col("axis") == 1, b).otherwise(c)
    return ellipses.withColumns({"c0": order(layer, y, y), "c1": order(y, layer, x), "c2": order(x, x, layer), "area": F.col("short") * F.col("long") * math.pi / 4})


def neighbour_counts(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(group, c0, c1, c2, n, core): per group and place, the points within eps, itself included.

    Equal points are one row with a weight first; places meet through grid cells of side eps, so each is
    held only against the cells around it.
    """
    places = points.groupBy("group", "c0", "c1", "c2").agg(F.count("*").alias("weight"))
    cell = [F.floor(F.col(c) / eps) for c in ("c0", "c1", "c2")]
    around = F.array(*[F.struct(*[(k + d).alias(f"g{i}") for i, (k, d) in enumerate(zip(cell, step, strict=True))]) for step in itertools.product((-1, 0, 1), repeat=3)])
    left = places.select("group", "c0", "c1", "c2", F.inline(around))
    right = places.select("group", *[k.alias(f"g{i}") for i, k in enumerate(cell)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(("c0", "c1", "c2"))], "weight")
    far = sum(((F.col(f"c{i}") - F.col(f"o{i}")) ** 2 for i in range(3)), F.lit(0.0))
    near = left.join(right, ["group", "g0", "g1", "g2"]).where(far <= eps * eps)
    return near.groupBy("group", "c0", "c1", "c2").agg(F.sum("weight").alias("n")).withColumn("core", F.col("n") >= least)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys, name of each share): exact quantiles of value, linear between its neighbours; nulls don't count.

    Values are numbered by sorting inside their group, so none has to fit in memory; equal ones are one row with
    a weight by then, which a map-side combine makes.
    """
    w = W.partitionBy(*keys).orderBy(value)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("weight"))
    placed = counted.withColumn("upto", F.sum("weight").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = counted.groupBy(*keys).agg(F.sum("weight").alias("total"))
    here = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("weight") <= rank), F.col(value)))
    at = {n: (F.col("total") - 1) * q for n, q in shares.items()}
    ends = [e for n in shares for e in (here(F.floor(at[n])).alias(f"{n}_lo"), here(F.ceil(at[n])).alias(f"{n}_hi"), F.max(at[n] - F.floor(at[n])).alias(f"{n}_part"))]
    both = placed.join(total, list(keys)) if keys else placed.join(F.broadcast(total))  # one row
    return both.groupBy(*keys).agg(*ends).select(*keys, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in shares])


def area_statistics(areas: DataFrame, *keys: str) -> DataFrame:
    """Tenth and ninetieth percentile of area, their ratio, least, greatest, sum and number."""
    each = areas.groupBy(*keys).agg(F.min("area").alias("least"), F.max("area").alias("most"), F.sum("area").alias("volume"), F.count("*").alias("n"))
    out = each.join(quantiles(areas, "area", {"p10": 0.1, "p90": 0.9}, *keys), list(keys))
    return out.withColumn("ratio", F.col("p10") / F.col("p90"))


def bodies(ellipses: DataFrame, min_ratio: float = 0.5, *keys: str) -> DataFrame:
    """Bodies among clustered ellipses (keys, label, axis, c0, c1, c2, area), one row a cluster; noise (label -1) makes none.

    Returns (keys, label, c0, c1, c2, min_0..2, max_0..2, n_0..2, volume, keep): mean, least and greatest centre,
    ellipses by axis, and the largest sum of areas along one axis. keep tells bodies from cylinders and single
    planes: the centres spread, and either their median spread is over min_ratio of the largest, or the areas shrink
    along the axis where they change most, the root of the tenth over the ninetieth percentile being over 0.5.
    """
    own = ellipses.where("label >= 0")
    sums = own.groupBy(*keys, "label").agg(
        *[F.avg(f"c{k}").alias(f"c{k}") for k in range(3)], *[f(f"c{k}").alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in range(3)],
        *[F.count_if(F.col("axis") == k).alias(f"n_{k}") for k in range(3)])
    areas = area_statistics(own, *keys, "label", "axis").groupBy(*keys, "label").agg(F.max("volume").alias("volume"), F.min("ratio").alias("ratio"))
    spread = F.sort_array(F.array(*[F.col(f"max_{k}") - F.col(f"min_{k}") for k in range(3)]))
    fits = (F.try_divide(spread[1], spread[2]) > min_ratio) | (F.sqrt("ratio") > 0.5)
    return sums.join(areas, [*keys, "label"]).withColumn("keep", (spread[2] > 0) & fits).drop("ratio")


def heavy(values: DataFrame, share: float, *keys: str, order: str) -> DataFrame:
    """values(v) with keep: whether v is in the top that holds the share of its group's sum."""
    w = W.partitionBy(*keys)
    upto = F.sum("v").over(w.orderBy("v", order).rowsBetween(W.unboundedPreceding, 0)) / F.sum("v").over(w)
    return values.withColumn("keep", upto > 1 - share)

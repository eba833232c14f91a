"""Density clusters (DBSCAN) as joins between the cells of a grid.

Cells have a diagonal just below eps, so points of a cell are all neighbours. A cell with enough points makes
all of them core points without a test; the others hold fewer points than that, so holding theirs against
the cells around stays linear, however many points lie next to them. Core points of a cell are one cluster,
so clusters are components of a graph of cells. Whether two cells link is settled by boxes around their
core points, which are cut finer only where they leave it open, until few enough points are left to compare.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia.operators.graph import components
from voxelia.store import dealt, drop, kept

#: Two boxes with at most so many pairs of points are compared point by point.
DIRECT = 4096


def squared(axes: tuple[str, ...], one: str, other: str) -> Column:
    """Squared distance between columns one_axis and other_axis."""
    return sum(((F.col(f"{one}_{c}") - F.col(f"{other}_{c}")) ** 2 for c in axes), F.lit(0.0))


def named(df: DataFrame, prefix: str, *columns: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in columns]


def density_clusters(points: DataFrame, eps: float, least: int = 5, group: str = "group", axes: tuple[str, ...] = ("c0", "c1", "c2"), key: str = "id") -> DataFrame:
    """points with ``core`` and ``label``, the number of the cluster within its group, -1 for noise.

    A core point has at least ``least`` points of its group within eps, itself and repeats included. Clusters
    are core points that chains of neighbours join, numbered from 0 by their smallest core key; any other
    point within eps of a core point belongs to the first such cluster. Keys must differ. A null group is a
    group; a point with a null or NaN coordinate is noise. Other columns stay, but core and label are replaced.
    """
    side = eps / math.sqrt(len(axes)) * (1 - 1e-9)
    bounds = eps * eps
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in axes])
    cell_axes = tuple(f"g{k}" for k in range(len(axes)))
    cells_at = [F.floor(F.col(c) / side).alias(g) for c, g in zip(axes, cell_axes, strict=True)]
    at = F.struct(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), F.col(group).isNull().alias("none"))
    base = points.where(whole).select(F.col(key).alias("p"), at.alias("grp"), *[F.col(c).cast("double").alias(c) for c in axes])
    places = base.groupBy("grp", *axes).agg(F.min("p").alias("p"), F.count("*").alias("weight")).select("*", *cells_at)
    places = kept(places, "places")
    cells = kept(places.groupBy("grp", *cell_axes).agg(F.min("p").alias("cell"), F.sum("weight").alias("cell_weight")), "cells")
    placed = kept(places.join(dealt(cells), ["grp", *cell_axes]).select("p", "grp", "cell", "weight", "cell_weight", *axes), "placed")
    near = kept(near_cells(cells, cell_axes), "near-cells")

    # core points
    thin = placed.where(F.col("cell_weight") < least)
    others = placed.select(F.col("cell").alias("b"), F.col("weight").alias("w"), *named(placed, "o", *axes))
    met = thin.select("p", F.col("cell").alias("a"), *named(thin, "t", *axes)).join(dealt(near), "a").join(dealt(others), "b").where(squared(axes, "t", "o") <= bounds)
    extra = met.groupBy("p").agg(F.sum("w").alias("extra"))
    flagged = placed.join(dealt(extra), "p", "left").withColumn("core", F.col("cell_weight") + F.coalesce("extra", F.lit(0)) >= least).drop("extra", "weight", "cell_weight")
    flagged = kept(flagged, "core-points")
    core = flagged.where("core")

    # clusters of cells
    links = linked_cells(core, near, axes, side, bounds)
    comps = kept(components(links), "cell-clusters")
    owned = core.select("p", "grp", "cell").join(dealt(comps.withColumnRenamed("node", "cell")), "cell", "left").withColumn("cluster", F.coalesce("component", "cell"))
    first = owned.groupBy("grp", "cluster").agg(F.min("p").alias("first"))
    numbered = kept(first.select("cluster", (F.row_number().over(W.partitionBy("grp").orderBy("first")) - 1).cast("long").alias("label")), "cluster-numbers")
    of_cell = kept(owned.select("cell", "cluster").distinct().join(dealt(numbered), "cluster").select("cell", "label"), "cell-labels")

    # border points
    border = flagged.where("not core")
    own = border.select("p", "cell").join(dealt(of_cell), "cell").select("p", "label")
    reach = core.select(F.col("cell").alias("b"), *named(core, "o", *axes)).join(dealt(of_cell.select(F.col("cell").alias("b"), "label")), "b")
    next_to = border.select("p", F.col("cell").alias("a"), *named(border, "t", *axes)).join(dealt(near), "a").join(dealt(reach), "b").where(squared(axes, "t", "o") <= bounds).select("p", "label")
    edge = own.union(next_to).groupBy("p").agg(F.min("label").alias("label"))
    settled = core.join(dealt(of_cell), "cell").select("grp", *axes, F.lit(True).alias("core"), "label").union(border.join(dealt(edge), "p").select("grp", *axes, F.lit(False), "label"))
    settled = kept(settled, "density-labels")
    drop(places, cells, placed, near, flagged, links, comps, numbered, of_cell)
    grouped = points.drop("core", "label").withColumn("grp", at)
    same = reduce(lambda a, b: a & b, [F.col("r.grp") == F.col("l.grp"), *[F.col(f"r.{c}").cast("double") == F.col(f"l.{c}") for c in axes]])
    out = grouped.alias("r").join(dealt(settled.alias("l")), same, "left")
    return out.select("r.*", F.coalesce("l.core", F.lit(False)).alias("core"), F.coalesce("l.label", F.lit(-1).cast("long")).alias("label")).drop("grp")


def near_cells(cells: DataFrame, cell_axes: tuple[str, ...]) -> DataFrame:
    """(a, b): different cells that may hold points within eps of each other, both ways."""
    d = len(cell_axes)
    reach = math.ceil(math.sqrt(d))
    wide = 2 * reach + 1
    step = [F.floor(F.col("k") / wide**i) % wide - reach for i in range(d)]
    left = cells.select(F.col("cell").alias("a"), "grp", *cell_axes, F.explode(F.sequence(F.lit(0), F.lit(wide**d - 1))).alias("k"))
    left = left.select("a", "grp", *[(F.col(g) + s).alias(g) for g, s in zip(cell_axes, step, strict=True)])
    return left.join(dealt(cells.select(F.col("cell").alias("b"), "grp", *cell_axes)), ["grp", *cell_axes]).where("a <> b").select("a", "b")


def boxes(points: DataFrame, axes: tuple[str, ...], *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.min(c).alias(f"lo_{c}") for c in axes], *[F.max(c).alias(f"hi_{c}") for c in axes], F.count("*").alias("n"))


def linked_cells(core: DataFrame, near: DataFrame, axes: tuple[str, ...], side: float, bounds: float) -> DataFrame:
    """(a, b), kept: pairs a < b of near cells with core points within the distance whose square is bounds."""
    sides = [f"{e}_{c}" for e in ("lo", "hi") for c in axes]
    level, found = 0, []
    has = kept(boxes(core, axes, "cell"), "boxes")
    pairs = near.where("a < b").join(dealt(has.select(F.col("cell").alias("a"), *named(has, "a", *sides, "n"))), "a").join(dealt(has.select(F.col("cell").alias("b"), *named(has, "b", *sides, "n"))), "b")
    pairs = pairs.withColumn("ka", F.array().cast("array<bigint>")).withColumn("kb", F.array().cast("array<bigint>"))
    while True:
        gap = sum((F.greatest(F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.lit(0.0)) ** 2 for c in axes), F.lit(0.0))
        span = sum((F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}")) ** 2 for c in axes), F.lit(0.0))
        judged = kept(pairs.withColumn("gap", gap).withColumn("span", span).where(F.col("gap") <= bounds), "box-pairs")
        sure = judged.where(F.col("span") <= bounds).select("a", "b").distinct()
        open_ = judged.join(dealt(sure), ["a", "b"], "left_anti")
        few = F.col("a_n") * F.col("b_n") <= DIRECT
        inside = lambda p, k: core.select(F.col("cell").alias(p), F.transform(F.array(*axes), lambda v: F.floor(v * 2**k / side)).alias(f"k{p}"), *named(core, p, *axes))  # noqa: E731, B023
        keys = (lambda p: inside(p, level)) if level else (lambda p: inside(p, 0).withColumn(f"k{p}", F.array().cast("array<bigint>")))  # noqa: B023
        direct = open_.where(few).select("a", "b", "ka", "kb").join(dealt(keys("a")), ["a", "ka"]).join(dealt(keys("b")), ["b", "kb"]).where(squared(axes, "a", "b") <= bounds).select("a", "b").distinct()
        found.append(kept(sure.union(direct), "linked-cells"))
        many = kept(open_.where(~few).join(dealt(found[-1]), ["a", "b"], "left_anti").select("a", "b", "ka", "kb"), "open-pairs")
        drop(judged)
        left = many.limit(1).count()
        if not left:
            links = kept(reduce(DataFrame.union, found).distinct(), "cell-links")
            drop(many, has, *found)
            return links
        level += 1
        cells = many.select(F.col("a").alias("cell")).union(many.select("b")).distinct()
        cut = F.transform(F.array(*axes), lambda v: F.floor(v * 2**level / side))  # noqa: B023
        above = F.transform("k", lambda v: F.floor(v / 2)) if level > 1 else F.array().cast("array<bigint>")
        small = boxes(core.join(dealt(cells), "cell", "left_semi").withColumn("k", cut), axes, "cell", "k").withColumn("above", above)
        part = lambda p: small.select(F.col("cell").alias(p), F.col("above").alias(f"k{p}"), F.col("k").alias(f"new_{p}"), *named(small, p, *sides, "n"))  # noqa: E731, B023
        pairs = many.join(dealt(part("a")), ["a", "ka"]).join(dealt(part("b")), ["b", "kb"]).drop("ka", "kb").withColumnRenamed("new_a", "ka").withColumnRenamed("new_b", "kb")

"""Borders of labelled regions, and ellipses fitted to them, as relations.

A crack is a side of a pixel beyond which the label differs. Walking along it with the region on the right,
the next crack follows from the pixel's own eight neighbours, so every crack knows its successor without a
search, and a border, outer or of a hole, is a cycle of cracks. Cracks are followed within tiles; borders that pass through
several are components of the links between their ways through tiles. What a border is needed for (points, area, centre of
mass, the normal equations of a conic) are sums over its cracks, which need no order, so no task has to hold a border or an image.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelia.operators.graph import components
from voxelia.store import dealt, kept

#: Step (dy, dx) to each neighbour.
STEPS = {"n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1)}
#: For each side, the neighbour ahead to the left and the side met there, the one straight ahead (same side), and the side after a turn right.
WALK = {"n": ("ne", "w", "e", "e"), "e": ("se", "n", "s", "s"), "s": ("sw", "e", "w", "w"), "w": ("nw", "s", "n", "n")}
#: Sides by their numbers.
SIDES = "ensw"
POWERS = [(i, j) for i in range(5) for j in range(5 - i)]


#: Rows and columns of a tile; with the pixels around it, a side is two longer.
TILE = 64
SIDE = TILE + 2
#: Tiles that are laid out at a time.
AT_ONCE = 1024


def packed(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, ty, tx, cells): the pixels of a label in each tile and next to it, as places within the tile.

    Pixels are packed in the batches in which they are read, so rows that lie together move as one list of small numbers.
    """
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / TILE), F.floor((F.col(c) + 1) / TILE))).alias(f"t{c}")
    at = lambda c: F.col(c) - F.col(f"t{c}") * TILE + 1
    spread = pixels.select(*keys, "label", "y", "x", near("y")).select("*", near("x")).select(*keys, "label", "ty", "tx", (at("y") * SIDE + at("x")).cast("short").alias("cell"))
    by = [*keys, "label", "ty", "tx"]

    def pack(batches):
        for batch in batches:
            lists = pa.Table.from_batches([batch]).group_by(by).aggregate([("cell", "list")])
            yield from lists.select([*by, "cell_list"]).rename_columns([*by, "cells"]).combine_chunks().to_batches()

    kinds = ", ".join(f"`{c}` {spread.schema[c].dataType.simpleString()}" for c in by)
    lists = spread.mapInArrow(pack, f"{kinds}, cells array<smallint>")
    return lists.groupBy(*by).agg(F.flatten(F.collect_list("cells")).alias("cells"))


def laid_cracks(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, following, open) of the cracks of all tiles laid one behind the other, sorted by tile, y, x and side: a code is a
    cell times four plus the side; open marks those whose next crack belongs to another tile."""
    step = {k: dy * SIDE + dx for k, (dy, dx) in STEPS.items()}
    inner = np.zeros((SIDE, SIDE), bool)
    inner[1:-1, 1:-1] = True
    inner = inner.ravel()
    cells = np.flatnonzero(grid)
    cells = cells[inner[cells % SIDE**2]]
    code, following = [], []
    for side, (left, met, straight, right) in WALK.items():
        p = cells[~grid[cells + step[side]]]
        to = np.where(grid[p + step[straight]], (p + step[straight]) * 4 + SIDES.index(side), p * 4 + SIDES.index(right))
        to = np.where(grid[p + step[left]], (p + step[left]) * 4 + SIDES.index(met), to)
        code.append(p * 4 + SIDES.index(side))
        following.append(to)
    code, following = np.concatenate(code), np.concatenate(following)
    order = np.argsort(code)
    code, following = code[order], following[order]
    return code, following, ~inner[following // 4 % SIDE**2]


def chained(following: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, end): the smallest crack of each crack's cycle, and the last crack of its chain, -1 within a cycle.

    following is each crack's next one, itself where it's open. Reaches double in each round.
    """
    least, jump = np.minimum(np.arange(len(following)), following), following
    while True:
        ended = open_[jump]
        if (ended == ended[following]).all() and (ended | (least == least[following])).all():
            return least, np.where(ended, jump, -1)
        least, jump = np.minimum(least, least[jump]), jump[jump]


SUMS = ["n", "twice", "mx", "my"]


def tile_borders(tiles: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, y0, x0, side, n, twice, mx, my, sums, ends, own, next, start) of packed tiles: a row for each border that lies in one
    tile, with its sums; and for each crack of the others a row with only own, next and start, the first crack of its way through the tile."""
    crack = pa.struct([("y", pa.int32()), ("x", pa.int32()), ("side", pa.string())])

    def found(batch):
        lists = batch.column("cells")
        of = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        grid = np.zeros(len(batch) * SIDE**2, bool)
        grid[of * SIDE**2 + lists.flatten().to_numpy(zero_copy_only=False)] = True
        code, following, open_ = laid_cracks(grid)
        low = [batch.column(c).to_numpy(zero_copy_only=False) * TILE - 1 for c in ("ty", "tx")]
        place = lambda c: (low[0][c // 4 // SIDE**2] + c // 4 % SIDE**2 // SIDE, low[1][c // 4 // SIDE**2] + c // 4 % SIDE)
        # a next crack beyond the tile has its place from the same tile's corner
        index = np.where(open_, np.arange(len(code)), np.searchsorted(code, following))
        least, end = chained(index, open_)
        y, x = place(code)
        ny, nx = place(following)
        base = batch.select([*keys, "label"])

        closed = np.flatnonzero(end < 0)
        first, g = np.unique(least[closed], return_inverse=True)
        u, v, p, q = (m[closed] - f[first][g] for m, f in ((x, x), (y, y), (nx, x), (ny, y)))
        cross, moves = u * q - p * v, (u != p) | (v != q)
        total = lambda w: np.bincount(g, w, len(first)).round().astype(np.int64)
        sums = np.stack([np.bincount(g, moves * p.astype(float) ** i * q.astype(float) ** j, len(first)) for i, j in POWERS], -1)
        order = np.lexsort((q, g))
        gs, qs, ps = g[order], q[order], p[order]
        cut = np.flatnonzero(np.r_[True, (gs[1:] != gs[:-1]) | (qs[1:] != qs[:-1])][: len(gs)])
        ends = np.stack([qs[cut], np.minimum.reduceat(ps, cut), np.maximum.reduceat(ps, cut)], -1).astype(np.int32) if len(cut) else np.zeros((0, 3), np.int32)
        listed = lambda flat, per: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(flat.ravel()))
        none = pa.nulls(len(first), crack)
        names = np.array(list(SIDES), object)
        values = [y[first], x[first]], [np.maximum(total(moves), 1), total(cross), total((u + p) * cross), total((v + q) * cross)]
        yield from rows(base, code[first] // 4 // SIDE**2, [*map(pa.array, values[0]), pa.array(names[code[first] % 4], pa.string()), *map(pa.array, values[1]), listed(sums, np.full(len(first), len(POWERS))), listed(ends, 3 * np.bincount(gs[cut], minlength=len(first))), none, none, none])

        way = np.flatnonzero(end >= 0)
        starts = np.ones(len(code), bool)
        starts[index[~open_]] = False
        of_end = np.full(len(code), -1)
        of_end[end[starts & (end >= 0)]] = np.flatnonzero(starts & (end >= 0))
        at = lambda c: pa.StructArray.from_arrays([*(pa.array(m.astype(np.int32)) for m in place(c)), pa.array(names[c % 4], pa.string())], fields=list(crack))
        nothing = [pa.nulls(len(way), t) for t in (pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.float64()), pa.list_(pa.int32()))]
        yield from rows(base, code[way] // 4 // SIDE**2, [*nothing, at(code[way]), at(following[way]), at(code[of_end[end[way]]])])

    def rows(base, of, columns):
        if len(of):
            own = base.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*own.schema.names, "y0", "x0", "side", *SUMS, "sums", "ends", "own", "next", "start"])

    def each(batches):
        for batch in batches:
            for k in range(0, len(batch), AT_ONCE):
                yield from found(batch.slice(k, AT_ONCE))

    kinds = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in (*keys, "label"))
    at = "struct<y: int, x: int, side: string>"
    return tiles.mapInArrow(each, f"{kinds}, y0 long, x0 long, side string, n long, twice long, mx long, my long, sums array<double>, ends array<int>, own {at}, next {at}, start {at}")


def longer_borders(ways: DataFrame, *keys: str) -> DataFrame:
    """The same columns, without own, next and start, for the borders that pass through several tiles, from their cracks. Ways through
    tiles are linked by their first cracks, so that components are found over ways and not over cracks."""
    named = lambda c: F.struct(*keys, "label", f"{c}.*").alias(c)
    walked = ways.select(named("own"), named("next"), named("start"))
    ends = walked.join(dealt(walked.select(F.col("start").alias("next")).distinct()), "next").select(F.col("start").alias("a"), F.col("next").alias("b"))
    whole = components(ends)
    own = walked.join(dealt(whole.withColumnRenamed("node", "start")), "start", "left").select("own", "next", F.coalesce("component", "start").alias("c"))
    first = own.groupBy("c").agg(F.min("own").alias("first"))
    own = own.join(dealt(first), "c")
    u, v, nu, nv = (F.col(f"{p}.{c}") - F.col(f"first.{c}") for p, c in (("own", "x"), ("own", "y"), ("next", "x"), ("next", "y")))
    steps = own.select("first", u.cast("long").alias("u"), v.cast("long").alias("v"), nu.cast("long").alias("p"), nv.cast("long").alias("q"))
    cross = F.col("u") * F.col("q") - F.col("p") * F.col("v")
    moves = (F.col("u") != F.col("p")) | (F.col("v") != F.col("q"))
    power = lambda c, n: F.lit(1) if n == 0 else math.prod([F.col(c)] * n)
    sums = [F.sum(F.when(moves, power("p", i) * power("q", j)).otherwise(0)).cast("double") for i, j in POWERS]
    total = steps.groupBy("first").agg(
        F.greatest(F.count_if(moves), F.lit(1)).alias("n"), F.sum(cross).alias("twice"), F.sum((F.col("u") + F.col("p")) * cross).alias("mx"), F.sum((F.col("v") + F.col("q")) * cross).alias("my"), F.array(*sums).alias("sums"))
    lines = steps.groupBy("first", F.col("q").cast("int").alias("q")).agg(F.min("p").cast("int").alias("lo"), F.max("p").cast("int").alias("hi"))
    ends = lines.groupBy("first").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("q", "lo", "hi"))), lambda r: F.array(r["q"], r["lo"], r["hi"]))).alias("ends"))
    return total.join(dealt(ends), "first").select(*[F.col(f"first.{k}").alias(k) for k in keys], "first.label", F.col("first.y").cast("long").alias("y0"), F.col("first.x").cast("long").alias("x0"), "first.side", *SUMS, "sums", "ends")


def borders(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, y0, x0, n, hole, area, com_y, com_x, hull, sums): every border of every region, eight-connected within a label.

    pixels has one row (keys, y, x, label) a pixel of a region; background pixels are left out. A border is named by
    its first pixel in reading order (a hole's may be an outer border's, too); n counts its points, a pixel
    as often as the border passes it; area, com_y and com_x are those of the polygon of its points, the centre null
    where the area is zero; hull is the area of their convex hull; sums are those of dx^i dy^j over the points, by
    POWERS, d counted from the first pixel. Rows with a null label or place are left out.
    """
    whole = pixels.where("label is not null and y is not null and x is not null").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "label")
    found = kept(tile_borders(packed(whole, *keys), *keys), "borders")
    total = found.where("n is not null").drop("own", "next", "start")
    ways = found.where("own is not null")
    if ways.limit(1).count():
        total = total.union(longer_borders(ways, *keys))
    at = lambda m, c: F.try_divide(F.col(m), 3 * F.col("twice")) + F.col(c)
    return total.select(
        *keys, "label", F.col("y0").cast("int").alias("y0"), F.col("x0").cast("int").alias("x0"), "n", (F.col("twice") < 0).alias("hole"),
        (F.abs("twice") / 2).alias("area"), at("my", "y0").alias("com_y"), at("mx", "x0").alias("com_x"), hull_area("ends").alias("hull"), "sums")


def hull_area(ends: str):
    """Area of the convex hull of points given by the ends q, lo, hi of their rows, sorted, in one list; two points a row."""

    @F.pandas_udf("double")
    def area(column: pd.Series) -> pd.Series:
        def one(flat) -> float:
            rows = np.asarray(flat).reshape(-1, 3).tolist()
            chains = []
            for side, sign in ((1, 1), (2, -1)):
                chain: list[tuple[int, int]] = []
                for e in rows:
                    p = (e[side], e[0])
                    while len(chain) > 1 and sign * ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) >= 0:
                        chain.pop()
                    chain.append(p)
                chains.append(chain)
            ring = chains[0] + chains[1][::-1]
            return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2

        return column.map(one)

    return area(F.col(ends))


def ellipses(found: DataFrame) -> DataFrame:
    """borders with (cx, cy, short, long, angle): the ellipse of the conic that fits a border's points by least squares.

    The conic a x^2 + b x y + c y^2 + d x + e y = 1 is taken around the mean of the points; short and long are whole
    axes, angle is that of the short one against x, in degrees from 0 to 180. All are null for fewer than five points
    or an area of zero, and where the conic is no ellipse.
    """

    def fit(batches):
        for rows in batches:
            s = np.stack(rows["sums"].to_numpy()) if len(rows) else np.zeros((0, len(POWERS)))
            raw = {p: s[:, k] for k, p in enumerate(POWERS)}
            n = np.maximum(raw[0, 0], 1.0)
            mx, my = raw[1, 0] / n, raw[0, 1] / n
            # sums of powers around the mean, from those around the first pixel: small whole numbers, so nothing is lost
            around = {(i, j): sum(math.comb(i, a) * math.comb(j, b) * raw[a, b] * (-mx) ** (i - a) * (-my) ** (j - b) for a in range(i + 1) for b in range(j + 1)) for i, j in POWERS}
            terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1)]
            left = np.stack([np.stack([around[i + k, j + m] for k, m in terms], -1) for i, j in terms], -2)
            right = np.stack([around[t] for t in terms], -1)
            fine = (raw[0, 0] >= 5) & (rows["area"].to_numpy() > 0)
            w = np.full((len(rows), 5), np.nan)
            for k in np.flatnonzero(fine):
                w[k] = np.linalg.lstsq(left[k], right[k], rcond=None)[0]
            a, b, c, d, e = w.T
            with np.errstate(all="ignore"):
                det = 4 * a * c - b * b
                x, y = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
                level = 1 - (d * x + e * y) / 2
                mean, half = (a + c) / 2, np.hypot((a - c) / 2, b / 2)
                short, long = 2 * np.sqrt(level / (mean + half)), 2 * np.sqrt(level / (mean - half))
                angle = np.degrees(np.arctan2(b, a - c) / 2) % 180
            good = np.isfinite(short) & np.isfinite(long) & (det > 0)
            out = rows.drop(columns="sums")
            for name, value in (("cx", x + mx + rows["x0"].to_numpy()), ("cy", y + my + rows["y0"].to_numpy()), ("short", short), ("long", long), ("angle", angle)):
                out[name] = pd.array(np.where(good, value, np.nan), dtype="Float64")
            yield out.replace({np.nan: None})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "sums")
    return found.mapInPandas(fit, f"{kinds}, cx double, cy double, short double, long double, angle double")


def sieved(fits: DataFrame, min_area_ratio: float = 0.75, min_ratio: float = 0.5, min_long: float = 0.0, max_long: float = math.inf, max_far: float = 10.0, min_area: float = 25.0, max_area: float = 10000.0) -> DataFrame:
    """The fits that are ellipses: hull area within limits, short over long, long axis within limits, the border's centre
    of mass near the ellipse's, and the border filling enough of it."""
    far = F.sqrt((F.col("com_x") - F.col("cx")) ** 2 + (F.col("com_y") - F.col("cy")) ** 2)
    fills = F.col("area") / (F.col("short") * F.col("long") * math.pi / 4)
    return fits.where(F.col("cx").isNotNull() & F.col("hull").between(min_area, max_area) & (F.col("short") / F.col("long") >= min_ratio) & F.col("long").between(min_long, max_long) & (far <= max_far) & (fills > min_area_ratio))

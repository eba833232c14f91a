"""Cubic maps of space fitted to matched points by ridge regression, and applied to points."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia.carriers import small
from voxelia.store import kept

AXES = 3
#: Exponents of the terms of degree 1 to 3; the constant is apart, as it isn't penalised.
TERMS = [(i, j, k) for degree in (1, 2, 3) for i in range(degree, -1, -1) for j in range(degree - i, -1, -1) for k in [degree - i - j]]


def terms(*at: str) -> list[Column]:
    """The terms of TERMS of a place in three columns."""
    power = lambda c, n: reduce(lambda a, b: a * b, [F.col(c).cast("double")] * n)
    return [reduce(lambda a, b: a * b, [power(c, n) for c, n in zip(at, t, strict=True) if n]) for t in TERMS]


def moments(matches: DataFrame, *keys: str, places: tuple[str, ...] = ("t0", "t1", "t2"), values: tuple[str, ...] = ("s0", "s1", "s2")) -> DataFrame:
    """(keys, n, means, sums): the means of all terms and values, and the sums of products of what is left of them without the
    means: of each term with itself, the terms behind it and the values, in this order.

    Rows with a null place or value don't count. Products are taken after the means, so large coordinates lose
    no digits. Means are sums with a map-side combine; products are summed within the batches that are read, as one matrix
    product for each key, so that a batch and key gives one row and not a row for each point and product.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*places, *values)])
    rows = matches.where(whole).select(*keys, F.array(*terms(*places), *[F.col(v).cast("double") for v in values]).alias("x"))
    every = range(len(TERMS) + AXES)
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("x")[k]) for k in every]).alias("means"))
    means = kept(means, "means")  # read twice, and counted
    left = rows.join(small(means), list(keys)) if keys else rows.join(F.broadcast(means))  # one row
    left = left.select(*keys, F.zip_with("x", "means", lambda x, m: x - m).alias("x"))
    size = len(TERMS)
    upper = np.triu_indices(size, 0, size + AXES)

    def products(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size + AXES)
            own = pa.Table.from_batches([batch]).select(list(keys)).append_column("at", pa.array(np.arange(len(x)))).group_by(list(keys)).aggregate([("at", "list")])
            rows = [x[np.asarray(at)] for at in own["at_list"].to_pylist()] if keys else [x]
            sums = pa.array([(r[:, :size].T @ r)[upper] for r in rows if len(r)], pa.list_(pa.float64()))
            if len(sums):
                yield from pa.table([*(own[k] for k in keys), sums], names=[*keys, "sums"]).combine_chunks().to_batches()

    kinds = "".join(f"`{k}` {left.schema[k].dataType.simpleString()}, " for k in keys)
    each = left.mapInArrow(products, f"{kinds}sums array<double>").select(*keys, F.posexplode("sums").alias("at", "p"))
    summed = each.groupBy(*keys, "at").agg(F.sum("p").alias("p"))
    sums = summed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "p"))), lambda s: s["p"]).alias("sums"))
    return (means.join(sums, list(keys)) if keys else means.where("n > 0").crossJoin(F.broadcast(sums))).select(*keys, "n", "means", "sums")  # one row


def fitted(matches: DataFrame, *keys: str, alpha: float = 1.0, places: tuple[str, ...] = ("t0", "t1", "t2"), values: tuple[str, ...] = ("s0", "s1", "s2")) -> DataFrame:
    """(keys, axis, w): for each value the constant and the weights of TERMS, least squares with alpha times the sum of squared weights.

    A key's system has 19 equations, however many points it has; each is solved where its moments are, many keys in parallel.
    """
    size = len(TERMS)

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                mean, sums = np.asarray(r.means, float), np.asarray(r.sums, float)
                all_ = np.zeros((size, size + AXES))
                all_[np.triu_indices(size, 0, size + AXES)] = sums
                g = all_[:, :size] + np.triu(all_[:, :size], 1).T
                w = np.linalg.solve(g + alpha * np.eye(size), all_[:, size:])
                for a in range(AXES):
                    out.append([*(getattr(r, k) for k in keys), a, [float(mean[size + a] - mean[:size] @ w[:, a]), *map(float, w[:, a])]])
            yield pd.DataFrame(out, columns=[*keys, "axis", "w"])

    kinds = "".join(f"{k} {matches.schema[k].dataType.simpleString()}, " for k in keys)
    return kept(moments(matches, *keys, places=places, values=values).mapInPandas(solve, f"{kinds}axis long, w array<double>"), "weights")


def mapped(points: DataFrame, weights: DataFrame, *keys: str, places: tuple[str, ...] = ("t0", "t1", "t2")) -> DataFrame:
    """points with m0, m1, m2, their places under the fitted map of their key; null where the key has none. Sums and products only, in the JVM."""
    wide = weights.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.first(F.when(F.col("axis") == a, F.col("w")), ignorenulls=True).alias(f"__w{a}") for a in range(AXES)])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = points.join(small(wide), same, "left") if keys else points.crossJoin(F.broadcast(wide))  # one row
    at = terms(*places)
    value = lambda a: sum((F.col(f"__w{a}")[k + 1] * t for k, t in enumerate(at)), F.col(f"__w{a}")[0])
    return both.withColumns({f"m{a}": value(a) for a in range(AXES)}).drop(*[f"__{k}" for k in keys], *[f"__w{a}" for a in range(AXES)])


def save(weights: DataFrame, path: str) -> None:
    weights.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Weights that save() wrote; a folder with anything else is an error."""
    out = spark.read.parquet(path)
    if not {"axis", "w"} <= set(out.columns):
        raise ValueError(f"{path} holds no weights")
    return out


assert len(TERMS) == math.comb(AXES + 3, 3) - 1

"""Point sets: the assignment of least total distance, filtered matches, and coherent point drift.

A pair of point sets is one task's work. Their sizes are limits that the caller states, as control points
are sampled before they are matched; many pairs run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelia.operators import polynomial
from voxelia.store import kept

#: Point sets beyond these sizes are refused: sample them first.
MOST_SOURCES, MOST_TARGETS = 5_000, 30_000
BLOCK_CELLS = 4_000_000


def least_cost(cost: np.ndarray) -> np.ndarray:
    """For each row of a matrix with no more rows than columns, its column in the assignment of least total cost.

    Rows enter one by one. Each looks for the shortest way to a free column over reduced costs, with dual
    prices of rows and columns, and the assignments along it move by one.
    """
    rows, columns = cost.shape
    row_price, price = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for start in range(rows):
        reach, before, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, column, way = start, -1, 0.0
        while row >= 0:
            if column >= 0:
                done[column] = True
            step = way + cost[row] - row_price[row] - price
            better = ~done & (step < reach)
            reach[better], before[better] = step[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            way, row = reach[column], owner[column]
        price[done] += reach[done] - way
        row_price[start] += way
        row_price[owner[done]] += way - reach[done]
        while True:
            last = before[column]
            owner[column] = start if last < 0 else owner[last]
            if last < 0:
                break
            column = last
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all places of a to all of b."""
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1), 0.0))


def checked(sources: int, targets: int) -> None:
    if sources > MOST_SOURCES or targets > MOST_TARGETS:
        raise ValueError(f"{sources} and {targets} points are more than {MOST_SOURCES} and {MOST_TARGETS}: sample them first")


def usable(points: pd.DataFrame, axes: tuple[str, ...]) -> pd.DataFrame:
    """Points with a place, by id; a side without rows may come without columns."""
    return points.dropna(subset=list(axes)).sort_values("id") if len(points) else points


def in_order(i: np.ndarray, j: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), where those of i's points that share a place are the first ones there, in the order of j. Distances stay."""
    at = np.unique(places, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((j, at[i]))
    own, members = at[i][order], np.argsort(at, kind="stable")
    return members[np.searchsorted(at[members], own) + np.arange(len(own)) - np.searchsorted(own, own)], j[order]


def matched(targets: DataFrame, sources: DataFrame, *keys: str, axes: tuple[str, ...] = ("c0", "c1", "c2")) -> DataFrame:
    """(keys, target, source, d): the pairs of ids whose distances have the least sum, for each key with points on both sides.

    Both have the keys, id and the axes. The smaller set is matched whole, each of its points with one of the
    other's own. Points of one side at the same place are matched by their ids: the first of them, in the order of their
    partners' ids. Which of several other assignments of the same sum is returned isn't stated. Points with a null or NaN
    place are left out. A key on one side only has no rows.
    """

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t, s = (usable(f, axes) for f in (left, right))
        names = [*keys, "target", "source", "d"]
        if not len(t) or not len(s):
            return pd.DataFrame([], columns=names)
        checked(min(len(s), len(t)), max(len(s), len(t)))
        far = distances(t[list(axes)].to_numpy(float), s[list(axes)].to_numpy(float))
        flip = far.shape[0] > far.shape[1]
        columns = least_cost(far.T if flip else far)
        i, j = (columns, np.arange(len(columns))) if flip else (np.arange(len(columns)), columns)
        i, j = in_order(i, j, t[list(axes)].to_numpy(float))
        j, i = in_order(j, i, s[list(axes)].to_numpy(float))
        out = pd.DataFrame({"target": t["id"].to_numpy()[i], "source": s["id"].to_numpy()[j], "d": far[i, j]})
        for k in keys:
            out[k] = t[k].iloc[0]
        return out[names]

    return pairwise(targets, sources, keys, axes, pair, "target", "source", "d double")


def pairwise(targets: DataFrame, sources: DataFrame, keys: tuple[str, ...], axes: tuple[str, ...], run, one: str, other: str, rest: str) -> DataFrame:
    kind = lambda f, c: f.schema[c].dataType.simpleString()
    # fresh names of both sides' columns: frames of one origin would share theirs
    targets, sources = (f.select(*[F.col(c).alias(c) for c in (*keys, "id", *axes)]) for f in (targets, sources))
    schema = [f"{k} {kind(targets, k)}" for k in keys] + [f"{n} {kind(f, 'id')}" for n, f in ((one, targets), (other, sources)) if n] + [rest]
    return targets.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInPandas(run, ", ".join(schema))


def blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, BLOCK_CELLS // max(width, 1))
    for at in range(0, n, step):
        yield slice(at, at + step)


def drift(x: np.ndarray, y: np.ndarray, alpha: float, beta: float, most_rounds: int, tolerance: float, rank: int) -> np.ndarray:
    """y moved coherently onto x: expectation maximisation of a mixture with its centres at y.

    The motion is smooth by a Gaussian kernel of width beta over y, kept as its ``rank`` largest eigenvectors,
    and weighs alpha against the fit. Probabilities are made and summed in blocks of x, so no matrix of all pairs is held.
    """
    (n, d), m = x.shape, len(y)
    kernel = np.exp(-((y[:, None, :] - y[None, :, :]) ** 2).sum(-1) / (2 * beta * beta))
    size, axes = np.linalg.eigh(kernel)
    top = np.argsort(-size)[: min(rank, m)]
    top = top[size[top] > 1e-12 * size[top[0]]]
    size, axes = size[top], axes[:, top]
    spread = sum(((x[b, None, :] - y[None, :, :]) ** 2).sum() for b in blocks(n, m * d)) / (d * n * m)
    moved = y.copy()
    for _ in range(most_rounds):
        if spread <= 1e-12:
            break
        p1, px, total, own = np.zeros(m), np.zeros((m, d)), 0.0, 0.0
        for b in blocks(n, m * d):
            far = ((x[b, None, :] - moved[None, :, :]) ** 2).sum(-1)
            p = np.exp(-(far - far.min(1, keepdims=True)) / (2 * spread))
            p /= p.sum(1, keepdims=True)
            p1 += p.sum(0)
            px += p.T @ x[b]
            total += p.sum()
            own += (p.sum(1) * (x[b] ** 2).sum(1)).sum()
        # (diag(p1) G + alpha spread I) W = PX - diag(p1) Y, with G = Q S Q', by the matrix inversion lemma
        right = px - p1[:, None] * y
        scale = alpha * spread
        inner = scale * np.diag(1 / size) + axes.T @ (p1[:, None] * axes)
        w = (right - p1[:, None] * (axes @ np.linalg.solve(inner, axes.T @ right))) / scale
        moved = y + axes @ (size[:, None] * (axes.T @ w))
        before, spread = spread, (own - 2 * (moved * px).sum() + (p1 * (moved**2).sum(1)).sum()) / (total * d)
        spread = max(spread, tolerance / 10)
        if abs(before - spread) < tolerance * max(spread, tolerance):
            break
    return moved


def drifted(targets: DataFrame, sources: DataFrame, *keys: str, axes: tuple[str, ...] = ("c0", "c1", "c2"), alpha: float = 0.05, beta: float = 30.0, most_rounds: int = 1000, tolerance: float = 1e-5, rank: int = 300) -> DataFrame:
    """(keys, source, axes): the sources of each key after coherent point drift onto its targets.

    Points with a null or NaN place are left out; sources of a key without targets stay where they are, a key
    without sources has no rows. Sets beyond MOST_SOURCES and MOST_TARGETS are refused.
    """

    def move(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t, s = (usable(f, axes) for f in (left, right))
        names = [*keys, "source", *axes]
        if not len(s):
            return pd.DataFrame([], columns=names)
        checked(len(s), len(t))
        place = s[list(axes)].to_numpy(float)
        if len(t):
            place = drift(t[list(axes)].to_numpy(float), place, alpha, beta, most_rounds, tolerance, rank)
        out = pd.DataFrame(place, columns=list(axes))
        out["source"] = s["id"].to_numpy()
        for k in keys:
            out[k] = s[k].iloc[0]
        return out[names]

    return pairwise(targets, sources, keys, axes, move, "", "source", ", ".join(f"{a} double" for a in axes))


def estimated(targets: DataFrame, sources: DataFrame, *keys: str, axes: tuple[str, ...] = ("c0", "c1", "c2"), within: float = 1.0, alpha: float = 1.0, **how) -> DataFrame:
    """(keys, axis, w): the cubic map from the targets' space to the sources' (see polynomial.fitted), for each key.

    The sources drift onto the targets, are matched there, and the matches nearer than ``within`` fit the map
    from target places to the sources' own places. ``how`` goes to drifted().
    """
    moved = drifted(targets, sources, *keys, axes=axes, **how).withColumnRenamed("source", "id")
    pairs = matched(targets, moved, *keys, axes=axes).where(F.col("d") < within)
    t = targets.select(*keys, F.col("id").alias("target"), *[F.col(a).alias(f"t{k}") for k, a in enumerate(axes)])
    s = sources.select(*keys, F.col("id").alias("source"), *[F.col(a).alias(f"s{k}") for k, a in enumerate(axes)])
    found = kept(pairs.join(t, [*keys, "target"]).join(s, [*keys, "source"]), "matches")  # the fit reads them twice
    return polynomial.fitted(found, *keys, alpha=alpha)

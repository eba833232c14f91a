"""Mean-shift clusters of single values: modes of a histogram, then a second level inside each cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelia.carriers import small

#: A histogram of more bins than this is refused: choose a coarser resolution.
MOST_BINS = 1_000_000
FIT = "label long, centre double, deviation double, n long"


def histogram(values: DataFrame, resolution: float, *keys: str, value: str = "v") -> DataFrame:
    """(keys, bin, n): values to the nearest multiple of resolution; nulls and NaN don't count."""
    v = F.col(value).cast("double")
    return values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, F.round(v / resolution).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def kth_distances(bins: np.ndarray, upto: np.ndarray, k: int) -> np.ndarray:
    """For every bin, the distance to its k-th nearest value, itself first; upto counts the values before each bin."""
    lo, hi = np.zeros(len(bins), np.int64), np.full(len(bins), int(bins[-1] - bins[0]), np.int64)
    while (lo < hi).any():
        d = (lo + hi) // 2
        enough = upto[np.searchsorted(bins, bins + d, "right")] - upto[np.searchsorted(bins, bins - d, "left")] >= k
        lo, hi = np.where(enough, lo, d + 1), np.where(enough, d, hi)
    return lo


def modes(bins: np.ndarray, n: np.ndarray, quantile: float, most_rounds: int) -> np.ndarray:
    """Modes of a histogram with sorted bins, the one with most values around it first.

    The bandwidth is the mean distance of all values to their k-th nearest, k a quantile of their number. Every
    bin is a seed; all move together to the mean of what is within the bandwidth until they move by less than a
    thousandth of it. Of modes within a bandwidth the first stays.
    """
    upto, moment = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * bins)])
    width = float((n * kth_distances(bins, upto, max(1, int(upto[-1] * quantile)))).sum() / upto[-1])
    place, inside, moving = bins.astype(float), np.zeros(len(bins), np.int64), np.ones(len(bins), bool)
    for _ in range(most_rounds + 1):
        at = place[moving]
        first, last = np.searchsorted(bins, at - width, "left"), np.searchsorted(bins, at + width, "right")
        inside[moving] = upto[last] - upto[first]
        some = upto[last] > upto[first]  # a mean may lie where nothing is within the bandwidth
        to = np.where(some, (moment[last] - moment[first]) / np.maximum(upto[last] - upto[first], 1), at)
        place[moving] = to
        moving[moving] = some & (np.abs(to - at) > 1e-3 * width)
        if not moving.any():
            break
    order = np.lexsort((-place, -inside))
    stay: list[float] = []
    for p in place[order][inside[order] > 0]:
        if all(abs(p - q) > width for q in stay):
            stay.append(p)
    return np.array(stay)


def mean_shift(binned: DataFrame, resolution: float, *keys: str, quantile: float = 0.3, most_rounds: int = 300) -> DataFrame:
    """(keys, label, centre, deviation, n): clusters of histograms (keys, bin, n) as histogram() makes them.

    label counts the modes from the one with most values around it; a value belongs to the nearest, the first
    of equally near ones; deviation is the population's standard deviation of the distances to the centre, n
    the number of values. The work of a key is on its histogram, of MOST_BINS bins at most, however many
    values there are; an empty table gives no rows.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MOST_BINS:
            raise ValueError(f"a histogram has {len(rows)} bins, more than {MOST_BINS}: choose a coarser resolution")
        own = rows.sort_values("bin")
        bins, n = own["bin"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        centres = modes(bins, n, quantile, most_rounds)
        far = np.abs(bins[:, None] - centres[None, :]) if len(bins) * len(centres) <= 10**7 else None
        which = far.argmin(1) if far is not None else np.array([np.abs(b - centres).argmin() for b in bins])
        out = []
        for k, c in enumerate(centres):
            d, w = np.abs(bins[which == k] - c), n[which == k]
            spread = np.sqrt(max(np.average(d * d, weights=w) - np.average(d, weights=w) ** 2, 0.0)) if w.sum() else 0.0
            out.append([*rows.iloc[0][list(keys)], k, c * resolution, spread * resolution, int(w.sum())])
        return pd.DataFrame(out, columns=[*keys, "label", "centre", "deviation", "n"])

    kinds = ", ".join(f"{k} {binned.schema[k].dataType.simpleString()}" for k in keys)
    return binned.groupBy(*keys).applyInPandas(fit, f"{kinds}, {FIT}" if keys else FIT)


def assigned(values: DataFrame, fits: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """values with label and membership exp(-d / (1e-7 + deviation)) of the nearest centre of their key, and d.

    The centres of a key are one row; they are broadcast where they are few, else joined. Values of a key without
    centres have nulls.
    """
    own = fits.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sort_array(F.collect_list(F.struct("label", "centre", "deviation"))).alias("__c"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = values.join(small(own), same, "left") if keys else values.crossJoin(F.broadcast(own))  # one row
    far = F.transform("__c", lambda c: F.struct(F.abs(F.col(value) - c["centre"]).alias("d"), c["label"].alias("label"), c["deviation"].alias("deviation")))
    best = both.withColumn("__b", F.array_min(far)).drop("__c", *[f"__{k}" for k in keys])
    return best.withColumns({"label": F.col("__b.label"), "d": F.col("__b.d"), "membership": F.exp(-F.col("__b.d") / (F.col("__b.deviation") + 1e-7))}).drop("__b")


def second_level(values: DataFrame, fits: DataFrame, resolution: float, *keys: str, value: str = "v", quantile: float = 0.3) -> DataFrame:
    """(keys, label, sub, centre, deviation, n): clusters of the memberships of each first-level cluster's own values."""
    scored = assigned(values, fits, *keys, value=value)
    sub = mean_shift(histogram(scored, resolution, *keys, "label", value="membership").withColumnRenamed("label", "first"), resolution, *keys, "first", quantile=quantile)
    return sub.withColumnRenamed("label", "sub").withColumnRenamed("first", "label").select(*keys, "label", "sub", "centre", "deviation", "n")


def full_labels(values: DataFrame, fits: DataFrame, subs: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """values with label, the first level's, sub, the second level's, and full, counted over all of a key's second-level clusters."""
    from pyspark.sql import Window as W

    first = assigned(values, fits, *keys, value=value).drop("d").withColumnRenamed("label", "first")
    counts = subs.groupBy(*keys, "label").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy(*keys).orderBy("label").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select(*keys, F.col("label").alias("first"), before.alias("offset"))
    own = subs.withColumnRenamed("label", "first").withColumnRenamed("sub", "label")
    second = assigned(first.withColumnRenamed("membership", "score"), own, *keys, "first", value="score").drop("d", "membership")
    full = F.coalesce(F.col("label") + F.col("offset"), F.lit(-1)).cast("long")
    return second.join(small(offset), [*keys, "first"], "left").withColumn("full", full).drop("offset", "score").withColumnRenamed("label", "sub").withColumnRenamed("first", "label")

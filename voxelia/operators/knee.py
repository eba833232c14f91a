"""The value above which values are rare: the knee of a smoothed histogram that falls off."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 100


def smoothed_histogram(values: DataFrame, *keys: str, sigma: float = 3.0, value: str = "v") -> DataFrame:
    """(keys, bin, edge, s): BINS equal bins from the least to the greatest value of each key, their right edges, and
    their counts under a Gaussian of sigma bins, cut at four sigmas, the border mirrored with its bin repeated.

    The last bin holds the greatest value. Nulls and NaN don't count; a key whose values are all equal has none of these
    rows. Values are counted once with a map-side combine; what follows has BINS rows a key.
    """
    v = F.col(value).cast("double")
    own = values.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("v"))
    ends = own.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    joined = own.join(ends, list(keys)) if keys else own.join(F.broadcast(ends))  # one row
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / BINS)), F.lit(BINS - 1)).cast("int")
    counted = joined.groupBy(*keys, "lo", "hi", at.alias("from")).agg(F.count("*").alias("n"))
    reach = math.ceil(4 * sigma)
    weight = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)}
    total = sum(weight.values())
    # a count goes to the bins around it, those beyond the border to their mirror image
    spread = F.explode(F.array(*[F.struct((F.col("from") + d).alias("b"), F.lit(w / total).alias("w")) for d, w in weight.items()])).alias("to")
    seen = counted.select(*keys, "lo", "hi", "n", "from", spread)
    source = seen.select(*keys, "lo", "hi", "n", F.col("to.w").alias("w"), F.array(F.col("to.b"), -1 - F.col("to.b"), 2 * BINS - 1 - F.col("to.b")).alias("places"))
    inside = source.select(*keys, "lo", "hi", "n", "w", F.explode(F.filter("places", lambda p: (p >= 0) & (p < BINS))).alias("bin"))
    sums = inside.groupBy(*keys, "lo", "hi", "bin").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    every = ends.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    edge = F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / BINS
    return every.join(sums, [*keys, "lo", "hi", "bin"], "left").select(*keys, "bin", edge.alias("edge"), F.coalesce("s", F.lit(0.0)).alias("s"))


def knees(curve: DataFrame, key: str, *more: str, sensitivity: float = 1.0) -> DataFrame:
    """(keys, knee): the knee of each key's curve (bin, edge, s), which falls and flattens; null where there is none.

    Kneedle: both axes are scaled to one, the curve is turned upside down, and its height above the diagonal examined. A
    local maximum is a knee if the height falls by more than the sensitivity times the mean step before it turns up again, or
    below zero before the next maximum. The first such maximum counts. A flat curve has no knee.
    """
    keys = (key, *more)
    w = W.partitionBy(*keys)
    line = w.orderBy("bin")
    last, low, high = F.max("bin").over(w) - F.min("bin").over(w), F.min("s").over(w), F.max("s").over(w)
    height = F.when(high > low, (high - F.col("s")) / (high - low)) - (F.col("bin") - F.min("bin").over(w)) / last
    d = curve.select(*keys, "bin", "edge", height.alias("d"), (sensitivity / last).alias("fall"))
    before, after = F.lag("d").over(line), F.lead("d").over(line)
    d = d.withColumn("top", (F.col("d") > before) & (F.col("d") > after)).withColumn("dip", (F.col("d") < before) & (F.col("d") < after))
    rest = line.rowsBetween(1, W.unboundedFollowing)
    d = d.withColumn("next_top", F.min(F.when(F.col("top"), F.col("bin"))).over(rest)).withColumn("next_dip", F.min(F.when(F.col("dip"), F.col("bin"))).over(rest))
    later = F.collect_list(F.struct("bin", "d")).over(rest)
    d = d.withColumn("later", F.when(F.col("top"), later)).where("top")
    limit = F.col("d") - F.col("fall")
    falls = F.exists("later", lambda x: (x["bin"] <= F.coalesce("next_top", F.lit(1 << 30))) & (x["d"] < F.when(x["bin"] > F.coalesce("next_dip", F.lit(1 << 30)), 0.0).otherwise(limit)))
    first = d.where(falls).groupBy(*keys).agg(F.min_by("edge", "bin").alias("knee"))
    return curve.select(*keys).distinct().join(first, list(keys), "left")

"""Vectors: normalising, similarity, nearest neighbours, ranking measures, pooling, whitening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia.carriers import small


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v) -> Column:
    """v / max(|v|, 1e-12)."""
    v = F.transform(v, lambda x: x.cast("double"))
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / size)


def unit(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("u", normalised("embedding"))


def similarities(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(q, id, q_label, label, sim): every query against every row. The queries are a stated set; where they
    are few, they go to the base rows, which then don't move."""
    q = queries.select(F.col("vec_id").alias("q"), F.col("label").alias("q_label"), F.col("u").alias("qu"))
    return base.join(small(q)).select("q", F.col("vec_id").alias("id"), "q_label", "label", F.round(dot("qu", "u"), 12).alias("sim"))


#: Rows of a block of queries and of the base: a pair of blocks is one matrix product.
QUERY_BLOCK, BASE_BLOCK = 1024, 4096


def in_blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows (vec_id, label, u) dealt by a hash of their id into blocks of about size: one row a block, with lists of ids, labels and vectors."""
    n = max(1, -(-rows.count() // size))
    each = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), F.struct("vec_id", "label", "u").alias("r"))
    return each.groupBy("block").agg(F.collect_list("r").alias("r")).select(*[F.col(f"r.{c}").alias(f"{prefix}_{c}") for c in ("vec_id", "label", "u")])


def nearest(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(q, id, q_label, label, sim, rank): the k rows of base most similar to each query, the smaller id first among equals.

    Both have vec_id, label and the unit vector u. Queries meet the base in blocks; of every pair of blocks only the k best of each
    query go on, so what is shuffled and sorted grows with queries x k x blocks and not with queries x rows.
    Similarities are rounded to 12 digits, so that equal vectors are equal. Rows with a null vector are left out.
    """
    q, b = (in_blocks(f.where("u is not null"), n, name) for f, n, name in ((queries, QUERY_BLOCK, "q"), (base, BASE_BLOCK, "b")))
    kinds = {"q": queries.schema["vec_id"].dataType, "id": base.schema["vec_id"].dataType, "q_label": queries.schema["label"].dataType, "label": base.schema["label"].dataType}

    def best(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                sim = np.round(np.stack(r.q_u) @ np.stack(r.b_u).T, 12)
                ids, labels = np.asarray(r.b_vec_id), np.asarray(r.b_label)
                order = np.stack([np.lexsort((ids, -row))[:k] for row in sim])
                m = order.shape[1]
                yield pd.DataFrame({"q": np.repeat(r.q_vec_id, m), "id": ids[order].ravel(), "q_label": np.repeat(r.q_label, m), "label": labels[order].ravel(), "sim": np.take_along_axis(sim, order, 1).ravel()})

    pairs = b.join(F.broadcast(q)) if queries.count() <= 4 * QUERY_BLOCK else b.join(q)
    found = pairs.mapInPandas(best, ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", sim double")
    return top(found, k)


def top(sims: DataFrame, k: int) -> DataFrame:
    """The k most similar rows of each query, rank from 1; the smaller id first among equals."""
    w = W.partitionBy("q").orderBy(F.desc("sim"), "id")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def votes(neighbours: DataFrame, temperature: float) -> DataFrame:
    """(q, q_label, label, votes, place): labels by the sum of exp(sim / temperature)."""
    v = neighbours.groupBy("q", "q_label", "label").agg(F.sum(F.exp(F.col("sim") / temperature)).alias("votes"))
    return v.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("votes"), "label")))


def accuracy(voted: DataFrame, k: int) -> DataFrame:
    """Per cent of queries whose label is first, and among the first min(5, k)."""
    hit = voted.groupBy("q").agg(F.max(((F.col("label") == F.col("q_label")) & (F.col("place") == 1)).cast("int")).alias("one"), F.max(((F.col("label") == F.col("q_label")) & (F.col("place") <= min(5, k))).cast("int")).alias("five"))
    return hit.agg((F.avg("one") * 100).alias("top1"), (F.avg("five") * 100).alias("top5")).select(F.lit(k).cast("long").alias("k"), "top1", "top5")


def average_precision(ranked: DataFrame) -> DataFrame:
    """(q, ap) of (q, rank from 0, relevant, junk): junk before a positive doesn't count as a rank.

    Trapezoid rule: each positive adds the mean of the precisions before and at it, over the positives.
    """
    w = W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    moved = ranked.withColumn("r", F.col("rank") - F.coalesce(F.sum(F.col("junk").cast("long")).over(w), F.lit(0))).where("relevant")
    j = (F.row_number().over(W.partitionBy("q").orderBy("rank")) - 1).alias("j")
    each = moved.select("q", "r", j)
    before = F.when(F.col("r") == 0, 1.0).otherwise(F.col("j") / F.col("r"))
    return each.groupBy("q").agg((F.sum((before + (F.col("j") + 1) / (F.col("r") + 1)) / 2) / F.count("*")).alias("ap"))


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    """(q, p): positives among the first k, over min(last positive's place, k)."""
    w = W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    moved = ranked.withColumn("r", F.col("rank") - F.coalesce(F.sum(F.col("junk").cast("long")).over(w), F.lit(0)) + 1).where("relevant")
    kq = F.least(F.max("r"), F.lit(k))
    each = moved.groupBy("q").agg(kq.alias("kq"), F.collect_list("r").alias("all"))
    return each.select("q", (F.size(F.filter("all", lambda r: r <= F.col("kq"))) / F.col("kq")).alias("p"))


def gram(vectors: DataFrame) -> DataFrame:
    """(i, j, g): second moments X'X / n, i <= j. Products are summed by position, so only d^2 / 2 sums move."""
    rows = vectors.select(F.posexplode("embedding").alias("i", "a"), "embedding")
    pairs = rows.select("i", "a", F.posexplode("embedding").alias("j", "b")).where("i <= j")
    return pairs.groupBy("i", "j").agg(F.avg(F.col("a").cast("double") * F.col("b")).alias("g"))


def whitening(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) that whiten: second moments of centred rows, eigenvalues floored at 1e-5 of the largest.
    Only d means and d^2 / 2 moments reach the driver."""
    mean = np.array([r[1] for r in vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x")).orderBy("i").collect()])
    m = np.zeros((dims, dims))
    for i, j, g in gram(vectors).collect():
        m[i, j] = m[j, i] = g - mean[i] * mean[j]
    size, axes = np.linalg.eigh(m)
    return mean, np.diag(np.maximum(size, size.max() * 1e-5) ** -0.5) @ axes.T


def whitened(vectors: DataFrame, mean: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """vectors with w, the whitened embedding, computed row by row in the JVM."""
    centred = F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    return vectors.withColumn("centred", centred).withColumn("w", F.transform(rows, lambda r: dot(r, "centred"))).drop("centred")


def generalised_mean(values: DataFrame, power: float = 4.0, least: float = 1e-6) -> DataFrame:
    """(group, i, g): per position, the power mean of values clamped below."""
    each = values.select("group", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("group", "i").agg(F.pow(F.avg(F.pow(F.greatest(F.col("x").cast("double"), F.lit(least)), F.lit(power))), F.lit(1 / power)).alias("g"))


def propagate(edges: DataFrame, k: int, temperature: float = 0.1) -> DataFrame:
    """(target, label, weight): label weights from the k strongest sources (ties of the k-th stay), each
    target's affinities exp(sim / temperature) scaled to one."""
    w = W.partitionBy("target").orderBy(F.desc("aff"))
    kept = edges.withColumn("aff", F.exp(F.col("sim") / temperature)).withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)
    scaled = kept.withColumn("share", F.col("aff") / F.sum("aff").over(W.partitionBy("target")))
    return scaled.groupBy("target", "label").agg(F.sum("share").alias("weight"))

"""The acceptance pipeline of slices, in batch and as a stream of slice rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accepted(voxels: DataFrame, threshold: float) -> DataFrame:
    """Voxels of slices whose greatest value reaches threshold; lesser values are zero."""
    top = F.max("v").over(W.partitionBy("scan", "z"))
    kept = voxels.withColumn("top", top).where(F.col("top") >= threshold).drop("top")
    return kept.withColumn("v", F.when(F.col("v") < threshold, 0.0).otherwise(F.col("v")))


def packed(voxels: DataFrame) -> DataFrame:
    """(scan, z, px): one row a slice, its cells as an array of (y, x, v)."""
    return voxels.groupBy("scan", "z").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("px"))


def accepted_slices(slices: DataFrame, threshold: float) -> DataFrame:
    """accepted() on packed slices; works on streams, as every row stands alone."""
    kept = slices.where(F.array_max(F.transform("px", lambda p: p["v"])) >= threshold)
    zeroed = F.transform("px", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"), F.when(p["v"] < threshold, 0.0).otherwise(p["v"]).alias("v")))
    return kept.select("scan", "z", F.inline(zeroed))


def streamed(voxels: DataFrame, threshold: float) -> DataFrame:
    """accepted() by way of a file stream that is run to its end."""
    import uuid

    spark = voxels.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="voxelia-")
    base = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = packed(voxels)
    rows.write.parquet(f"{base}/in")
    stream = accepted_slices(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), threshold)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def running(stream: DataFrame, window: str, late: str) -> DataFrame:
    """(name, window, n, mean, top) of a stream (name, ts, value), late rows up to ``late``: an extension,
    as sums that merge; works in batch too."""
    return stream.withWatermark("ts", late).groupBy("name", F.window("ts", window)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))

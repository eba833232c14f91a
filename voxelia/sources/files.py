"""Scan folders: file names, numbers and shapes in them, recursive reading of slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Extensions that count as images.
IMAGES = ("jpg", "jpeg", "png", "ppm", "bmp", "pgm", "tif", "tiff", "webp")


def number(name: Column) -> Column:
    """The number after the leading I of a slice's file name."""
    return F.regexp_extract(name, r"I(\d+)", 1).cast("long")


def person(name: Column) -> Column:
    parts = F.split(name, r"\^")
    return F.concat_ws(", ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def shaped_name(prefix: Column, *sizes: Column) -> Column:
    """prefix, cut at its first dot, two underscores and the sizes."""
    return F.concat(F.get(F.split(prefix, r"\."), F.lit(0)), F.lit("__"), F.concat_ws("_", *[s.cast("string") for s in sizes]))


def shape(stem: Column) -> Column:
    return F.transform(F.split(F.get(F.split(stem, "__"), F.lit(1)), "_"), lambda x: x.cast("long"))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)).isin(*IMAGES)


def slices(spark: SparkSession, root: str) -> DataFrame:
    """(pid, body_part, scan, number, path, content): slice files I<n> under <pid>/…/<Part><scan>/, any depth.

    Folder names that aren't numbers are no patients. Spark lists and reads the files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "I*").load(root)
    part = F.regexp_extract("path", r"/([A-Za-z]+)(\d+)/", 1)
    out = raw.select(
        F.regexp_extract("path", r"/(\d+)/(?:\d+/)?[A-Za-z]+\d+/", 1).alias("pid"), F.lower(part).alias("body_part"),
        F.regexp_extract("path", r"/([A-Za-z]+)(\d+)/", 2).cast("int").alias("scan"), number(F.regexp_extract("path", r"([^/]+)$", 1)).alias("number"), "path", "content")
    return out.where((F.col("pid") != "") & F.col("number").isNotNull())


def loaded(found: DataFrame, pids: list[str] | None = None, body_part: str | None = None) -> DataFrame:
    """The slices of some patients, or of one body part in any case of letters, or of both; all of them without either."""
    if pids is not None:
        found = found.where(F.col("pid").isin(*pids))
    return found if body_part is None else found.where(F.col("body_part") == body_part.lower())


def voxels(found: DataFrame, n_columns: int) -> DataFrame:
    """(pid, body_part, scan, z, y, x, v): cells of slices whose content is rows of n_columns unsigned 16-bit
    integers, little-endian. z counts the slices of a scan by their numbers, from 0. A slice is decoded
    by itself, so a task holds one at a time; one that ends within a row is an error."""
    order = W.partitionBy("pid", "body_part", "scan").orderBy("number", "path")
    place = found.select("pid", "body_part", "scan", "path", (F.row_number().over(order) - 1).cast("long").alias("z"))  # without contents

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, content = (batch.column(c)[row].as_py() for c in range(2))
                v = np.frombuffer(content or b"", "<u2")
                if len(v) % n_columns:
                    raise ValueError(f"{path} has {len(v)} cells, which don't fill rows of {n_columns}")
                y, x = np.divmod(np.arange(len(v)), n_columns)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(v), pa.string()), "y": y, "x": x, "v": v.astype(np.int32)})

    decoded = found.select("path", "content").mapInArrow(cells, "path string, y long, x long, v int")
    return decoded.join(place, "path").select("pid", "body_part", "scan", "z", "y", "x", "v")


def write_dual(cells: DataFrame, folder: str) -> None:
    """Scaled cells in two orders, by slice and by row: Parquet at folder/axial and folder/coronal, one folder
    a scan, each dealt by the outer axis and sorted within its files. Values are v / (max(max v, 1) - min v)."""
    keys = ["pid", "body_part", "scan"]
    spread = cells.groupBy(*keys).agg((F.greatest(F.max("v"), F.lit(1)) - F.min("v")).alias("spread"))
    scaled = cells.join(spread, keys).select(*keys, "z", "y", "x", (F.col("v") / F.col("spread")).alias("v"))
    for name, outer, inner in (("axial", "z", "y"), ("coronal", "y", "z")):
        scaled.repartition(*keys, outer).sortWithinPartitions(*keys, outer, inner, "x").write.partitionBy(*keys).parquet(f"{folder}/{name}")

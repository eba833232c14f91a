"""Raw arrays in files named prefix__a_b_c.npy, the shape in the name, dealt to partitions by offset.

    memmap.register(spark)
    spark.read.format("memmap").option("dtype", "float64").load(folder)

A row holds up to ``cells`` cells in the order of the file. One file of any size is read by as many tasks as it
has parts, and written by many tasks at their own offsets, each write the same however often it runs.
"""

from __future__ import annotations

import math
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, prefix string, shape array<bigint>, first bigint, v array<double>"
CELLS, PARTITION_CELLS = 1 << 16, 1 << 23


def shape_of(path: str) -> tuple[str, list[int]]:
    """Prefix and shape in a file's name."""
    prefix, mark, sizes = posixpath.basename(path).removesuffix(".npy").rpartition("__")
    if not mark or not all(s.isdigit() for s in sizes.split("_")):
        raise ValueError(f"{path} has no shape in its name")
    return prefix, [int(s) for s in sizes.split("_")]


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        own = {k.lower(): v for k, v in options.items()}
        self.root, self.dtype = own["path"], np.dtype(own.get("dtype", "float64"))
        self.cells, self.most = int(own.get("cells", CELLS)), int(own.get("partitioncells", PARTITION_CELLS))

    def partitions(self) -> list[Part]:
        store, path = FileSystem.from_uri(uri(self.root))
        out = []
        for f in sorted(store.get_file_info(FileSelector(path, recursive=True)), key=lambda f: f.path):
            if f.is_file and f.path.endswith(".npy"):
                n = math.prod(shape_of(f.path)[1])
                if f.size != n * self.dtype.itemsize:
                    raise ValueError(f"{f.path} has {f.size} bytes, not those of {n} cells of {self.dtype}")
                out += [Part(f.path, at, min(n, at + self.most)) for at in range(0, n, self.most)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = FileSystem.from_uri(uri(self.root))
        prefix, shape = shape_of(partition.path)
        with store.open_input_file(partition.path) as f:
            for at in range(partition.first, partition.last, self.cells):
                n = min(self.cells, partition.last - at)
                f.seek(at * self.dtype.itemsize)
                v = np.frombuffer(f.read(n * self.dtype.itemsize), self.dtype).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([prefix]), pa.array([shape], pa.list_(pa.int64())), pa.array([at], pa.int64()), pa.array([v], pa.list_(pa.float64()))], names=["path", "prefix", "shape", "first", "v"])


class MemmapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "memmap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MemmapSource)


def placed(arrays: DataFrame, *axes: str) -> DataFrame:
    """(path, prefix, axes, v) of rows of SCHEMA, a row a cell; arrays of another number of axes are an error."""
    each = arrays.select("path", "prefix", "shape", F.posexplode("v").alias("i", "v"), "first").withColumn("i", F.col("i") + F.col("first"))
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(f" hasn't {len(axes)} axes")))
    below = lambda k: F.aggregate(F.slice("shape", k + 2, len(axes)), F.lit(1).cast("long"), lambda a, x: a * x)
    at = [(F.floor(F.col("i") / below(k)) % F.when(F.size("shape") == len(axes), F.col("shape")[k]).otherwise(wrong.cast("long"))).cast("long").alias(a) for k, a in enumerate(axes)]
    return each.select("path", "prefix", *at, "v")


def write(cells: DataFrame, folder: str, prefix: str, sizes: dict[str, int], dtype: str = "float64", part_cells: int = PARTITION_CELLS) -> list[str]:
    """Write cells (prefix column, axes of sizes, v) to one file each prefix under a mounted folder, and return the paths.

    A prefix is cut at its first dot. Cells that are missing are zero; one outside the sizes, or without a prefix, is an error. Tasks
    write whole parts of part_cells cells, so none holds more, and a part written twice is the same; a file gets its name once all are there.
    """
    target, n, kind = uri(folder).removeprefix("file://"), math.prod(sizes.values()), np.dtype(dtype)
    os.makedirs(target, exist_ok=True)
    index, ok = F.lit(0).cast("long"), F.lit(True)
    for a, size in sizes.items():
        index = index * size + F.col(a)
        ok = ok & F.col(a).between(0, size - 1)
    name = F.get(F.split(F.col(prefix), r"\."), F.lit(0))
    fine = F.when(ok & name.isNotNull(), index).otherwise(F.raise_error(F.lit(f"a cell is outside {sizes} or has no prefix")).cast("long"))
    rows = cells.select(name.alias("name"), fine.alias("i"), F.col("v").cast("double").alias("v")).withColumn("part", F.floor(F.col("i") / part_cells))
    shape = "_".join(map(str, sizes.values()))

    def run(key, part):
        name, k = key
        first = int(k) * part_cells
        block = np.zeros(min(part_cells, n - first), kind)
        block[part["i"].to_numpy() - first] = part["v"].to_numpy().astype(kind)
        path = f"{target}/.{name}__{shape}.npy"
        with os.fdopen(os.open(path, os.O_CREAT | os.O_WRONLY), "wb") as f:  # not emptied: other parts are in it
            f.seek(first * kind.itemsize)
            f.write(block.tobytes())
        return pd.DataFrame({"name": [name]})

    found = rows.groupBy("name", "part").applyInPandas(run, "name string").distinct()
    paths = []
    for (made,) in found.toLocalIterator():
        own, to = f"{target}/.{made}__{shape}.npy", f"{target}/{made}__{shape}.npy"
        os.truncate(own, n * kind.itemsize)
        os.replace(own, to)
        paths.append(to)
    return sorted(paths)

"""Queries that write scans to files of the formats the library reads, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia import carriers as C
from voxelia.carriers import CTE
from voxelia.registry import query
from voxelia.sources import dicom, memmap
from voxelia.store import new_folder

HEAD = f"WITH {CTE['vox']}, loc AS (SELECT l_orderkey % 8 AS z, count(*) AS k FROM lineitem GROUP BY ALL)"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slice of C.vox written as a DICOM file in a scan's folder and read back; its location is 1.4 times z and a little more by its rows in lineitem."""
    dicom.register(spark)
    rows = C.vox(spark, sf_dir).groupBy("scan", "z").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"].cast("int")).alias("px"))  # 256 cells a slice
    extra = C.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("z")).agg(F.count("*").alias("k"))
    shaped = rows.join(extra, "z").select(
        F.concat_ws("/", F.concat(F.lit("Abdo"), (F.col("scan") + 1).cast("string")), F.lit("DICOM"), F.concat(F.lit("I"), F.col("z").cast("string"))).alias("path"),
        F.lit("NAME^NONE").alias("patient_name"), F.lit("123").alias("patient_id"), (F.col("z") * 1.4 + F.col("k") % 7 / 100).alias("slice_location"),
        F.array(F.lit(0.5), F.lit(0.75)).alias("spacing"), F.lit(C.SIDE).alias("rows"), F.lit(C.SIDE).alias("columns"), "px")
    folder = new_folder(spark, "dicom")
    shaped.write.format("dicom").mode("append").save(folder)
    scan = (F.regexp_extract("path", r"/Abdo(\d+)/", 1).cast("long") - 1).alias("scan")
    return spark.read.format("dicom").load(folder).withColumn("scan", scan).withColumn("z", F.regexp_extract("path", r"/I(\d+)$", 1).cast("long"))


@query(HEAD + " SELECT scan, z, y, x, v::BIGINT % 65536 AS v, round(z * 1.4::DOUBLE + k % 7 / 100, 6) AS location FROM vox JOIN loc USING (z)")
def dicom_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and locations of the stored slices, as they come back from the files."""
    return dicom.cells(stored(spark, sf_dir), "scan", "z", "slice_location").select("scan", "z", "y", "x", F.col("v").cast("long").alias("v"), F.round("slice_location", 6).alias("location"))


@query(HEAD + " SELECT s.i AS scan, 8::BIGINT AS n, 16::BIGINT AS \"rows\", 16::BIGINT AS \"columns\", 8::BIGINT AS row_mm, 12::BIGINT AS column_mm, round(8 * ((max(z * 1.4::DOUBLE + k % 7 / 100) - min(z * 1.4::DOUBLE + k % 7 / 100)) / 7) / 0.7::DOUBLE)::BIGINT AS depth FROM loc, range(2) s(i) GROUP BY s.i")
def dicom_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stored scan measures at one millimetre in its planes and 0.7 between them, from the files' heads."""
    found = dicom.shapes(stored(spark, sf_dir), "scan")
    return found.withColumns({c: F.col(c).cast("long") for c in ("rows", "columns")})


@query(f"WITH {CTE['vox']} SELECT scan, z, y, x, v FROM vox")
def memmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both volumes written to raw array files at many offsets, and read back by parts."""
    memmap.register(spark)
    folder = new_folder(spark, "memmap")
    cells = C.vox(spark, sf_dir).withColumn("name", F.concat(F.lit("scan"), F.col("scan").cast("string"), F.lit(".raw")))
    memmap.write(cells, folder, "name", {"z": C.DEPTH, "y": C.SIDE, "x": C.SIDE}, part_cells=500)
    read = spark.read.format("memmap").option("partitionCells", 300).option("cells", 100).load(folder)
    return memmap.placed(read, "z", "y", "x").select(F.regexp_extract("prefix", r"(\d+)$", 1).cast("long").alias("scan"), "z", "y", "x", "v")

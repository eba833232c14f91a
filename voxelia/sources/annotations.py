"""Annotation tables as read from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "Patient INT, Scan STRING, Slice STRING, X STRING, Y STRING"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SCHEMA)


def parsed(rows: DataFrame) -> DataFrame:
    """(patient, body_part, scan, axial, coronal, sagittal) of rows whose Slice, X and Y are whole numbers.

    X or Y of -1 means no location and drops the row; a Slice of -1 is kept.
    """
    whole = lambda c: F.col(c).rlike(r"^[+-]?[0-9]+$")
    good = rows.where(whole("Slice") & whole("X") & whole("Y") & (F.col("X") != "-1") & (F.col("Y") != "-1"))
    n = F.length("Scan")
    return good.select(
        F.col("Patient").cast("long").alias("patient"), F.col("Scan").substr(F.lit(1), n - 1).alias("body_part"), F.col("Scan").substr(n, F.lit(1)).cast("long").alias("scan"),
        F.col("Slice").cast("long").alias("axial"), F.col("Y").cast("long").alias("coronal"), F.col("X").cast("long").alias("sagittal"))


def nested(parsed_rows: DataFrame) -> DataFrame:
    """(patient, body_part, scans): for each scan the list of its locations."""
    each = parsed_rows.groupBy("patient", "body_part", "scan").agg(F.sort_array(F.collect_list(F.array("axial", "coronal", "sagittal"))).alias("at"))
    return each.groupBy("patient", "body_part").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("scan", "at")))).alias("scans"))

"""Operators on small inputs with known answers, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from voxelia.operators import grid as G
from voxelia.sources import annotations
from voxelia.streaming import slices


def cells(spark, rows):
    return spark.createDataFrame(rows, "scan long, z long, y long, x long, v double")


def test_minmax_u8_truncates_and_survives_constant_slices(spark):
    df = cells(spark, [(0, 0, 0, i, float(v)) for i, v in enumerate((0, 1000, 2000))] + [(0, 1, 0, 0, 7.0)])
    got = {(r.z, r.x): r.u8 for r in G.minmax_u8(df, "scan", "z").collect()}
    assert got == {(0, 0): 0, (0, 1): 127, (0, 2): 255, (1, 0): 0}


def test_clip_u8_on_nothing(spark):
    assert G.clip_u8(cells(spark, []), 2000.0).count() == 0


def test_accepted_in_batch_and_stream_agree(spark):
    df = cells(spark, [(0, z, y, x, float(100 * z + 10 * y + x)) for z in range(4) for y in range(3) for x in range(3)])
    batch = {tuple(r) for r in slices.accepted(df, 210.0).select("scan", "z", "y", "x", "v").collect()}
    stream = {tuple(r) for r in slices.streamed(df, 210.0).select("scan", "z", "y", "x", "v").collect()}
    assert batch == stream and {r[1] for r in batch} == {2, 3}


@pytest.mark.parametrize(("row", "kept"), [((1, "Abdo1", "5", "7", "9"), True), ((1, "Abdo2", "-1", "7", "9"), True), ((1, "Abdo1", "5", "-1", "9"), False), ((1, "Abdo1", "x", "1", "9"), False), ((1, "Abdo1", None, "1", "9"), False)])
def test_annotations(spark, row, kept):
    df = spark.createDataFrame([row], annotations.SCHEMA)
    assert annotations.parsed(df).count() == kept


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Patient,Scan,Slice,X,Y\n1,Abdo1,5,2,3\n1,Abdo1,6,4,5\n1,Abdo2,nan,1,1\n")
    out = annotations.nested(annotations.parsed(annotations.read(spark, str(tmp_path / "a.csv")))).select("patient", F.map_keys("scans").alias("k"), F.map_values("scans").alias("v")).first()
    assert (out.patient, out.k, out.v) == (1, [1], [[[5, 3, 2], [6, 5, 4]]])

"""Scan folders on disk: listing, loading, decoding and storing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelia.sources import files


@pytest.fixture
def root(tmp_path):
    """Two patients, one with dated folders, scans of slices I1, I2 and I10 of 2 x 3 cells, and files that are none."""
    for pid, part in (("7", "Abdo1"), ("7", "Abdo2"), ("12/20200101", "Thorax1")):
        folder = tmp_path / "in" / pid / part / "DICOM"
        folder.mkdir(parents=True)
        for k in (1, 10, 2):
            (folder / f"I{k}").write_bytes(np.arange(6, dtype="<u2").tobytes() if k == 1 else np.full(6, 100 * k, "<u2").tobytes())
        (folder / "notes.txt").write_text("no slice")
    (tmp_path / "in" / "misc" / "Abdo1").mkdir(parents=True)
    (tmp_path / "in" / "misc" / "Abdo1" / "I1").write_bytes(b"")
    return tmp_path


def test_slices_are_found_at_any_depth(spark, root):
    found = files.slices(spark, f"{root}/in")
    assert sorted((r.pid, r.body_part, r.scan, r.number) for r in found.collect()) == sorted((p, b, s, k) for p, b, s in (("7", "abdo", 1), ("7", "abdo", 2), ("12", "thorax", 1)) for k in (1, 2, 10))
    assert files.loaded(found, ["12"]).count() == 3 and files.loaded(found, ["7", "12"]).count() == 9
    assert files.loaded(found, body_part="ABDO").count() == 6 and files.loaded(found, ["12"], "abdo").count() == 0


def test_cells_are_in_the_order_of_the_numbers(spark, root):
    cells = files.voxels(files.loaded(files.slices(spark, f"{root}/in"), ["12"]), 3).collect()
    want = {(z, y, x): v for z, plane in enumerate([[[0, 1, 2], [3, 4, 5]], [[200] * 3] * 2, [[1000] * 3] * 2]) for y, row in enumerate(plane) for x, v in enumerate(row)}
    assert {(r.z, r.y, r.x): r.v for r in cells} == want and len(cells) == len(want)
    with pytest.raises(Exception, match="don't fill rows"):
        files.voxels(files.slices(spark, f"{root}/in"), 4).collect()


def test_both_orders_hold_the_scaled_cells(spark, root):
    cells = files.voxels(files.slices(spark, f"{root}/in"), 3)
    files.write_dual(cells, f"{root}/out")
    want = sorted((r.pid, r.body_part, r.scan, r.z, r.y, r.x, r.v / 1000) for r in cells.collect())
    for name in ("axial", "coronal"):
        got = spark.read.parquet(f"{root}/out/{name}").withColumn("pid", F.col("pid").cast("string"))
        assert sorted(tuple(r) for r in got.select("pid", "body_part", "scan", "z", "y", "x", "v").collect()) == want

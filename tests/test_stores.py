"""DICOM and raw array files: round trips, files made by hand, damaged ones."""

import struct

import numpy as np
import pytest

from voxelia.sources import dicom, files, memmap


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    """Two patients, two scans each, two slices of 24 x 32 cells, thickness 0.7."""
    dicom.register(spark)
    r, root = np.random.default_rng(555), tmp_path_factory.mktemp("scans")
    rows = [(f"{p}/{p}/Abdo{k}/DICOM/I{n}", None, None, 1000 + 0.7 * n, None, 24, 32, [int(v) for v in r.integers(0, 255, 24 * 32)]) for p in (1, 2) for k in (1, 2) for n in (0, 1)]
    spark.createDataFrame(rows, dicom.SCHEMA).repartition(3).write.format("dicom").mode("append").save(str(root))
    return root, {r[0]: r for r in rows}


def test_round_trip(spark, scan):
    root, rows = scan
    for got in (spark.read.format("dicom").option("partitionBytes", 4000).load(str(root)), dicom.decoded(files.slices(spark, str(root)))):
        found = got.collect()
        assert len(found) == 8
        for x in found:
            want = rows[x.path.split(f"{root.name}/")[1]]
            assert (x.patient_name, x.patient_id, x.spacing, x.rows, x.columns) == ("NAME^NONE", "123", [0.5, 0.75], 24, 32)
            assert x.px == want[7] and abs(x.slice_location - want[3]) < 1e-9
    assert not [p for p in root.rglob(".*") if p.is_file() and not p.name.endswith(".crc")]


def test_shapes(spark, scan):
    found = spark.read.format("dicom").load(str(scan[0])).selectExpr("*", "regexp_extract(path, '/(\\\\d)/Abdo', 1) AS pid", "regexp_extract(path, 'Abdo(\\\\d)', 1) AS scan")
    assert {(x.n, x.rows, x.columns, x.row_mm, x.column_mm, x.depth) for x in dicom.shapes(found, "pid", "scan").collect()} == {(2, 24, 32, 12, 24, 2)}
    thick = found.withColumn("slice_location", 2 * found.slice_location)  # slices 1.4 apart
    assert {x.depth for x in dicom.shapes(thick, "pid", "scan").collect()} == {4}
    assert {x.depth for x in dicom.shapes(thick.where("path like '%I0'"), "pid", "scan").collect()} == {1}
    assert dicom.cells(found, "pid", "scan").count() == 8 * 24 * 32


def element(tag, value, kind=None):
    value += b" " * (len(value) % 2)
    if kind is None:
        return struct.pack("<HHI", *tag, len(value)) + value
    return struct.pack("<HH", *tag) + kind + (b"\0\0" + struct.pack("<I", len(value)) if kind in dicom.LONG else struct.pack("<H", len(value))) + value


def made(syntax=dicom.EXPLICIT, px=None, extra=b"", bits=16, signed=1):
    meta = element(dicom.SYNTAX, syntax.encode(), b"UI")
    body = element(dicom.SAMPLES, struct.pack("<H", 1), b"US") + element(dicom.ROWS, struct.pack("<H", 2), b"US") + element(dicom.COLUMNS, struct.pack("<H", 3), b"US") + element(dicom.BITS, struct.pack("<H", bits), b"US") + element(dicom.SIGNED, struct.pack("<H", signed), b"US")
    body += element(dicom.INTERCEPT, b"-10", b"DS") + element(dicom.SLOPE, b"2.0", b"DS") + extra
    return b"\0" * 128 + b"DICM" + meta + body + element(dicom.PIXELS, np.array([1, -2, 3, 4, 5, 6], "<i2").tobytes() if px is None else px, b"OW")


def test_explicit_kinds_and_sequences():
    inner = struct.pack("<HHI", *dicom.ITEM, dicom.OPEN) + element((8, 0x100), b"code", b"SH") + struct.pack("<HHI", *dicom.ITEM_END, 0)
    sequence = struct.pack("<HH", 0x0028, 0x3000) + b"SQ\0\0" + struct.pack("<I", dicom.OPEN) + inner + struct.pack("<HHI", *dicom.SEQUENCE_END, 0)
    for extra in (b"", sequence):
        got = dicom.parse(made(extra=extra))
        assert list(got["px"]) == [-8, -14, -4, -2, 0, 2] and (got["rows"], got["columns"], got["spacing"], got["slice_location"]) == (2, 3, None, None)
    assert list(dicom.parse(made(px=bytes(range(6)), bits=8, signed=0))["px"]) == [-10, -8, -6, -4, -2, 0]


@pytest.mark.parametrize("content, says", [
    (b"", "no DICOM"), (b"\0" * 200, "no DICOM"), (made()[:-3], "breaks off"), (made(px=b"\0\0"), "break off"), (made()[:140], "breaks off"),
    (made(syntax="1.2.840.10008.1.2.4.70"), "transfer syntax"), (made(bits=32), "aren't read"),
])
def test_damaged_files(spark, tmp_path, content, says):
    with pytest.raises(dicom.Damaged, match=says):
        dicom.parse(content)
    if says == "transfer syntax":
        dicom.register(spark)
        (tmp_path / "I1").write_bytes(content)
        with pytest.raises(Exception, match=r"I1: transfer syntax"):
            spark.read.format("dicom").load(str(tmp_path)).collect()


def test_writer_refuses(spark, tmp_path):
    dicom.register(spark)
    for path, px in (("../I1", [1]), ("I1", [1, 2])):
        with pytest.raises(Exception, match="below the folder|aren't 1 x 1"):
            spark.createDataFrame([(path, None, None, 1.0, None, 1, 1, px)], dicom.SCHEMA).write.format("dicom").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("I*"))


@pytest.mark.parametrize("dtype", ["float64", "uint16", "bool"])
def test_memmap(spark, tmp_path, dtype):
    memmap.register(spark)
    a = (np.random.default_rng(1).random((3, 2, 5)) * 100).astype(dtype)
    cells = spark.createDataFrame([("first.part", *map(int, at), float(a[at])) for at in np.ndindex(a.shape)] + [("other", 0, 0, 0, 7.0)], "name string, z long, y long, x long, v double").repartition(4)
    paths = memmap.write(cells, str(tmp_path), "name", {"z": 3, "y": 2, "x": 5}, dtype, part_cells=7)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["first__3_2_5.npy", "other__3_2_5.npy"]
    assert (np.memmap(paths[0], dtype, "r", shape=(3, 2, 5)) == a).all() and np.memmap(paths[1], dtype, "r").astype(float).sum() == (1.0 if dtype == "bool" else 7.0)
    read = spark.read.format("memmap").option("dtype", dtype).option("cells", 4).option("partitionCells", 11).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 6 and {tuple(x.shape) for x in read.collect()} == {(3, 2, 5)}
    got = memmap.placed(read, "z", "y", "x").where("prefix = 'first'").collect()
    assert len(got) == 30 and all(x.v == float(a[x.z, x.y, x.x]) for x in got)
    with pytest.raises(Exception, match="axes"):
        memmap.placed(read, "y", "x").collect()


def test_memmap_refuses(spark, tmp_path):
    memmap.register(spark)
    with pytest.raises(Exception, match="outside"):
        memmap.write(spark.createDataFrame([("a", 3, 1.0)], "name string, x long, v double"), str(tmp_path), "name", {"x": 3})
    (tmp_path / "short__3_2.npy").write_bytes(b"\0" * 40)
    with pytest.raises(Exception, match="40 bytes"):
        spark.read.format("memmap").load(str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no shape"):
        memmap.shape_of("plain.npy")
    assert memmap.shape_of("a/prefix__3_2.npy") == ("prefix", [3, 2])

"""Uncompressed DICOM slices as a Spark data source, read and written: one row a file.

    dicom.register(spark)
    spark.read.format("dicom").load(folder)
    df.write.format("dicom").mode("append").save(folder)

Files are listed once, dealt to partitions by their size, and opened where they are read, through pyarrow.fs.
Writers put files under names of their own and only the commit gives them the names they were asked for, so a
task that is lost or runs twice leaves nothing behind. decoded() parses files that Spark's own binaryFile reader
brings, for stores that only Spark knows.
"""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: transfer syntaxes that are read, tags, value kinds with a length of four bytes.
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
SYNTAX, NAME, PATIENT, LOCATION = (0x0002, 0x0010), (0x0010, 0x0010), (0x0010, 0x0020), (0x0020, 0x1041)
SAMPLES, ROWS, COLUMNS, SPACING = (0x0028, 0x0002), (0x0028, 0x0010), (0x0028, 0x0011), (0x0028, 0x0030)
BITS, SIGNED, INTERCEPT, SLOPE, PIXELS = (0x0028, 0x0100), (0x0028, 0x0103), (0x0028, 0x1052), (0x0028, 0x1053), (0x7FE0, 0x0010)
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
ITEM, ITEM_END, SEQUENCE_END, OPEN = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF

SCHEMA = "path string, patient_name string, patient_id string, slice_location double, spacing array<double>, rows int, columns int, px array<int>"
PARTITION_BYTES = 64 << 20


class Damaged(ValueError):
    """A file that isn't DICOM, breaks off, or is compressed."""


def element(data: memoryview, at: int, explicit: bool) -> tuple[tuple[int, int], int, int]:
    """Tag, start and length of the value of the element at ``at``."""
    if at + 8 > len(data):
        raise Damaged("an element breaks off")
    tag = struct.unpack_from("<HH", data, at)
    if not explicit or tag[0] == 0xFFFE:
        return tag, at + 8, struct.unpack_from("<I", data, at + 4)[0]
    if bytes(data[at + 4 : at + 6]) not in LONG:
        return tag, at + 8, struct.unpack_from("<H", data, at + 6)[0]
    if at + 12 > len(data):
        raise Damaged("an element breaks off")
    return tag, at + 12, struct.unpack_from("<I", data, at + 8)[0]


def skipped(data: memoryview, at: int, explicit: bool) -> int:
    """The place behind a sequence or item of open length that begins at ``at``."""
    depth = 1
    while depth:
        tag, start, length = element(data, at, explicit)
        if tag in (ITEM_END, SEQUENCE_END):
            depth, at = depth - 1, start
        elif length == OPEN:
            depth, at = depth + 1, start
        elif tag == ITEM and depth:
            at = start + length
        else:
            at = start + length
    return at


def elements(data: memoryview, at: int, explicit: bool, until: int | None = None) -> Iterator[tuple[tuple[int, int], memoryview, int]]:
    """(tag, value, place behind it) of the elements from ``at`` on; sequences are passed over."""
    while at < len(data):
        tag, start, length = element(data, at, explicit)
        if until is not None and tag[0] > until:
            return
        if length == OPEN:
            if tag == PIXELS:
                raise Damaged("the pixels are compressed")
            at = skipped(data, start, explicit)
            continue
        if start + length > len(data):
            raise Damaged(f"element {tag[0]:04X},{tag[1]:04X} breaks off")
        yield tag, data[start : start + length], start + length
        at = start + length


def text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace").rstrip(" \0")


def parse(content: bytes) -> dict:
    """The fields of SCHEMA but path, from a whole file. px holds the stored values row by row, after slope and intercept if
    the file has them; absent elements are None."""
    data = memoryview(content)
    if len(data) < 132 or bytes(data[128:132]) != b"DICM":
        raise Damaged("no DICOM file")
    found, at = {}, 132
    for tag, value, behind in elements(data, 132, True, until=0x0002):
        found[tag], at = value, behind
    syntax = text(found.get(SYNTAX, memoryview(b""))) or IMPLICIT
    if syntax not in (IMPLICIT, EXPLICIT):
        raise Damaged(f"transfer syntax {syntax} isn't read")
    for tag, value, _ in elements(data, at, syntax == EXPLICIT):
        found[tag] = value
    short = lambda tag, default=None: struct.unpack_from("<H", found[tag])[0] if len(found.get(tag, b"")) >= 2 else default
    decimals = lambda tag: [float(v) for v in text(found[tag]).split("\\") if v.strip()] if tag in found else []
    rows, columns, bits = short(ROWS), short(COLUMNS), short(BITS, 16)
    px = None
    if PIXELS in found:
        if rows is None or columns is None:
            raise Damaged("pixels without rows and columns")
        if short(SAMPLES, 1) != 1 or bits not in (8, 16):
            raise Damaged(f"{short(SAMPLES, 1)} samples of {bits} bits aren't read")
        kind = ("i" if short(SIGNED, 0) else "u") + str(bits // 8)
        if len(found[PIXELS]) < rows * columns * bits // 8:
            raise Damaged(f"{rows} x {columns} pixels break off")
        px = np.frombuffer(found[PIXELS], f"<{kind}", rows * columns).astype(np.int32)
        slope, intercept = (decimals(SLOPE) or [1.0])[0], (decimals(INTERCEPT) or [0.0])[0]
        if (slope, intercept) != (1.0, 0.0):
            px = np.rint(px * slope + intercept).astype(np.int32)
    named = lambda tag: text(found[tag]) if tag in found else None
    return {"patient_name": named(NAME), "patient_id": named(PATIENT), "slice_location": (decimals(LOCATION) or [None])[0], "spacing": decimals(SPACING) or None, "rows": rows, "columns": columns, "px": px}


def encoded(row: dict) -> bytes:
    """A file with implicit value kinds, little-endian, 16 bits unsigned. Cells outside 0 to 65535 are taken modulo 65536."""

    def one(tag, value: bytes, kind: bytes | None = None) -> bytes:
        value += (b"\0" if kind == b"UI" else b" ") * (len(value) % 2)
        return struct.pack("<HH", *tag) + (struct.pack("<I", len(value)) if kind is None else kind + struct.pack("<H", len(value))) + value

    number = lambda v: np.format_float_positional(float(v), trim="-", precision=10).encode()[:16]
    short = lambda v: struct.pack("<H", v)
    rows, columns, px = row["rows"], row["columns"], np.asarray(row["px"], np.int64)
    if len(px) != rows * columns:
        raise ValueError(f"{row['path']}: {len(px)} cells aren't {rows} x {columns}")
    meta = one((0x0002, 0x0002), b"1.2.840.10008.5.1.4.1.1.2", b"UI") + one((0x0002, 0x0003), b"1.2.3", b"UI") + one(SYNTAX, IMPLICIT.encode(), b"UI") + one((0x0002, 0x0012), b"1.2.3.4", b"UI")
    body = [one(NAME, (row.get("patient_name") or "NAME^NONE").encode()), one(PATIENT, (row.get("patient_id") or "123").encode())]
    body += [one(LOCATION, number(1000.0 if row.get("slice_location") is None else row["slice_location"])), one(SAMPLES, short(1)), one((0x0028, 0x0004), b"MONOCHROME2"), one(ROWS, short(rows)), one(COLUMNS, short(columns))]
    body += [one(SPACING, b"\\".join(map(number, row.get("spacing") or [0.5, 0.75]))), one(BITS, short(16)), one((0x0028, 0x0101), short(16)), one((0x0028, 0x0102), short(15)), one(SIGNED, short(0))]
    body += [one(PIXELS, (px % 65536).astype("<u2").tobytes())]
    return b"\0" * 128 + b"DICM" + one((0x0002, 0x0000), struct.pack("<I", len(meta)), b"UL") + meta + b"".join(body)


KINDS = {"path": pa.string(), "patient_name": pa.string(), "patient_id": pa.string(), "slice_location": pa.float64(), "spacing": pa.list_(pa.float64()), "rows": pa.int32(), "columns": pa.int32(), "px": pa.list_(pa.int32())}


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in KINDS.items()], names=list(KINDS))


def located(path: str, content: bytes) -> dict:
    try:
        return {"path": path} | parse(content)
    except Damaged as e:
        raise Damaged(f"{path}: {e}") from e


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        own = {k.lower(): v for k, v in options.items()}
        self.root, self.prefix, self.most = own["path"], own.get("prefix", "I"), int(own.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        store, path = FileSystem.from_uri(uri(self.root))
        found = sorted((f.path, f.size) for f in store.get_file_info(FileSelector(path, recursive=True)) if f.is_file and posixpath.basename(f.path).startswith(self.prefix))
        out, size = [Files([])], 0
        for name, n in found:
            if out[-1].paths and size + n > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(name)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = FileSystem.from_uri(uri(self.root))
        for path in partition.paths:
            with store.open_input_file(path) as f:
                yield batch([located(path, f.read())])


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = FileSystem.from_uri(uri(self.root))
        moves = []
        for rows in iterator:
            for row in rows.to_pylist():
                to = posixpath.normpath(posixpath.join(root, row["path"] or ""))
                if not row["path"] or not to.startswith(posixpath.normpath(root) + "/"):
                    raise ValueError(f"{row['path']} isn't a path below the folder")
                own = posixpath.join(posixpath.dirname(to), f".{uuid.uuid4().hex}")
                store.create_dir(posixpath.dirname(to), recursive=True)
                with store.open_output_stream(own, compression=None) as out:
                    out.write(encoded(row))
                moves.append((own, to))
        return Written(moves)

    def commit(self, messages) -> None:
        store, _ = FileSystem.from_uri(uri(self.root))
        for m in messages:
            for own, to in m.moves if m else []:
                store.move(own, to)

    def abort(self, messages) -> None:
        store, _ = FileSystem.from_uri(uri(self.root))
        for m in messages:
            for own, _ in m.moves if m else []:
                store.delete_file(own)


class DicomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are added to a folder; use mode append and a new folder")
        return Writer(dict(self.options))


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DicomSource)


def decoded(found: DataFrame) -> DataFrame:
    """SCHEMA of files (path, content), such as files.slices() finds; a null content is an error of its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, content = (b.column(c)[k].as_py() for c in range(2))
                yield batch([located(path, content or b"")])

    return found.select("path", "content").mapInArrow(run, SCHEMA)


def cells(slices: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, x, v), a row a pixel."""
    each = slices.select(*keys, "columns", F.posexplode("px").alias("i", "v"))
    return each.select(*keys, F.floor(F.col("i") / F.col("columns")).cast("long").alias("y"), (F.col("i") % F.col("columns")).cast("long").alias("x"), "v")


def shapes(slices: DataFrame, *keys: str, thickness: float = 0.7) -> DataFrame:
    """(keys, n, rows, columns, row_mm, column_mm, depth): what a scan becomes at one millimetre in its planes and ``thickness`` between them.

    Rows, columns and spacing are those of the slice that comes first by location, then path; depth is the number of slices times the
    mean distance between neighbours over the thickness, rounded, or the number itself where they agree. A scan of one slice keeps it.
    """
    first = F.min_by(F.struct("rows", "columns", "spacing"), F.struct("slice_location", "path"))
    g = slices.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("f"), F.min("slice_location").alias("lo"), F.max("slice_location").alias("hi"))
    step = F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1))
    far = step.isNotNull() & (F.abs(step - thickness) > 1e-6)
    mm = lambda size, k: F.round(F.col(f"f.{size}") * F.col("f.spacing")[k]).cast("long")
    return g.select(*keys, "n", F.col("f.rows").alias("rows"), F.col("f.columns").alias("columns"), mm("rows", 0).alias("row_mm"), mm("columns", 1).alias("column_mm"), F.when(far, F.round(F.col("n") * step / thickness)).otherwise(F.col("n")).cast("long").alias("depth"))

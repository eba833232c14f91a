"""WARC archives: exact round trips, a reader of its own on whole files, revisits by brute force."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxelia.llm import warc
from voxelia.llm.common import shared_dir
from voxelia.llm.queries import op12_warc_archives

SCHEMA = "page_id long, url string, html string, id string, Chunk int"
BIG = "é" * 150_000 + "".join(chr(97 + k % 26) for k in range(200_000))
PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (3, None, ""), (4, "http://a/4", None), (5, "http://a/5 x\r\ny", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://a/6", BIG), (7, "http://a/7", BIG), (8, "http://ü/8", "same row"), (8, "http://ü/8", "same row"), (8, "http://ü/8", "same row"), (None, "http://a/n", "no id"),
    (None, None, "same"), (None, None, "only null"), (None, None, "only null"), (10, "http://a/10", BIG), (10, "http://a/10", BIG), (11, "http://b/11", "x" * 64), (12, "http://b/12", "x" * 64),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def wanted(rows, least=0):
    groups, out = {}, []
    for i, u, h in rows:
        groups.setdefault((h or "").encode(), []).append((i, u or ""))
    for body, members in groups.items():
        sum_ = base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = max(members, key=lambda m: -1 if m[0] is None else m[0])
        again = len(members) - 1 if len(body) >= least else 0
        for i, _ in members:
            out.append([i, len(body), sum_, "response", None])
        if again:
            first = next(r for r in out[-len(members) :] if r[0] == top[0])
            for r in out[-len(members) :]:
                if r is not first:
                    r[3:] = ["revisit", top[0]]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(list(r)) for r in df.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")}).collect())


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 1000, "file_bytes": 5000}, {"chunk_bytes": 64, "min_bytes": 64, "level": 0}])
def test_round_trip(spark, how):
    path = shared_dir(spark, "warc-test")
    warc.write(frame(spark, PAGES), path, **how)
    read = warc.read(spark, path, part_bytes=3000, chunk_bytes=777)
    rows = sorted(read.collect(), key=lambda r: (r.id, r.chunk_no))
    assert found(warc.payloads(read)) == wanted(PAGES, how.get("min_bytes", 0)) == found(warc.payloads(warc.read(spark, path, payload=False)))
    bodies = {}
    for r in rows:
        assert r.chunk_no == bodies.get(r.id, (0, b""))[0] and len(r.chunk) <= 777
        bodies[r.id] = (r.chunk_no + 1, bodies.get(r.id, (0, b""))[1] + bytes(r.chunk))
        assert r.upto == len(bodies[r.id][1]) and r.last == (r.sha1 is not None)
        assert r.intact is (True if r.last and r.type == "response" else None)
    assert len(bodies) == len(PAGES)
    whole = sorted(b for i, (_, b) in bodies.items() if next(r.type for r in rows if r.id == i) == "response")
    texts = [(h or "").encode() for _, _, h in PAGES]
    assert whole == sorted([b for b in texts if len(b) < how.get("min_bytes", 0)] + list({b for b in texts if len(b) >= how.get("min_bytes", 0)}))


def test_files_are_warc(spark):
    """Whole files, read member by member by gzip and split by the lengths that the heads give."""
    path = shared_dir(spark, "warc-test")
    places = {(r.file, r.offset): r for r in warc.write(frame(spark, PAGES), path, chunk_bytes=1000).collect()}
    seen = 0
    for file in Path(path.removeprefix("file://")).glob("*.warc.gz"):
        raw, data = file.read_bytes(), gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            body, data = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert head.startswith(b"WARC/1.1\r\n") and data.startswith(b"\r\n\r\n")
            data = data[4:]
            if fields["WARC-Type"] == "response":
                payload = body.partition(b"\r\n\r\n")[2]
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            elif fields["WARC-Type"] == "revisit":
                assert body.endswith(b"\r\n\r\n") and fields["WARC-Profile"] == warc.REVISIT and fields["WARC-Refers-To"] != fields["WARC-Record-ID"]
            seen += fields["WARC-Type"] != "warcinfo"
        for (name, at), r in places.items():
            if name == file.name:
                member = gzip.decompress(raw[at : at + r.length])
                assert member.startswith(b"WARC/1.1") and f"<urn:uuid:{r.id}>".encode() in member
    assert seen == len(PAGES) == len(places)


def test_damaged_archive(spark):
    path = shared_dir(spark, "warc-test")
    warc.write(frame(spark, PAGES[:8]).coalesce(1), path, level=0)
    for file in Path(path.removeprefix("file://")).glob("*.warc.gz"):
        raw = bytearray(file.read_bytes())
        raw[len(raw) // 2] ^= 255
        file.write_bytes(raw)
    with pytest.raises(Exception, match=r"part-\d+.*warc.gz"):
        warc.read(spark, path).collect()
    with pytest.raises(ValueError, match="min_bytes"):
        warc.write(frame(spark, PAGES), path, min_bytes=10, chunk_bytes=5)


def test_empty_table(spark):
    path = shared_dir(spark, "warc-test")
    assert warc.write(frame(spark, []), path).count() == 0
    assert warc.read(spark, path).count() == 0 and warc.payloads(warc.read(spark, path)).count() == 0


def test_lost_attempts_leave_no_rows(spark):
    path = shared_dir(spark, "warc-test")
    warc.write(frame(spark, PAGES), path)
    (Path(path.removeprefix("file://")) / "part-000000-99999-0000.warc.gz").write_bytes(b"half a file of a lost task")
    assert found(warc.payloads(warc.read(spark, path))) == wanted(PAGES)


def test_streams_in_small_pieces():
    r = random.Random(1)
    data = b"".join(gzip.compress(bytes(r.choices(b"ab", k=n))) for n in (0, 1, 65536, 65537, 300000)) + gzip.compress(b"z" * 5_000_000)
    cut = [data[k : k + 1000] for k in range(0, len(data), 1000)]
    out = list(warc.inflated(cut))
    assert b"".join(out) == gzip.decompress(data) and max(map(len, out)) <= warc.BLOCK


def test_whole_table_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(repr(list(r)) for r in op12_warc_archives(spark, sf).collect()) == wanted(rows)

"""WARC archives through a chunked record table.

A record is rows (record_id, chunk_no, chunk, last) of at most CHUNK bytes each, in order inside a partition.
Digests run along the rows of a record (upto, sha1), so neither the writer nor the reader holds a whole
record. Both work on files by way of pyarrow.fs, so the archives' folder may be any store that it knows and
that driver and executors share.

Writing: one pass over the chunks takes the digests; small rows settle which record of equal payloads is the
response and which revisit it; then chunks and heads meet in one shuffle by record, and each task streams its
records into files, every record a gzip member of its own. Only files that a finished task returned are in
the index, so attempts that were lost or run twice leave no trace in it.

Reading: the index is cut into parts of about PART compressed bytes, each a task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelia.llm.common import written

CHUNK, BLOCK, PART, FILE = 1 << 20, 1 << 16, 64 << 20, 1 << 30
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20
HEAD_LIMIT = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def chunked(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK) -> DataFrame:
    """(record_id, page_id, uri, chunk_no, chunk, last): the payload of every row in UTF-8, cut into chunks.

    A null payload is empty; an empty one has one chunk without bytes. record_id is a hash of id, address and
    payload, so it is the same however often a lost executor's rows are made again; rows that agree in all
    three share it. Other columns are not read. An empty table gives no rows.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    shown = lambda c: F.coalesce(F.md5(F.col(c).cast("string")), F.lit("null"))
    rows = pages.select(F.md5(F.concat_ws(" ", shown(id_col), shown(uri_col), F.md5(payload))).alias("record_id"), F.col(id_col).alias("page_id"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    most = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    piece = lambda k: F.struct(k.cast("bigint").alias("chunk_no"), F.substring(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"), (k == most - 1).alias("last"))
    made = rows.select("record_id", "page_id", "uri", F.transform(F.sequence(F.lit(0), most - 1), piece).alias("pieces"))
    return made.select("record_id", "page_id", "uri", F.explode("pieces").alias("piece")).select("record_id", "page_id", "uri", "piece.*")


def digested(chunks: DataFrame) -> DataFrame:
    """(record_id, page_id, uri, n_bytes, sha1) of chunks whose records lie together and in order; sha1 in base32."""
    key = chunks.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto, sha = 0, hashlib.sha1()
        for batch in batches:
            pieces, ends, at, sizes, sums = batch.column("chunk"), batch.column("last").to_pylist(), [], [], []
            for k, end in enumerate(ends):
                data = memoryview(pieces[k].as_buffer())
                sha.update(data)
                upto += len(data)
                if end:
                    at.append(k)
                    sizes.append(upto)
                    sums.append(base64.b32encode(sha.digest()).decode())
                    upto, sha = 0, hashlib.sha1()
            head = batch.select(["record_id", "page_id", "uri"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=[*head.schema.names, "n_bytes", "sha1"])

    return chunks.mapInArrow(run, f"record_id string, page_id {key}, uri string, n_bytes bigint, sha1 string")


def settled(heads: DataFrame, min_bytes: int) -> DataFrame:
    """heads (record_id, page_id, uri, n_bytes, sha1) with copy, id and refers_to.

    copy numbers rows of one record_id, id is the UUID that copy has. refers_to is the id of the response for a
    revisit, else null: of equal payloads of min_bytes or more, the response is that with the largest page_id
    (null least, then by record_id; of the copies of one record the first). Groups are counted with a map-side combine and
    joined back, so a payload of a third of all pages is split by the adaptive join.
    """
    numbered = heads.withColumn("copy", F.row_number().over(W.partitionBy("record_id").orderBy("n_bytes")) - 1)
    top = heads.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.max(F.struct("page_id", "record_id"))["record_id"].alias("top"))
    joined = numbered.join(top, ["sha1", "n_bytes"], "left")
    own = F.when(F.col("copy") == 0, F.col("record_id")).otherwise(F.md5(F.concat_ws("-", "record_id", "copy")))
    refers = F.when(F.col("top").isNotNull() & ((F.col("top") != F.col("record_id")) | (F.col("copy") > 0)), uuid(F.col("top")))
    return joined.select("record_id", "page_id", "uri", "n_bytes", "sha1", F.col("copy").cast("int").alias("copy"), uuid(own).alias("id"), refers.alias("refers_to"))


def uuid(hex_):
    return F.concat_ws("-", *[F.substring(hex_, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


INDEX = "file string, offset bigint, length bigint, id string, type string, page_id string"


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK, file_bytes: int = FILE, level: int = 3) -> DataFrame:
    """Write a response or revisit record for every row of pages under ``path`` and return the index of the archives.

    Payloads of less than min_bytes (which may not exceed chunk_bytes) never become revisits. Rows are told apart
    even where they are equal. A null address is that of the record; control characters and blanks in an address
    are percent-encoded. Row order does not matter; an empty table gives no archive and an empty index. The index,
    (file, offset, length, id, type, page_id) with a row for each record, is kept in ``path``/index.
    """
    if min_bytes > chunk_bytes:
        raise ValueError("min_bytes must not exceed chunk_bytes")
    spark = pages.sparkSession
    chunks = chunked(pages, id_col, uri_col, payload_col, chunk_bytes)
    heads = settled(written(digested(chunks), "record-heads"), min_bytes)
    bare = lambda name, kind: F.lit(None).cast(kind).alias(name)
    head_rows = heads.select("record_id", F.lit(-1).cast("bigint").alias("chunk_no"), bare("chunk", "binary"), "copy", "id", "refers_to", F.col("page_id").cast("string").alias("page_id"), "uri", "n_bytes", "sha1")
    chunk_rows = chunks.select("record_id", "chunk_no", "chunk", bare("copy", "int"), bare("id", "string"), bare("refers_to", "string"), bare("page_id", "string"), bare("uri", "string"), bare("n_bytes", "bigint"), bare("sha1", "string"))
    rows = head_rows.union(chunk_rows).repartition("record_id").sortWithinPartitions("record_id", "chunk_no", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archive(path, date, file_bytes, level)
        at, many, waiting, next_no = None, [], None, 0
        for batch in batches:
            names = [n for n in batch.schema.names if n != "chunk"]
            pieces = batch.column("chunk")
            for k, r in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                head = dict(zip(names, r, strict=True))
                if head["record_id"] != at:
                    at, many, waiting, next_no = head["record_id"], [], None, 0
                if head["chunk_no"] < 0:
                    if head["refers_to"] is not None:
                        out.revisit(head)
                    elif waiting is None:
                        waiting = head
                    else:
                        many.append(head)
                elif waiting is not None and head["chunk_no"] == next_no:  # the chunks of equal rows come once for each of them
                    data = memoryview(pieces[k].as_buffer())
                    if next_no == 0:
                        for other in many:  # of less than min_bytes, so of one chunk
                            out.begin(other)
                            out.add(data)
                            out.end()
                        out.begin(waiting)
                    out.add(data)
                    next_no += 1
                    if out.left == 0:
                        out.end()
                        waiting = None
            yield out.index()
        out.close()
        yield out.index()

    rows.mapInArrow(run, INDEX).write.parquet(f"{path.rstrip('/')}/index")
    return index(spark, path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")


class Archive:
    """Files of one task, each opened with its first record."""

    def __init__(self, path: str, date: str, file_bytes: int, level: int):
        self.store, self.folder = FileSystem.from_uri(path)
        context = TaskContext.get()
        self.stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.date, self.most, self.level = date, file_bytes, level
        self.out, self.name, self.n, self.size, self.left, self.rows = None, "", 0, 0, 0, []

    def open(self) -> None:
        if self.out is not None and self.size >= self.most:
            self.close()
        if self.out is None:
            self.name, self.size = f"{self.stem}-{self.n:04d}.warc.gz", 0
            self.n += 1
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)  # the members are compressed here
            info = b"format: WARC File Format 1.1" + CRLF
            made = hashlib.md5(self.name.encode()).hexdigest()
            self.member()
            self.put(self.head("warcinfo", f"{made[:8]}-{made[8:12]}-{made[12:16]}-{made[16:20]}-{made[20:]}", {"Content-Type": "application/warc-fields"}, len(info)) + info)
            self.finish()

    def head(self, kind: str, id_: str, fields: dict, length: int) -> bytes:
        lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{id_}>", "WARC-Date": self.date} | fields | {"Content-Length": length}
        return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + CRLF for k, v in lines.items() if v is not None) + CRLF

    def member(self) -> None:
        self.gz, self.began = zlib.compressobj(self.level, zlib.DEFLATED, 31), self.size

    def put(self, data) -> None:
        self.write(self.gz.compress(data))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def finish(self) -> None:
        self.put(CRLF + CRLF)
        self.write(self.gz.flush())

    def fields(self, head: dict) -> tuple[dict, bytes]:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {head['n_bytes']}\r\n\r\n".encode()
        uri = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", head["uri"] or "") or f"urn:uuid:{head['id']}"
        return {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{head['sha1']}", "Page-Id": head["page_id"]}, http

    def start(self, head: dict, kind: str, fields: dict, http: bytes, length: int) -> None:
        self.open()
        self.member()
        self.now = (head["id"], kind, head["page_id"])
        self.put(self.head(kind, head["id"], fields, length) + http)

    def begin(self, head: dict) -> None:
        fields, http = self.fields(head)
        self.left = head["n_bytes"]
        self.start(head, "response", fields | {"Content-Type": "application/http;msgtype=response"}, http, len(http) + self.left)

    def add(self, data) -> None:
        self.left -= len(data)
        self.put(data)

    def end(self) -> None:
        self.finish()
        self.rows.append((self.name, self.began, self.size - self.began, *self.now))

    def revisit(self, head: dict) -> None:
        fields, http = self.fields(head)
        more = {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{head['refers_to']}>", "Content-Type": "application/http;msgtype=response"}
        self.start(head, "revisit", fields | more, http, len(http))
        self.end()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def index(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in INDEX.split(", ")])


RECORDS = "id string, type string, page_id string, uri string, refers_to string, chunk_no bigint, chunk binary, last boolean, upto bigint, sha1 string, intact boolean"


def read(spark: SparkSession, path: str, payload: bool = True, part_bytes: int = PART, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives under ``path``: see RECORDS.

    upto counts a record's payload bytes so far; sha1 (base32) and intact (the digest in the head is that of the
    bytes read; null without one) are set where last is true. A record without payload has one row with an empty
    chunk. Without ``payload`` the chunks are read and digested, but only each record's last row is returned,
    its chunk null. A record that breaks off or isn't WARC raises an error that names the file.
    """
    parts = index(spark, path).groupBy("file", F.floor(F.col("offset") / part_bytes).alias("part")).agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"))
    parts = written(parts.select("file", "begin", "end"), "archive-parts")
    folder = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, begin, end in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "end")), strict=True):
                yield from batched(records(f"{folder}/{name}", begin, end, chunk_bytes), payload)

    return parts.repartition(max(1, parts.count())).mapInArrow(run, RECORDS)


def batched(rows: Iterable[tuple], payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in RECORDS.split(", ")])

    for r in rows:
        if not payload:
            if not r[7]:
                continue
            r = (*r[:6], None, *r[7:])
        held.append(r)
        size += len(r[6] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def blocks(uri: str, begin: int, end: int) -> Iterator[bytes]:
    store, path = FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        source.seek(begin)
        while begin < end:
            data = source.read(min(BLOCK, end - begin))
            if not data:
                return
            begin += len(data)
            yield data


def inflated(source: Iterable[bytes]) -> Iterator[bytes]:
    """Blocks of a plain file as they are, of gzip members decoded, BLOCK bytes at most at a time."""
    member, zipped = None, None
    for data in source:
        if zipped is None:
            zipped = data.startswith(b"\x1f\x8b")
        if not zipped:
            yield data
            continue
        while data:
            member = member or zlib.decompressobj(31)
            out = member.decompress(data, BLOCK)
            yield out
            while len(out) == BLOCK and not member.eof and not member.unconsumed_tail:  # more is ready without more input
                out = member.decompress(b"", BLOCK)
                yield out
            data, member = (member.unused_data, None) if member.eof else (member.unconsumed_tail, member)


class Stream:
    """Lines and bounded pieces of a sequence of blocks."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.held = source, b""

    def more(self) -> bool:
        for data in self.source:
            if data:
                self.held += data
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to mark, which is skipped; None at the end of the source."""
        at = self.held.find(mark)
        while at < 0:
            if len(self.held) > HEAD_LIMIT:
                raise ValueError("a head is longer than its limit")
            if not self.more():
                if self.held.strip():
                    raise ValueError("a head breaks off")
                return None
            at = self.held.find(mark)
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """n bytes."""
        held = [self.held[:n]]
        self.held, n = self.held[n:], n - len(held[0])
        while n:
            if not self.more():
                raise ValueError("a record breaks off")
            held.append(self.held[:n])
            self.held, n = self.held[n:], n - len(held[-1])
        return b"".join(held)


def records(uri: str, begin: int, end: int, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of RECORDS for the records between two offsets of an archive; a record of no page has none."""
    stream = Stream(inflated(blocks(uri, begin, end)))
    try:
        while (head := stream.until(CRLF + CRLF)) is not None:
            version, *lines = head.lstrip(CRLF).decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("a record doesn't begin with WARC/")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            left = int(fields["content-length"])
            kind, bare = fields["warc-type"], lambda v: v and v.removeprefix("<urn:uuid:").removesuffix(">")
            if fields.get("content-type", "").startswith("application/http"):
                http = stream.until(CRLF + CRLF)
                if http is None:
                    raise ValueError("a record breaks off")
                left -= len(http) + 4
            about = (bare(fields["warc-record-id"]), kind, fields.get("page-id"), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")))
            said, sha, upto, k = fields.get("warc-payload-digest"), hashlib.sha1(), 0, 0
            while True:
                chunk = stream.take(min(chunk_bytes, left))
                left -= len(chunk)
                upto += len(chunk)
                sha.update(chunk)
                if kind != "warcinfo":
                    sum_ = base64.b32encode(sha.digest()).decode() if left == 0 else None
                    whole = None if sum_ is None or said is None or kind == "revisit" else said == f"sha1:{sum_}"
                    yield (*about, k, chunk, left == 0, upto, sum_, whole)
                k += 1
                if left == 0:
                    break
            if stream.take(4) != CRLF + CRLF:
                raise ValueError("a record has another length than it says")
    except (ValueError, KeyError, zlib.error) as e:
        raise ValueError(f"{uri}: {e}") from e


def payloads(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row a record, of rows that read() returns.

    A revisit has the size and digest of the response that it refers to, as read there, and that response's
    page_id in refers_to; both are null where the response isn't among the rows. page_id is a string, null if
    the record has none.
    """
    small = written(found.where("last").select("id", "type", "page_id", "refers_to", "upto", "sha1"), "records")
    own = small.where("type <> 'revisit'").select("page_id", F.col("upto").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    targets = small.where("type <> 'revisit'").select(F.col("id").alias("refers_to"), F.col("page_id").alias("response"), "upto", "sha1")
    again = small.where("type = 'revisit'").select("page_id", "refers_to").join(targets, "refers_to", "left")
    return own.union(again.select("page_id", "upto", "sha1", F.lit("revisit"), "response"))

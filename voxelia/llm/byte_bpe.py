"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Inside Arrow batches every text is cut at safe boundaries, encoded piece by piece, and decoded again
to raw bytes. Rows are independent: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Between a letter or digit and one space that a letter or digit follows, no match of the pre-splitting
#: pattern goes on: white space is only taken at the front of a match.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])")
#: The pattern under which a text is one match.
WHOLE = r"(?s:.+)"
#: A long run of white space is one match of the pattern, but for its last character where something follows.
#: The library's regex engine backtracks through such a run and runs out of stack at about a million characters.
BLANKS = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}+")


@lru_cache(maxsize=4)
def encoder(rank_path: str, pattern: str):
    import tiktoken

    ranks = {}
    with open(rank_path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, longest: int) -> Iterator[tuple[str, bool]]:
    """(piece, is it one match of the pattern): text cut around long white space, and else at safe boundaries,
    each piece the shortest possible of at least longest characters."""
    at = 0
    if len(text) > longest:
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            yield from ((p, False) for p in between(text[at : run.start()], longest))
            yield text[run.start() : end], True
            at = end
    yield from ((p, False) for p in between(text[at:] if at else text, longest))


def between(text: str, longest: int) -> Iterator[str]:
    at = 0
    while len(text) - at > longest:
        cut = SAFE.search(text, at + longest)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 50_000) -> DataFrame:
    """(id_col, ids array<int>, decoded binary): one row per input row.

    A null text counts as empty: no ids, no bytes. Very long texts are cut at safe boundaries, which
    never changes the ids; a long run of white space is encoded as the one match that it is. Repeated rows and null ids are kept as they are; other columns are dropped,
    so clashing names do no harm; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, whole = encoder(rank_path, pattern), encoder(rank_path, WHOLE)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, raw = [], []
                for text in part.column(1):
                    own: list[int] = []
                    for piece, one in pieces(text.as_py() or "", longest):
                        own += (whole if one else enc).encode_ordinary(piece)
                    ids.append(pa.array(own, pa.int32()))
                    raw.append(enc.decode_bytes(own))
                offsets = pa.array([0, *map(len, ids)], pa.int64())
                lists = pa.ListArray.from_arrays(pa.compute.cumulative_sum(offsets).cast(pa.int32()), pa.concat_arrays(ids or [pa.array([], pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(raw, pa.binary())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of encode()'s rows, in the JVM."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

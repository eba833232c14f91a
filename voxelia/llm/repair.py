"""Token-ID files: Re-Pair grammar compression per shard, with random-access decoding.

Documents are range-partitioned by id. Inside a partition they are encoded in order and cut into blocks
of about ``block_tokens`` ids; each block is compressed on its own: frequent neighbouring id pairs become
nonterminals, again and again. A block is one row of a Parquet data set with the columns

    shard, block      place of the block; blocks in (shard, block) order hold ascending document ids
    doc_ids, lengths  the documents of the block and their numbers of ids, end id included
    base              the first nonterminal
    rules             little-endian pairs (left, right); rule r stands for the nonterminal base + r
    spans             expansion length of every rule
    body              little-endian symbols of the compressed block
    wide              whether rules and body take 4 bytes a symbol, else 2

spans and body give the offset of any id without expanding what lies before it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH_BITS = 18


def compress(ids: np.ndarray, base: int, min_count: int = 24, per_round: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(rules of shape (r, 2), body). Every round replaces the most frequent pairs, about per_round of them, until
    no pair occurs min_count times.

    A round that looked at every pair of min_count leaves none of them: an occurrence that isn't replaced itself
    has lost a symbol to its neighbour. So later rounds count only the pairs that hold a symbol made ``since``.
    """
    rules: list[np.ndarray] = []
    body, following, since = ids.astype(np.uint32), base, 0
    while len(body) >= 2:
        fresh = np.flatnonzero((body[:-1] >= since) | (body[1:] >= since)) if since else np.arange(len(body) - 1)
        left, right = body[fresh], body[fresh + 1]
        slot = ((left * np.uint32(2654435761)) ^ (right * np.uint32(2246822519))) >> np.uint32(32 - HASH_BITS)
        tally = np.bincount(slot, minlength=1 << HASH_BITS)
        least = max(min_count, int(np.partition(tally, -per_round)[-per_round]))
        bits, kind = (16, np.uint32) if following <= 1 << 16 else (32, np.uint64)  # narrow codes sort faster
        codes = left.astype(kind) << kind(bits) | right.astype(kind)
        while True:
            often = tally[slot] >= least
            pairs, which, counts = np.unique(codes[often], return_inverse=True, return_counts=True)
            good = counts >= min_count
            if good.any() or least == min_count:
                break
            least = min_count  # those pairs only shared a slot
        if not good.any():
            break
        at, number = fresh[often], np.where(good, np.cumsum(good) - 1, -1)
        at, which = at[good[which]], number[which[good[which]]]
        # of pairs that overlap in a run of neighbours, every second one is replaced
        starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        at, which = at[rank % 2 == 0], which[rank % 2 == 0]
        pairs = pairs[good]
        rules.append(np.stack([pairs >> kind(bits), pairs & kind((1 << bits) - 1)], 1).astype(np.uint32))
        body[at] = following + which
        keep = np.ones(len(body), bool)
        keep[at + 1] = False
        since = following if least == min_count else since
        body, following = body[keep], following + len(pairs)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), body


def spans_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of every rule; a rule only names earlier ones."""
    spans = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):  # rules of a round name earlier rounds only, so few steps do
        ready = (rules[done:].astype(np.int64) - base).max(1)
        end = done + (int(np.argmax(ready >= done)) if (ready >= done).any() else len(ready))
        part = rules[done:end].astype(np.int64)
        spans[done:end] = np.where(part >= base, spans[np.maximum(part - base, 0)], 1).sum(1)
        done = end
    return spans


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, spans: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for. Every symbol is put where its expansion begins; then each nonterminal gives
    way to its two parts, so the work is that of the ids, however deep the rules are."""
    width = np.ones(base + len(rules), np.int64)
    width[base:] = spans
    size = width[symbols]
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int32)
    out[place] = symbols
    high = symbols >= base
    at, now = place[high], symbols[high]
    while len(now):
        left, right = rules[now.astype(np.int64) - base].T
        second = at + width[left]
        out[at], out[second] = left, right
        at, now = np.concatenate([at[left >= base], second[right >= base]]), np.concatenate([left[left >= base], right[right >= base]])
    return out


def slice_ids(body: np.ndarray, rules: np.ndarray, spans: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a block, expanding only the symbols that reach into them."""
    size = np.where(body >= base, spans[np.maximum(body.astype(np.int64) - base, 0)] if len(spans) else 1, 1)
    ends = np.cumsum(size)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    ids = expand(body[first : last + 1], rules, base, spans)
    skip = start - (int(ends[first - 1]) if first else 0)
    return ids[skip : skip + stop - start]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters below U+0250 that lower-casing and normal form C keep one to one.
HEAD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte, by their published rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}


class ChunkEncoder:
    """Encodes texts chunk by chunk between spaces and line feeds, each different chunk once.

    The tokenizer drops white space and no token reaches over it, so the ids of a text are those of its
    chunks. A chunk's leading run of Latin letters is one pre-token and goes straight to the tokenizer's
    model, in lower case; what follows it, and any other chunk, is encoded by the whole tokenizer. What is
    remembered is dropped at ``most`` chunks to bound memory.
    """

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.most, self.letters = tokenizer(path), most, byte_letters()
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.comma,) = self.plain.encode(",").ids
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.parts: dict[str, bytes] = {"": b""}  # ids as 4-byte integers: bytes cost the garbage collector nothing
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int32)

    def model(self, heads: list[str]) -> None:
        """Ids of words by the model alone, many words in one call."""
        for at in range(0, len(heads), 4096):
            part = heads[at : at + 4096]
            shown = [h if h.isascii() else "".join(map(self.letters.__getitem__, h.encode())) for h in part]
            ids = np.array(self.plain.encode_batch_fast([" , ".join(shown) + " ,"], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(ids == self.comma)  # no word of letters holds it
            raw, begin = ids.tobytes(), 0
            for h, end in zip(part, (stops * 4).tolist(), strict=True):
                self.parts[h] = raw[begin:end]
                begin = end + 4

    def whole(self, texts: list[str]) -> None:
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            self.parts.update(zip(part, (array("i", e.ids).tobytes() for e in self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def learn(self, fresh: list[str]) -> None:
        parts, heads, tails = self.parts, [], []
        for c in fresh:
            m = HEAD.match(c)
            end = m.end() if m else 0
            if end < len(c) and not c[end].isascii():  # a combining mark may follow
                end = 0
            head, tail = c[:end].lower(), c[end:]
            heads.append(head)
            tails.append(tail)
        self.model(sorted(set(heads).difference(parts)))
        self.whole(sorted(set(tails).difference(parts)))
        got = [parts[h] + parts[t] for h, t in zip(heads, tails, strict=True)]
        sizes = np.fromiter(map(len, got), np.int32, len(got)) // 4
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(got), np.int32)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text). Null texts have none."""
        if len(self.index) > self.most:
            self.reset()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        known, chunks = self.index, coded.dictionary.to_pylist()
        fresh = [c for c in chunks if c not in known]
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        if fresh:
            self.learn(fresh)
        which = np.fromiter(map(known.__getitem__, chunks), np.int32, len(chunks))[coded.indices.to_numpy()]
        size = np.diff(self.offsets)[which]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
        source = np.repeat(self.offsets[which] - ends[:-1], size) + np.arange(ends[-1], dtype=np.int32)
        upto = ends[np.cumsum(pc.list_value_length(lists).to_numpy())]
        return self.flat[source], np.diff(upto, prepend=0)


@lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker process, so common chunks are encoded once."""
    return ChunkEncoder(path)


SCHEMA = "shard int, block int, doc_ids array<bigint>, lengths array<bigint>, base int, rules binary, spans array<bigint>, body binary, wide boolean"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20) -> None:
    """Encode every text, append end_id, and write the blocks to ``path`` in ascending id order.

    Null texts count as empty and give the end id alone; null ids come first; rows of one id are ordered
    by their text. An empty table gives a data set without rows. Very long texts make a block of their
    own. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block = chunk_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        base = encode.tok.get_vocab_size()
        held: list[tuple] = []

        def pack() -> pa.RecordBatch:
            nonlocal block
            ids = np.concatenate([h[2] for h in held])
            rules, body = compress(ids, base)
            wide = base + len(rules) > 65536
            kind = "<u4" if wide else "<u2"
            row = {"shard": shard, "block": block, "doc_ids": [d for h in held for d in h[0]], "lengths": np.concatenate([h[1] for h in held]), "base": base, "rules": rules.astype(kind).tobytes(), "spans": spans_of(rules, base), "body": body.astype(kind).tobytes(), "wide": wide}
            block += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in KINDS.items()], names=list(KINDS))

        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids, lengths = encode(part.column(1))
                ends = np.cumsum(lengths)
                with_end = np.insert(ids, ends, end_id)
                held.append((part.column(0).to_pylist(), lengths + 1, with_end))
                size += len(with_end)
                if size >= block_tokens:
                    yield pack()
                    size = 0
        if held:
            yield pack()

    (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, SCHEMA).write.parquet(path))


KINDS = {"shard": pa.int32(), "block": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "base": pa.int32(), "rules": pa.binary(), "spans": pa.list_(pa.int64()), "body": pa.binary(), "wide": pa.bool_()}


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_le): start counts the ids of all documents before this one; ids_le holds
    the ids as little-endian unsigned 32-bit integers. Starts come from sums of the lengths by shard, so no
    task sees more than one number a shard."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    starts = sizes.join(shards, sizes.shard == shards.s).select(
        F.col("shard").alias("s"), F.col("block").alias("b"),
        (F.col("shard_start") + F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("start"),
    )
    ready = blocks.join(starts, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).select("start", "doc_ids", "lengths", "base", "rules", "spans", "body", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = "<u4" if r["wide"] else "<u2"
                rules = np.frombuffer(r["rules"], kind).reshape(-1, 2).astype(np.int32)
                ids = expand(np.frombuffer(r["body"], kind), rules, r["base"], np.array(r["spans"], np.int64)).astype("<u4")
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - lengths), pa.array(lengths), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_le"])

    return ready.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_le binary")

"""Language-model scores from an Elias-Fano n-gram trie.

Spark counts n-grams level by level. The first level holds a 63-bit hash of every training word with its
exact count; level k holds (entry of level k-1, word) for n-grams that occur at least ``least`` times, with
quantised smoothed probabilities. An n-gram can only reach ``least`` if its shorter ones do, so each pass
counts what extends an entry of the level below. Levels are files in the shared folder, cut into ranges of
(context, word) and memory-mapped by the tasks that read them.

The counts of one level tell how many n-grams of the next can begin with each entry, so its ranges are known
before anything is counted: every task sends its sorted counts to their ranges as packed columns, in one
shuffle, and a range's task adds them up and writes the shard. A context of more n-grams than a range should
hold is split by its words.

Smoothing is absolute discounting, interpolated: p(w | h) = f(w | h) + b(h) p(w | shorter h), with
f = (c - D) / c(h) for kept n-grams and b(h) = 1 - sum of f, so that probabilities of known words and the
unknown class add up to one, but for quantisation. The unigram is the base score's.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelia.llm.common import remove, shared_dir
from voxelia.llm.elias_fano import Level, write_shard

END = b"\n"  # no word holds white space
DISCOUNT = 0.75
STEPS = 65535  # of 16-bit codes over log10 values from -8 to 0
SHARD_ENTRIES = 1_000_000
RANGE_TOKENS = 2_000_000


def encoded(p: np.ndarray) -> np.ndarray:
    return np.round(np.clip(np.log10(np.maximum(p, 1e-8)) / 8 + 1, 0, 1) * (STEPS - 1) + 1).astype(np.uint16)


#: The value of each code; 0 stands for none.
VALUES = np.where(np.arange(STEPS + 1) > 0, 10.0 ** ((np.maximum(np.arange(STEPS + 1), 1) - 1) / (STEPS - 1) * 8 - 8), 0.0)


def decoded(code: np.ndarray, none: float = 0.0) -> np.ndarray:
    return np.append(none, VALUES[1:])[code]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@dataclass
class Model:
    """Levels as (manifest, shares left over by contexts in several shards), training tokens and distinct ones."""

    levels: list[tuple[tuple, tuple]]
    tokens: int
    distinct: int


def local_path(uri: str) -> str:
    """The path of the shared folder; it must be mounted on all machines, as memory maps need files."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for memory-mapped models, not {uri}")
    return parts.path


@lru_cache(maxsize=16)
def level(made: tuple[tuple, tuple]) -> Level:
    return Level(list(made[0]), dict(made[1]))


def runs(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of rows, in runs of about most bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=-1))
    for i, j in itertools.pairwise([*starts.tolist(), len(size)]):
        yield tuple(batch.column(c).slice(i, j - i) for c in range(2))


def flat_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token, hash of each number's word, tokens of each text): words and one end. Arrow's ascii functions keep to ASCII."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, pieces = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(flat), 0)  # white space at the ends of a text leaves empty pieces
    coded = flat.filter(some).dictionary_encode()
    sizes = np.bincount(np.repeat(np.arange(len(texts)), pieces)[some.to_numpy(zero_copy_only=False)], minlength=len(texts)) + 1
    ends = np.cumsum(sizes) - 1
    word = np.ones(int(sizes.sum()), bool)
    word[ends] = False
    number = np.full(len(word), len(coded.dictionary), np.int64)
    number[word] = coded.indices.to_numpy()
    seen = [*coded.dictionary.cast(pa.large_binary()).to_pylist(), END]
    hashes = (np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen)) >> np.uint64(1)).astype(np.int64)
    return number, hashes, sizes


def ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in an order by (first, second), all non-negative, and where in it each different pair begins.

    One number holds a pair and its place where 63 bits do, as numbers are sorted faster than places.
    """
    high, low, at = (int(n).bit_length() for n in (first.max(initial=0), second.max(initial=0), len(first)))
    if high + low + at < 64:
        key = first << (low + at)  # changed in place, as several arrays of a range's n-grams would count
        key |= second << at
        key |= np.arange(len(first))
        key.sort()
        order = key & ((1 << at) - 1)
        key >>= at
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        return order, np.flatnonzero(new)
    order = np.argsort(first << low | second) if high + low < 64 else np.lexsort((second, first))
    return order, np.flatnonzero((np.diff(first[order], prepend=-1) != 0) | (np.diff(second[order], prepend=-1) != 0))


@dataclass
class Ranks:
    """What stands at each token: of[i] is its rank among the different things of a run, -1 for none, and
    values[r] the entry of rank r in a level or -1. Entries rise with their ranks, so ranks, which are small, are sorted instead."""

    of: np.ndarray
    values: np.ndarray

    def entries(self) -> np.ndarray:
        return np.append(self.values, -1)[self.of]

    def before(self, sizes: np.ndarray, first: bool) -> Ranks:
        """What stands at the token before; only of the first level does a text's first token have one, the end."""
        return Ranks(shifted(self.of, sizes, None if first else -1), self.values)


def lookup(found: Level, contexts: Ranks, words: Ranks, *columns: str) -> list:
    """Ranks of the pairs of a context and a word, and by rank the columns of Level.find. A token has no rank where either has no value."""
    some = np.flatnonzero((contexts.entries() >= 0) & (np.append(words.values, -1)[words.of] >= 0))
    c, w = contexts.of[some], words.of[some]
    order, new = ordered(c, w)
    of, at = np.full(len(contexts.of), -1, np.int64), order[new]
    of[some[order]] = np.repeat(np.arange(len(new)), np.diff(new, append=len(order)))
    entry, *got = found.find(contexts.values[c[at]], words.values[w[at]], *columns)
    return [Ranks(of, entry), *got]


def shifted(x: np.ndarray, sizes: np.ndarray, fill: int | None) -> np.ndarray:
    """x moved on by one; the first place of each text gets fill, or x of the text's last place."""
    out = np.roll(x, 1)
    ends = np.cumsum(sizes)
    out[ends - sizes] = x[ends - 1] if fill is None else fill
    return out


def chain(model: Model, texts: pa.Array, top: int) -> tuple[list[Ranks], np.ndarray, np.ndarray]:
    """What of the levels 1 to top ends at each token, the count of each rank of the first, and tokens of each text.
    The context of a text's first token is the end token."""
    number, hashes, sizes = flat_numbers(texts)
    order = np.argsort(hashes)
    entry, count = level(model.levels[0]).find(np.zeros(len(hashes), np.int64), hashes[order], "count")
    last = np.argsort(entry >= 0, kind="stable")  # words without an entry come first, so that what is asked about them does too
    rank = np.empty(len(hashes), np.int64)
    rank[order[last]] = np.arange(len(hashes))
    made = [Ranks(rank[number], entry[last])]
    words = Ranks(made[0].of, np.where(made[0].values >= 0, made[0].values + 1, -1))
    for k in range(1, top):
        made.append(lookup(level(model.levels[k]), made[-1].before(sizes, k == 1), words)[0])
    return made, count[last], sizes


def smallest(x: np.ndarray) -> np.ndarray:
    """Non-negative x in the narrowest type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def ranges_of(counts: np.ndarray, distinct: int, most: int) -> tuple[list[int], list[int]]:
    """Starts (entry, word) of ranges for the n-grams that begin with the entries of one shard."""
    before = (np.cumsum(counts) - counts) // most
    pieces = -(-counts // most)
    hot = pieces > 1
    new = np.diff(before, prepend=-1) > 0
    new |= hot
    new[1:] |= hot[:-1]
    at = np.flatnonzero(new)
    many = np.maximum(pieces[at], 1)
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(at, many).tolist(), (step * -(-(distinct + 1) // np.repeat(many, many))).tolist()


def first_level(words: DataFrame, folder: str, distinct: int, most: int) -> tuple[tuple, list[tuple[int, int]]]:
    """Write (word, n) as the first level, range-partitioned by word: the level and the ranges of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            word, n = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(2))
            path = os.path.join(folder, f"level1-{TaskContext.get().partitionId():06d}.ef")
            write_shard(path, np.zeros(len(word), np.int64), word, count=smallest(n))
            at, step = ranges_of(n, distinct, most)
            yield pa.RecordBatch.from_pydict({"path": [path], "ctx": [0], "word": [int(word[0])], "entries": [len(word)], "at": [at], "step": [step]})

    pieces = max(1, -(-distinct // SHARD_ENTRIES))
    made = words.repartitionByRange(pieces, "word").sortWithinPartitions("word").mapInArrow(run, "path string, ctx long, word long, entries long, at array<long>, step array<long>")
    rows = sorted(made.collect(), key=lambda r: r.word)  # one short row a shard
    return (tuple(tuple(r)[:4] for r in rows), ()), ranges_over(rows)


def ranges_over(rows: list) -> list[tuple[int, int]]:
    """Starts of the next level's ranges, from those within each shard; the shards in order."""
    offsets = itertools.accumulate((r.entries for r in rows), initial=0)
    return [(o + a, w) for r, o in zip(rows, offsets) for a, w in zip(r["at"], r["step"], strict=True)]


def range_numbers(starts: tuple[np.ndarray, np.ndarray], ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Number of the range that each (ctx, word), sorted, lies in."""
    left, right = np.searchsorted(starts[0], ctx, "left"), np.searchsorted(starts[0], ctx, "right")
    out = right - 1
    split = np.flatnonzero(right - left > 1)
    firsts = np.flatnonzero(np.diff(ctx[split], prepend=-1))
    for i, j in itertools.pairwise([*firsts.tolist(), len(split)]):
        at, a, b = split[i:j], left[split[i]], right[split[i]]
        out[at] = a + np.searchsorted(starts[1][a:b], word[at], "right") - 1
    return out


def packed(ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted counts as narrow compressed columns."""
    columns = {"ctx": smallest(np.diff(ctx, prepend=ctx[:1])), "word": smallest(word), "n": smallest(n)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(ctx0: int, data: bytes) -> list[np.ndarray]:
    ctx, word, n = (c.to_numpy().astype(np.int64) for c in pa.ipc.open_stream(data).read_next_batch().columns)
    return [ctx0 + np.cumsum(ctx), word, n]


def summed(ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (ctx, word), sorted, with the sum of n."""
    order, new = ordered(ctx - (ctx.min() if len(ctx) else 0), word)
    return ctx[order[new]], word[order[new]], np.add.reduceat(n[order], new) if len(new) else n


def higher_level(blocks: DataFrame, folder: str, below: Model, starts: list[tuple[int, int]], least: int, most: int) -> tuple[tuple, list[tuple[int, int]]]:
    """Add up packed counts (part, ctx0, data) and write the level above those of below: the level and the ranges of the next."""
    k = len(below.levels) + 1
    shared = {c for (c, _), (d, _) in itertools.pairwise(starts) if c == d}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for part, ctx0, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got.setdefault(part, []).append(unpacked(ctx0, data))
        for part, pieces in got.items():
            ctx, word, n = summed(*(np.concatenate(c) for c in zip(*pieces, strict=True)))
            pieces.clear()
            ctx, word, n = (x[n >= least] for x in (ctx, word, n))
            if not len(ctx):
                continue
            first = np.flatnonzero(np.diff(ctx, prepend=-1))
            of = np.maximum(entry_counts(below, k - 1, ctx[first]), 1)
            sizes = np.diff(first, append=len(ctx))
            taken = np.add.reduceat(n - DISCOUNT, first) / of
            path = os.path.join(folder, f"level{k}-{part:06d}.ef")
            write_shard(path, ctx, word, count=smallest(n), code=encoded((n - DISCOUNT) / np.repeat(of, sizes)), rest=encoded(np.maximum(1 - taken, 1e-8)))
            at, step = ranges_of(n, below.distinct, most)
            split = float(taken[0]) if int(ctx[0]) in shared else None  # a range of a split context holds no other
            yield pa.RecordBatch.from_pydict({"path": [path], "ctx": [starts[part][0]], "word": [starts[part][1]], "entries": [len(ctx)], "at": [at], "step": [step],
                                              "taken": pa.array([split], pa.float64())})

    made = blocks.repartitionById(max(1, len(starts)), "part").mapInArrow(run, "path string, ctx long, word long, entries long, at array<long>, step array<long>, taken double")
    rows = sorted(made.collect(), key=lambda r: (r.ctx, r.word))  # one short row a shard
    left: dict[int, float] = {}
    for r in rows:
        if r.taken is not None:
            left[r.ctx] = left.get(r.ctx, 1.0) - r.taken
    return (tuple(tuple(r)[:4] for r in rows), tuple((c, int(encoded(np.array([max(v, 1e-8)]))[0])) for c, v in left.items())), ranges_over(rows)


def train(docs: DataFrame, order: int = 3, least: int = 2, id_col: str = "doc_id", text_col: str = "text", range_tokens: int = RANGE_TOKENS) -> Model:
    """Count and write a model from all given documents. Null texts count as empty: one end token each.
    range_tokens is about how many n-grams a task of the higher levels adds up."""
    spark = docs.sparkSession
    folder = local_path(shared_dir(spark, "ngram-trie"))
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(id_col, text_col)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in runs(batch):
                number, hashes, _ = flat_numbers(texts)
                yield pa.RecordBatch.from_pydict({"word": hashes, "n": np.bincount(number, minlength=len(hashes))})

    path = shared_dir(spark, "ngram-counts")
    texts.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(path)
    words = spark.read.schema("word long, n long").parquet(path)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    made, starts = first_level(words, folder, distinct, range_tokens)
    remove(spark, words)
    model = Model([made], tokens, distinct)
    for k in range(2, order + 1):
        cuts = tuple(np.array([s[i] for s in starts], np.int64) for i in range(2))

        def count_ngrams(batches: Iterator[pa.RecordBatch], model=model, k=k, cuts=cuts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in runs(batch):
                    made, counts, sizes = chain(model, texts, k - 1)
                    below, first = made[-1].before(sizes, k == 2), made[0]
                    # counts of shorter n-grams tell which of these can reach the least count
                    fine = (below.entries() >= 0) & (made[-1].entries() >= 0)
                    if k == 2:
                        often = (counts >= least)[first.of]
                        fine &= often & shifted(often, sizes, None)
                    c, w = below.of[fine], first.of[fine]
                    order, new = ordered(c, w)
                    ctx, word, n = below.values[c[order[new]]], first.values[w[order[new]]] + 1, np.diff(new, append=len(order))
                    part = range_numbers(cuts, ctx, word)
                    at = np.flatnonzero(np.diff(part, prepend=-1))
                    blocks = [packed(*(x[i:j] for x in (ctx, word, n))) for i, j in itertools.pairwise([*at.tolist(), len(part)])]
                    yield pa.RecordBatch.from_pydict({"part": pa.array(part[at], pa.int32()), "ctx0": ctx[at], "data": pa.array(blocks, pa.binary())})

        made, starts = higher_level(texts.mapInArrow(count_ngrams, "part int, ctx0 long, data binary"), folder, model, starts, least, range_tokens)
        model = Model([*model.levels, made], tokens, distinct)
    return model


def entry_counts(model: Model, k: int, entries: np.ndarray) -> np.ndarray:
    """Counts of entries of level k by their index, 0 for -1."""
    found, out = level(model.levels[k - 1]), np.zeros(len(entries), np.int64)
    which = np.searchsorted(found.offsets, entries, "right") - 1
    for s in np.unique(which[entries >= 0]).tolist():
        at = np.flatnonzero((which == s) & (entries >= 0))
        out[at] = found.shard(s).columns["count"][entries[at] - found.offsets[s]]
    return out


def log_scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, known tokens, log10 of the unigram and of the model's probability."""
    made, counts, sizes = chain(model, texts, 1)
    at, words = made[0].of, Ranks(made[0].of, made[0].values + 1)  # no entry has word 0, which asks for the context alone
    starts = np.cumsum(sizes) - sizes
    p = (counts + 0.5) / (model.tokens + 0.5 * (model.distinct + 1))
    base, p = np.add.reduceat(np.log10(p)[at], starts), p[at]
    below = made[0]
    for k in range(1, len(model.levels)):
        below, code, rest = lookup(level(model.levels[k]), below.before(sizes, k == 1), words, "code", "rest")
        p = np.append(decoded(code), 0.0)[below.of] + np.append(decoded(rest, none=1.0), 1.0)[below.of] * p
    return sizes, np.add.reduceat((counts > 0).astype(np.int64)[at], starts), base, np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per input row.

    held_out is crc32(id as text) mod 5 = 1, the documents that training leaves out in op9; a null id is
    not held out. Null and empty texts score their end token alone. Repeated rows are scored alike; ties
    don't arise. Other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in runs(batch):
                n, known, base, full = log_scores(model, texts)
                cols = [ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def in_training(id_col: str = "doc_id"):
    """The training rows: crc32 of the id as text is not 1 mod 5; a null id trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 1, F.lit(True))

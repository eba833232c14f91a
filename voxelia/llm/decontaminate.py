"""Benchmark decontamination by CGK embedding and bit sampling.

A CGK random walk reads a window from its first character: step j copies the character under the pointer
to the output and moves on or stays, as a random function of j and that character says. Two windows at a
small edit distance fall back into step after an edit, so their outputs differ in few places, and a
sample of output places agrees with good probability. Windows begin at every word of a document and at
every word of an item, so an item offers one chance for each of its words and walk. A window's samples
are compared with those of the items from the first on, and it is dropped at the first that no item has.
Whatever agrees in all samples is verified: the whole item against its place in the document, by exact
edit distance (bit-parallel, with free ends in the document).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
FOLD_BITS = 18
#: First code point from which scripts are mostly written without blanks.
UNSPACED = 0x0E00


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every character of the basic plane where it is one character, and white space."""
    low = np.array([ord(s) if len(s := chr(c).lower()) == 1 else c for c in range(0xD800)] + list(range(0xD800, 0x10000)), np.uint32)
    return low, np.array([c < 0xD800 and chr(c).isspace() for c in range(0x10000)])


def folded(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with white space runs as one blank, and their places in text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    low, space = tables()
    plain = np.minimum(codes, 0xFFFF)
    out = np.where(codes < 0x10000, low[plain], codes)
    blank = space[plain] & (codes < 0x10000)
    out[blank] = 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return out[keep], np.flatnonzero(keep)


def narrow(codes: np.ndarray) -> np.ndarray:
    return (codes ^ (codes >> 8)).astype(np.uint8)


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Places after a blank; in scripts that are written without blanks (from Thai on), every place."""
    text = codes != 32
    text[1:] &= (codes[:-1] == 32) | (codes[1:] >= UNSPACED)
    return np.flatnonzero(text)


class Index:
    """Keys of the windows of a block of items; ``steps``, ``samples`` and ``walks`` set the LSH."""

    def __init__(self, items: list[tuple[int, str]], rate: float, steps: int = 64, samples: int = 10, walks: int = 3, seed: int = 5):
        r = np.random.default_rng(seed)
        self.rate, self.steps = rate, steps
        self.moves = r.integers(0, 2, (walks, steps, 256)).astype(np.int32)
        self.places = np.sort(np.stack([r.choice(steps, samples, replace=False) for _ in range(walks)]), 1)
        self.ids = [i for i, _ in items]
        self.codes = [folded(t)[0] for _, t in items]
        self.codes = [c[int(c[:1].tolist() == [32]) : len(c) - int(c[-1:].tolist() == [32])] for c in self.codes]
        self.short: list[tuple[int, list[tuple[int, str]]]] = []  # shorter than a walk has steps: (item, its pieces)
        found: list[list] = [[] for _ in range(walks)]
        for k, c in enumerate(self.codes):
            if not len(c):
                continue
            starts, buf = word_starts(c), np.concatenate([narrow(c), np.zeros(steps, np.uint8)])
            some = False
            for w in range(walks):
                keys, at = self.walk(buf, starts, w, None)
                good = at < len(c)
                found[w].append((keys[good], np.full(good.sum(), k), starts[good]))
                some |= bool(good.any())
            if not some or len(c) < steps:
                self.short.append((k, self.pieces("".join(map(chr, c)))))
        self.keys, self.item, self.offset, self.filters = [], [], [], []
        for w in range(walks):
            keys, item, offset = (np.concatenate([f[i] for f in found[w]]) if found[w] else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.item.append(item[order])
            self.offset.append(offset[order])
        # which beginnings of sampled sequences occur, hashed to bits
        self.filters = np.zeros((walks, samples, 1 << FOLD_BITS), bool)
        for k, c in enumerate(self.codes):
            if len(c):
                buf = np.concatenate([narrow(c), np.zeros(steps, np.uint8)])
                for w in range(walks):
                    self.walk(buf, word_starts(c), w, None, mark=self.filters[w])
        self.bits = [self.pattern(c) for c in self.codes]

    def pieces(self, item: str) -> list[tuple[int, str]]:
        """A short item in one piece more than it may have edits, so that one of them stands unedited wherever it is found."""
        cuts = np.linspace(0, len(item), int(self.rate * len(item)) + 2).astype(int).tolist()
        return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    @staticmethod
    def pattern(codes: np.ndarray) -> dict[int, int]:
        bits: dict[int, int] = {}
        for i, c in enumerate(codes.tolist()):
            bits[c] = bits.get(c, 0) | 1 << i
        return bits

    def walk(self, buf: np.ndarray, starts: np.ndarray, w: int, kept: list | None, mark: np.ndarray | None = None):
        """Keys of the windows at starts and the last places read; with ``kept``, windows without an item
        that agrees so far are dropped on the way and the starts that are left are put there."""
        at = starts.astype(np.int32)
        keys = np.zeros(len(at), np.uint64)
        moves, k = self.moves[w], 0
        last = int(self.places[w, -1])
        for j in range(last + 1):
            c = buf[at]
            if k < self.places.shape[1] and j == self.places[w, k]:
                keys = keys * np.uint64(0x100000001B3) + c + np.uint64(1)
                fold = (keys * GOLDEN) >> np.uint64(64 - FOLD_BITS)
                if mark is not None:
                    mark[k, fold] = True
                if kept is not None:
                    live = self.filters[w, k][fold]
                    at, keys, starts, c = at[live], keys[live], starts[live], c[live]
                    if not len(at):
                        break
                k += 1
            if j < last:
                at = at + moves[j][c]
        if kept is not None:
            kept.append(starts)
        return keys, at

    def distance(self, k: int, codes: np.ndarray) -> tuple[int, int]:
        """Least edit distance of item k to any part of codes, and the end of such a part."""
        n, bits = len(self.codes[k]), self.bits[k]
        full, top = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score = full, 0, n
        best, end = n, 0
        for j, c in enumerate(codes.tolist()):
            eq = bits.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (~(xh | pv) & full), pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (~(xv | ph) & full), ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For every text: (item id, distance, start, end) of the best place of each item found."""
        read = [folded(t) for t in texts]
        sizes = np.array([len(c) + 1 for c, _ in read], np.int64)
        begins = np.cumsum(sizes) - sizes
        whole = np.concatenate([x for c, _ in read for x in (c, np.zeros(1, np.uint32))] + [np.zeros(self.steps, np.uint32)])
        buf = narrow(whole)
        starts = np.concatenate([word_starts(c) + b for (c, _), b in zip(read, begins, strict=True)] or [np.zeros(0, np.int64)])
        tried: set[tuple[int, int, int]] = set()
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for w in range(len(self.keys)):
            if not len(self.keys[w]) or not len(starts):
                continue
            kept: list[np.ndarray] = []
            keys, _ = self.walk(buf, starts, w, kept)
            left, right = np.searchsorted(self.keys[w], keys, "left"), np.searchsorted(self.keys[w], keys, "right")
            for p, lo, hi in zip(kept[0][right > left].tolist(), left[right > left].tolist(), right[right > left].tolist(), strict=True):
                d = int(np.searchsorted(begins, p, "right")) - 1
                codes, place = read[d]
                for e in range(lo, hi):
                    k = int(self.item[w][e])
                    n = len(self.codes[k])
                    most = int(self.rate * n)
                    from_ = p - int(begins[d]) - int(self.offset[w][e])
                    spot = (d, k, from_ // (most + 1))
                    if spot in tried:
                        continue
                    tried.add(spot)
                    a, b = max(0, from_ - 2 * most - 1), min(len(codes), from_ + n + 2 * most + 1)
                    self.note(best[d], k, codes[a:b], a, place, most)
        for d, (codes, place) in enumerate(read):
            if self.short:
                text = "".join(map(chr, codes))
                for k, own in self.short:
                    self.search_short(best[d], k, own, text, codes, place)
        return [[(self.ids[k], *v) for k, v in sorted(b.items())] for b in best]

    def search_short(self, best: dict, k: int, own: list[tuple[int, str]], text: str, codes: np.ndarray, place: np.ndarray) -> None:
        """Verify a short item at every place of any of its pieces; places that overlap are verified once."""
        n, most, upto = len(self.codes[k]), int(self.rate * len(self.codes[k])), -1
        found = set()
        for offset, piece in own:
            at = text.find(piece)
            while at >= 0:
                found.add(at - offset)
                at = text.find(piece, at + 1)
        for from_ in sorted(found):
            if from_ > upto:
                upto = from_ + most
                a, b = max(0, from_ - most), min(len(codes), upto + n + most + 1)
                self.note(best, k, codes[a:b], a, place, most)

    def note(self, best: dict, k: int, part: np.ndarray, a: int, place: np.ndarray, most: int) -> None:
        dist, end = self.distance(k, part)
        if dist > most or (k in best and best[k][0] <= dist):
            return
        own = Index.back(self, k, part[:end])
        best[k] = (dist, int(place[a + end - own]), int(place[a + end - 1]) + 1)

    def back(self, k: int, part: np.ndarray) -> int:
        """Length of the shortest part that ends where part does, at the least distance: read backwards."""
        codes, bits = self.codes[k][::-1], self.bits[k]
        mirror = Index.__new__(Index)
        mirror.codes, mirror.bits = {k: codes}, {k: Index.pattern(codes)}
        del bits
        return max(1, mirror.distance(k, part[::-1])[1])


def item_blocks(items: DataFrame, item_col: str, text_col: str, most_items: int, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded number and size; the driver holds one block at a time."""
    block, chars = [], 0
    for row in items.select(item_col, text_col).where(f"`{text_col}` is not null").toLocalIterator():
        if block and (len(block) >= most_items or chars + len(row[1]) > most_chars):
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield block


LIMITS = {"most_items": 5000, "most_chars": 2_000_000}


def groups(column: pa.Array, most: int = 750_000) -> Iterator[tuple[int, list]]:
    """Runs of texts of about most characters together, with the row of the first."""
    run, chars, first = [], 0, 0
    for k, t in enumerate(column):
        run.append(t.as_py())
        chars += len(run[-1] or "")
        if chars >= most:
            yield first, run
            run, chars, first = [], 0, k + 1
    if run:
        yield first, run


def leaks(docs: DataFrame, items: DataFrame, rate: float = 0.2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, distance, start, end): one row for every document row and item found in it.

    An item is found where its edit distance to a part of the text, letters in either case and white space
    runs as one blank, is at most ``rate`` times its length; distance, start and end (code points of the
    text, end exclusive) are of the best place, the first among equals for one walk. Null and empty texts
    and items match nothing; items too short for a walk are searched by pieces, one more than the edits they may have, of which one must stand unedited. Repeated rows give repeated
    rows. Other columns are dropped. Items go to the executors in blocks of at most LIMITS, one narrow
    pass over the documents each.
    """
    types = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {types[0]}, `{item_col}` {types[1]}, distance int, start int, `end` int"
    out = None
    for block in item_blocks(items, item_col, item_text_col, **LIMITS):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block, rate)
            for batch in batches:
                for first, texts in groups(batch.column(1)):
                    hits = [(first + d, *h) for d, own in enumerate(index.search(texts)) for h in own]
                    if hits:
                        rows = pa.array([h[0] for h in hits])
                        cols = [batch.column(0).take(rows), pa.array([h[1] for h in hits]), *(pa.array([h[i] for h in hits], pa.int32()) for i in (2, 3, 4))]
                        yield pa.RecordBatch.from_arrays(cols, names=[id_col, item_col, "distance", "start", "end"])

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.2, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in whose text no item is found; null texts stay."""
    where = docs.columns.index(text_col)
    for block in item_blocks(items, item_col, item_text_col, **LIMITS):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block, rate)
            for batch in batches:
                for first, texts in groups(batch.column(where)):
                    yield batch.slice(first, len(texts)).filter(pa.array([not own for own in index.search(texts)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

"""Elias-Fano sequences and trie levels over them, in numpy arrays that can be memory-mapped.

A level holds entries (context, word), sorted; a shard file has a run of them: the contexts as one
Elias-Fano sequence, monotone pointers from a context to its entries as another, and the words as a third.
Words are stored relative to their context, each plus the last value of the context before, so that they
rise over the whole shard. A lookup finds the context, then the successor of the word's value within the
entries of that context.
"""

from __future__ import annotations

import json
import os

import numpy as np

ONE = np.uint64(1)


def or_into(words: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """words[at] |= values for rising at, with repeats."""
    if len(at):
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[starts]] |= np.bitwise_or.reduceat(values, starts)


LOW, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)  # the lowest and the highest bit of each byte
#: Place of the set bit number r of a byte at [8 * byte + r].
IN_BYTE = np.argsort(1 - (np.arange(256)[:, None] >> np.arange(8) & 1), axis=1, kind="stable").astype(np.uint64).ravel()


def in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number rank (from 0) in each word, which must have so many: the byte by counts up
    to each byte, side by side in one word, then the bit from a table."""
    k = rank.astype(np.uint64)
    upto = words - (words >> ONE & LOW * np.uint64(0x55))
    upto = (upto & LOW * np.uint64(0x33)) + (upto >> np.uint64(2) & LOW * np.uint64(0x33))
    upto = (upto + (upto >> np.uint64(4)) & LOW * np.uint64(0x0F)) * LOW
    place = np.bitwise_count((k * LOW | HIGH) - upto & HIGH).astype(np.uint64) << np.uint64(3)
    before = upto << np.uint64(8) >> place & np.uint64(255)
    byte = words >> place & np.uint64(255)
    return (place + IN_BYTE[(byte << np.uint64(3)) + k - before]).astype(np.int64)


class EliasFano:
    """A sorted sequence of non-negative integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(np.asarray(high)).astype(np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - self.ones
        self.most = int(len(high) * 64 - ones.sum()) if n else 0  # zeros there are

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = v & np.uint64((1 << bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            or_into(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) + 1 if n else 0) // 64 + 1, np.uint64)
        or_into(high, place >> 6, ONE << (place & 63).astype(np.uint64))
        return EliasFano(n, bits, low, high)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        if over.any():
            out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (out & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.low_bits) | self.lows(i)

    def below(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part under h."""
        out = np.zeros(len(h), np.int64)
        out[h > self.most] = self.n
        k = np.flatnonzero((h > 0) & (h <= self.most))
        zero = h[k] - 1
        word = np.searchsorted(self.zeros, zero, "right") - 1
        place = word * 64 + in_word(~self.high[word], zero - self.zeros[word])
        out[k] = np.minimum(place - zero, self.n)
        return out

    def having(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places from and to (exclusive) of the values with the high part h: ones up to the next zero."""
        a = self.below(h)
        bit = a + h
        there = (h <= self.most) & (bit >> 6 < len(self.high))
        rest = ~self.high[np.where(there, bit >> 6, 0)] >> (bit & 63).astype(np.uint64)
        b = a + np.bitwise_count((rest & (~rest + ONE)) - ONE)
        far = np.flatnonzero(~there | (rest == 0))  # the next zero is in a later word
        b[far] = self.below(h[far] + 1)
        return a, b

    def find(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of x between start and end, or -1; values there must differ."""
        h, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        a, b = self.having(h)
        a, b = np.maximum(start, a), np.minimum(end, b)
        any_ = a < b
        live = np.flatnonzero(b - a > 1)  # a single value is compared once, below
        while len(live):
            mid = (a[live] + b[live]) >> 1
            more = self.lows(mid) <= low[live]
            a[live] = np.where(more, mid, a[live])
            b[live] = np.where(more, b[live], mid)
            live = live[b[live] - a[live] > 1]
        out = np.where(any_, a, -1)
        some = np.flatnonzero(out >= 0)
        out[some] = np.where(self.lows(out[some]) == low[some], out[some], -1)
        return out

    def arrays(self) -> dict:
        return {"n": self.n, "bits": self.low_bits, "low": self.low, "high": self.high}


def write_shard(path: str, contexts: np.ndarray, words: np.ndarray, **columns: np.ndarray) -> None:
    """Write entries sorted by (context, word) with their columns; the file appears whole or not at all.
    A column named rest has one value for each different context."""
    starts = np.flatnonzero(np.diff(contexts, prepend=-1)) if len(contexts) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(contexts))
    lasts = words[starts + sizes - 1] if len(starts) else np.zeros(0, np.int64)
    values = words + np.repeat(np.cumsum(lasts) - lasts, sizes)
    parts = {"ctx": EliasFano.build(contexts[starts]), "ptr": EliasFano.build(np.append(starts, len(contexts))), "val": EliasFano.build(values)}
    flat: dict[str, np.ndarray] = {}
    head: dict = {"sequences": {}, "arrays": {}}
    for name, ef in parts.items():
        head["sequences"][name] = [ef.n, ef.low_bits]
        flat |= {f"{name}.low": ef.low, f"{name}.high": ef.high}
    flat |= columns
    at = 0
    for name, a in flat.items():
        head["arrays"][name] = [at, len(a), a.dtype.str]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    own = f"{path}.{os.getpid()}.tmp"
    with open(own, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in flat.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(own, path)


class Shard:
    """A memory-mapped shard file."""

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + size].tobytes())
        self.columns = {k: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, n, kind) in head["arrays"].items()}
        ef = {k: EliasFano(n, bits, self.columns[f"{k}.low"], self.columns[f"{k}.high"]) for k, (n, bits) in head["sequences"].items()}
        self.ctx, self.ptr, self.val = ef["ctx"], ef["ptr"], ef["val"]

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of (context, word) and numbers of the contexts, -1 where there is none; queries sorted by context."""
        out = np.full(len(contexts), -1, np.int64)
        if not len(contexts) or not self.ctx.n:
            return out, out
        first = np.flatnonzero(np.diff(contexts, prepend=-1))
        each = np.repeat(np.arange(len(first)), np.diff(first, append=len(contexts)))
        own = contexts[first]
        j = self.ctx.find(own, np.zeros(len(own), np.int64), np.full(len(own), self.ctx.n))
        known = np.flatnonzero(j >= 0)
        start, end, base = (np.zeros(len(own), np.int64) for _ in range(3))
        start[known], end[known] = self.ptr.access(j[known]), self.ptr.access(j[known] + 1)
        later = known[start[known] > 0]
        base[later] = self.val.access(start[later] - 1)
        at = np.flatnonzero(j[each] >= 0)
        k = each[at]
        out[at] = self.val.find(base[k] + words[at], start[k], end[k])
        return out, j[each]


class Level:
    """Shards in order; manifest has (file, first context, first word, entries) of each, rest the value of
    the column rest for contexts in several shards."""

    def __init__(self, manifest: list[tuple[str, int, int, int]], rest: dict[int, int] | None = None):
        self.several = np.array(sorted(rest or {}), np.int64)
        self.rest = np.array([rest[c] for c in self.several.tolist()], np.float64) if rest else np.zeros(0)
        self.manifest = sorted(manifest, key=lambda m: m[1:3])
        self.offsets = np.cumsum([0] + [m[3] for m in self.manifest])
        self.firsts = [(m[1], m[2]) for m in self.manifest]
        self.open: dict[int, Shard] = {}

    def shard(self, k: int) -> Shard:
        if k not in self.open:
            self.open[k] = Shard(self.manifest[k][0])
        return self.open[k]

    def find(self, contexts: np.ndarray, words: np.ndarray, *columns: str) -> tuple[np.ndarray, ...]:
        """Index over all shards of each (context, word), -1 where there is none, and its columns (0 there).
        Queries must be sorted by (context, word)."""
        out = np.full(len(contexts), -1, np.int64)
        got = [np.zeros(len(contexts), np.int64) for c in columns]
        begin = 0
        for k in range(len(self.manifest)):
            if k + 1 < len(self.manifest):
                c, w = self.firsts[k + 1]
                left, right = np.searchsorted(contexts, c, "left"), np.searchsorted(contexts, c, "right")
                end = int(left + np.searchsorted(words[left:right], w, "left"))
            else:
                end = len(contexts)
            if end > begin:
                s = self.shard(k)
                at, of = s.find(contexts[begin:end], words[begin:end])
                hit = np.flatnonzero(at >= 0)
                out[begin + hit] = at[hit] + self.offsets[k]
                for g, c in zip(got, columns, strict=True):
                    which, place = (np.flatnonzero(of >= 0), of) if c == "rest" else (hit, at)
                    g[begin + which] = s.columns[c][place[which]]
                begin = end
        if "rest" in columns and len(self.several):
            place = np.minimum(np.searchsorted(self.several, contexts), len(self.several) - 1)
            which = np.flatnonzero(self.several[place] == contexts)
            got[columns.index("rest")][which] = self.rest[place[which]]
        return (out, *got)

"""Quality rules by repetition coverage.

Words of a document get dense ids; rolling hashes over several n-gram lengths mark every n-gram that
has occurred before in the same document, and the rule measures how many characters lie inside marked
n-grams and inside repeated lines. The share of repeated lines by count is reported but not judged: in a
document of three lines one closing line that equals the first says nothing. One pass over Arrow batches, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The largest share of characters inside repeated n-grams, by n, and in repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS_LIMIT = 0.20
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: dense ids to well-spread hashes, one to one."""
    x = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def repeated(keys: np.ndarray, first: bool) -> np.ndarray:
    """Which entries of keys occur twice or more; the first occurrence counts only with ``first``."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    if first:
        hit[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = hit
    return out


def covered(marks: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words that lie in a marked window of n words."""
    edge = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The base columns and the shares of one text; a null or empty text has no words and all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at the bytes 0x20 and 0x09-0x0D only
    n = len(words)
    if n == 0:
        return 0, 0, len(SYMBOLS.findall(text or "")), 0, 0, [0.0] * len(NGRAM_LIMITS), 0.0, 0.0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    sizes = np.array([len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in seen], np.int64)
    chars = sizes[ids]
    total = int(chars.sum())
    repeat_words = 0
    if n >= 3:
        _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        repeat_words = int(covered(repeated(pair[:-1] * len(seen) + ids[2:], True), 3, n).sum())
    first, n_dup, dup_chars, n_lines = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        if not line.strip():  # bytes.strip removes the same white space
            continue
        n_lines += 1
        if line in first:
            n_dup += 1
            dup_chars += len(line.decode("utf-8", "surrogatepass")) - sum(map(line.count, (b" ", b"\t", b"\r", b"\x0b", b"\x0c")))
        else:
            first.add(line)
    shares = []
    base = mix(ids.astype(np.uint64))
    rolling = base.copy()
    for k in range(2, max(NGRAM_LIMITS) + 1):
        if n < k:
            break
        rolling = rolling[: n - k + 1] * BASE + base[k - 1 :]
        if k in NGRAM_LIMITS:
            hit = repeated(rolling, False)  # what a reader meets again
            shares.append(float(chars[covered(hit, k, n)].sum()) / total if hit.any() else 0.0)
    shares += [0.0] * (len(NGRAM_LIMITS) - len(shares))
    return n, total, len(SYMBOLS.findall(text)), n_dup, repeat_words, shares, n_dup / n_lines, dup_chars / total


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ngram_shares array<double>, dup_line_share double, dup_line_char_share double, base_failed boolean, kept boolean"


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_through: bool = False) -> DataFrame:
    """One row per input row: id_col, the base counts, the repetition shares, base_failed and kept.

    With pass_through, only documents that are kept come back, with all their own columns. A null text
    has no words, so it fails. Repeated rows are judged alike; ties don't arise. Other columns are not
    read without pass_through and never clash with it, as nothing is added to them.
    """
    limits = np.array(list(NGRAM_LIMITS.values()))

    def judge(text):
        m = measure(text)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        fine = bool(np.all(np.array(m[5]) <= limits)) and m[7] <= LINE_CHARS_LIMIT
        return (*m, failed, not failed and fine)

    if pass_through:
        where = docs.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):  # small copies of what stays
                    part = batch.slice(at, 500)
                    yield part.filter(pa.array([judge(t.as_py())[-1] for t in part.column(where)], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")

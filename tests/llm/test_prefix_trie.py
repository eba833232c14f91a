"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from voxelia.llm import prefix_trie
from voxelia.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, N int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1], hashlib.md5((hashlib.md5(x[1].encode()).hexdigest() + hashlib.md5(x[2].encode()).hexdigest()).encode()).digest()))] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def wanted(paths):
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = [n for n in below.get(node, [])]
        leaves = sum(k[0] for k in kids) or 1
        saved = sum(k[1] for k in kids) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        if node:
            below.setdefault(node[:-1], []).append((leaves, saved))
        ends = ",".join(map(str, sorted(c for c in members[node] if len(paths[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(frame)))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


EDGES = [(None, 0, "user", "no id"), (7, None, None, None), (7, 3, "user", ""), (8, 1, "a", "tie"), (8, 1, "a", "tie"), (8, 1, "a", "tie2"), (8, 1, "b", "ü" * 100_000), (2003, 0, "u", "no base"), (2004, 5, "u", "no base")]


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_against_a_dictionary(spark, partitions):
    """Few different turns, so prefixes are shared over many partitions; a third of all conversations are equal."""
    r, rows = random.Random(partitions), list(EDGES)
    for conv in range(10, 900):
        same = r.random() < 0.3
        for turn in range(10 if same else r.randint(1, 14)):
            rows.append((conv, turn, "u" if turn % 2 else "a", "same" if same else r.choice(["x", "yy", "é", ""])))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(run(spark, rows)) == wanted(rebuilt(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_paths_over_many_partitions(spark):
    rows = [(5 * c, t, "u", f"t{t}" if t < 40 * c else f"c{c}-{t}") for c in range(8) for t in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert found(run(spark, rows)) == wanted(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_tables(spark):
    assert run(spark, []).count() == 0
    assert found(run(spark, [(None, 1, "u", "x")])) == []
    for rows in ([(1, 0, "u", "x")], [(0, 0, "u", "x"), (1, 0, "u", "y")], EDGES):
        assert found(run(spark, rows)) == wanted(rebuilt(rows))


def test_ids_join_nodes_to_parents(spark):
    got = {bytes(r.id): r for r in run(spark, [(c, t, "u", f"{t * (c // 2)}") for c in range(20) for t in range(12)]).collect()}
    for r in got.values():
        if r.depth:
            assert got[bytes(r.parent_id)].depth == r.depth - 1 and got[bytes(r.parent_id)].conv_id == r.parent_conv_id
    assert len({(r.conv_id, r.depth) for r in got.values()}) == len(got)


def test_whole_table_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, sf)) == wanted(rebuilt(rows))

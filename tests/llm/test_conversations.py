"""Conversation repair against a brute-force search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from voxelia.llm import conversations
from voxelia.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, nth string, Copy int"
EMPTY = hashlib.sha256(b"").hexdigest()
GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text, here = said(role), said(text), out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        here += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: ((0, 0) if x[0] is None else (1, x[0]), x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Best-first over (cost, edits) and whole strings of initials, with no use of the grammar's states but the final test."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, k, said, made = heapq.heappop(todo)
        if k == len(rows) and GOOD.fullmatch(said):
            return cost, audit, made
        if (k, said) in done:
            continue
        done.add((k, said))
        tails = [(2, "I", k, r, "") for r in ("user", "assistant")]
        if k < len(rows):
            _, role, text = rows[k]
            tails.append((3, "D", k + 1, None, None))
            if faults[k] in ("", "truncated"):
                more = faults[k] == "truncated"
                tails += [(2 + more, "R", k + 1, r, text) for r in ("user", "assistant")] + ([(more, "K", k + 1, role, text)] if role else [])
        for c, label, to, role, text in tails:
            now = said + (role[:1] if role else "")
            if re.fullmatch(r"s?(ua)*u?", now) and len(now) <= 2 * len(rows) + 2:
                heapq.heappush(todo, (cost + c, audit + label, to, now, made if role is None else (*made, f"{role}:{text}")))
    raise AssertionError


def wanted(rows):
    out = []
    for conv, here in damaged(rows).items():
        if not here:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", EMPTY))
            continue
        faults, turns = faults_of(here), [t for t, _, _ in here if t is not None]
        cost, audit, made = cheapest(here, faults)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(here, here[1:], strict=False)]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


EDGES = [
    (None, 0, "user", "no id."), (None, 1, "assistant", "still none."), (-1, None, None, None), (-2, None, "user", "null turn."), (-2, 4, "assistant", "late"),
    (-3, 1, "", "no role."), (-3, 2, "System", "upper."), (-3, 3, "tool", "other."), (-4, 1, "user", "tie."), (-4, 1, "assistant", "tie."), (-4, 1, "user", "tie."),
    (-5, 0, "user", " "), (-5, 1, "assistant", "\n\t "), (-5, 2, "assistant", "é!\x0b"), (-6, 7, "user", "long. " * 40000), (-6, 9, "assistant", "x" * 200000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def run(spark, rows):
    return conversations.digests(conversations.repair(conversations.damage(frame(spark, rows)), lost="lost"))


def test_against_brute_force(spark):
    r, rows = random.Random(7), list(EDGES)
    for conv in range(400):
        for turn in sorted(r.sample(range(12), r.randint(1, 7))):
            text = r.choice(["One.", "Two!", "Three?", "cut", "", " ", "Same.", f"t{turn}.", f"t{turn}"])
            rows.append((conv, turn if r.random() > 0.03 else None, r.choices(["user", "assistant", "system", "tool", None], [9, 9, 3, 1, 1])[0], text))
    assert plain(run(spark, rows).collect()) == plain(wanted(rows))


def test_whole_table_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(op11_conversation_repair(spark, sf).collect()) == plain(wanted(rows))


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(30000)]
    (got,) = run(spark, rows).collect()
    here = damaged(rows)[1]
    faults = faults_of(here)
    assert (got.blank, got.duplicate, got.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    assert sum(e != "I" for e in got.audit) == len(here)
    assert got.cost == sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in got.audit) + faults.count("truncated") - sum(f == "truncated" and e == "D" for f, e in zip(faults, got.audit.replace("I", ""), strict=True))
    assert run(spark, []).count() == 0 and conversations.repair(frame(spark, [])).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "system", "Be brief."), (1, 4, "assistant", "cut")]
    got = conversations.repair(frame(spark, rows)).orderBy("at").collect()
    assert [(x.edit, x.cost, x.fault, x.role, x.text) for x in got] == [("K", 0, "", "user", "Hello."), ("D", 3, "duplicate", "user", "Hello."), ("D", 3, "", "system", "Be brief."), ("K", 1, "truncated", "assistant", "cut")]
    assert conversations.repair(frame(spark, rows)).where(F.col("edit") == "D").count() == 2


@pytest.mark.parametrize("after", [conversations.END, bytes([0, 4, 2, 0]), bytes([2, 3, 1, 0])])
def test_walk_keeps_the_cost(after):
    for symbol in [(i, f) for i in ("s", "u", "a", "t", "") for f in conversations.FAULTS]:
        here = conversations.costs(symbol, after)
        for q in range(4):
            steps, to = conversations.walk(symbol, after, q)
            assert sum(c for _, c, _ in steps) + after[to] == here[q]

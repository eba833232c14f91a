"""Conversation structure repair as a weighted finite-state composition.

Three machines are composed lazily, one row at a time:

* the input acceptor, a chain with one symbol a row: the initial of the row's role and its fault;
* the edit transducer, one state that keeps, reroles, deletes or inserts at a cost;
* the grammar acceptor of the role initials ``(s?(ua)+)?``, four states.

The cheapest path is found in topological order. Its weights are (cost, label string), compared in this
order. Costs to go are relaxed from the last row to the first. Labels of the arcs that leave a state all
differ, so the least string of a state is its least label on a cheapest path followed by the least string
behind it: the walk from the first row takes that label, and no string is stored.

Both passes read rows as a stream sorted inside their partition, with four small numbers as state, so a
conversation's rows are never held together. Its audit string alone is, as that is one cell of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
#: Grammar state to role initial to next state; a conversation may end in FINAL.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = ("assistant", "user")
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
NEVER = 1 << 20


def edits(symbol: tuple[str, str], state: int) -> list[tuple[str, int, int, str | None]]:
    """Arcs (label, cost, next state, new role) of the composed machine that read a row from a grammar state."""
    initial, fault = symbol
    out = [(DELETE, COST[DELETE], state, None)]
    if fault in ("", "truncated"):
        more = TRUNCATED_COST if fault else 0
        if initial in GRAMMAR[state]:
            out.append((KEEP, COST[KEEP] + more, GRAMMAR[state][initial], None))
        out += [(REROLE, COST[REROLE] + more, GRAMMAR[state][r[0]], r) for r in ROLES if r[0] in GRAMMAR[state]]
    return out


def inserts(state: int) -> list[tuple[str, int, int, str | None]]:
    """Arcs that read nothing: a new turn in front of the next row or of the end."""
    return [(INSERT, COST[INSERT], GRAMMAR[state][r[0]], r) for r in ROLES if r[0] in GRAMMAR[state]]


@lru_cache(maxsize=1 << 14)
def costs(symbol: tuple[str, str] | None, after: bytes) -> tuple[int, ...]:
    """Costs to go from each grammar state in front of a row, given those behind it; no symbol: in front of the end."""
    if symbol is None:
        out = [0 if q in FINAL else NEVER for q in range(len(GRAMMAR))]
    else:
        out = [min(c + after[to] for _, c, to, _ in edits(symbol, q)) for q in range(len(GRAMMAR))]
    for _ in GRAMMAR:  # a path without a cycle has fewer inserts in a row than there are states
        out = [min([out[q], *(c + out[to] for _, c, to, _ in inserts(q))]) for q in range(len(GRAMMAR))]
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def back(symbol: tuple[str, str] | None, after: bytes) -> bytes:
    """costs() over the least of them: few different values, as no state is more than a few edits from another."""
    found = costs(symbol, after)
    return bytes(c - min(found) for c in found)


END = back(None, b"")


@lru_cache(maxsize=1 << 16)
def walk(symbol: tuple[str, str] | None, after: bytes, state: int) -> tuple[tuple[tuple[str, int, str | None], ...], int]:
    """The edits (label, cost, new role) of the least cheapest path over one row, inserts before it included, and the state behind it."""
    here, out = costs(symbol, after), []
    while True:
        if symbol is None and state in FINAL and here[state] == 0:
            return tuple(out), state
        arcs = [a for a in inserts(state) if a[1] + here[a[2]] == here[state]]
        if symbol is not None:
            arcs += [a for a in edits(symbol, state) if a[1] + after[a[2]] == here[state]]
        label, cost, state, role = min(arcs, key=lambda a: a[0])
        out.append((label, cost, role))
        if label != INSERT:
            return tuple(out), state


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): the fixed damage of the test, from crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (lost is true, role and text null), 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes it the user's. A null id, turn, role or text counts as one space there; id and turn stay null in the
    result. Rows of one id and turn get one kind of damage. Other columns are not read.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate(said("text"), ".!?", "")).when(F.col("k") != 0, said("text"))
    role = F.when(F.col("k") == 4, "user").when(F.col("k") != 0, said("role"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.select("conv_id", "turn", "role", "text", kind.alias("k"))
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("lost"), F.explode(copies).alias("copy")).drop("copy"))


def repair(rows: DataFrame, lost: str | None = None) -> DataFrame:
    """The cheapest edits that give every conversation the role grammar.

    rows has conv_id, turn, role, text; with ``lost``, rows where that column is true only say that their
    conversation exists. Returns (conv_id, at, edit, cost, fault, turn, was, role, text), one row an edit in
    order, at counting from 0: edit is K, R, D or I; was, the role before (null for I); role and text as after
    the edit, those of a deleted row as before. A conversation without rows has one row with edit null. The rows
    come clustered by conversation and in order inside each partition.

    Rows go by turn, nulls first, rows of one turn by role, then text. A null conv_id is one conversation. Null
    roles and texts count as one space. A role of no character can't be kept. The first fault counts: blank (no
    character besides ASCII white space), duplicate (role and text earlier in the conversation), truncated (last
    such character not one of ``.!?``). Of equally cheap repairs the one whose labels are least in ASCII is taken.
    Texts of any length pass through; an empty table gives no rows; other columns are not read.

    One shuffle by conversation. A conversation of a third of all rows is one task, but a stream: what follows
    hashes it from end to end, which no second task could share. All else (damage, digests) is done before it.
    """
    gone = F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)
    said = lambda c: F.when(~gone, F.coalesce(c, F.lit(" ")))
    kept = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), gone.alias("lost"))
    kept = kept.withColumn("digest", F.unhex(F.md5("text"))).repartition("conv_id")
    nth = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~last.isin(*".!?"), 3).otherwise(0)
    marked = kept.withColumn("nth", nth).withColumn("fault", F.when(F.col("lost"), -1).otherwise(fault).cast("int")).select("conv_id", "turn", "role", "text", "nth", "fault")
    key = marked.schema["conv_id"].dataType.simpleString()
    turn = marked.schema["turn"].dataType.simpleString()
    head = f"conv_id {key}, turn {turn}, role string, text string, nth int, fault int"
    backward = marked.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth"))
    ahead = backward.mapInArrow(relaxed, f"{head}, ahead binary")
    forward = ahead.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth")
    return forward.mapInArrow(edited, f"conv_id {key}, at bigint, edit string, cost bigint, fault string, turn {turn}, was string, role string, text string")


def symbols(batch: pa.RecordBatch) -> list[tuple[str, str] | None]:
    """A symbol for each row, none for lost rows."""
    initials = pc.utf8_slice_codeunits(pc.fill_null(batch.column("role"), ""), 0, 1).to_pylist()
    return [None if f < 0 else (i, FAULTS[f]) for i, f in zip(initials, batch.column("fault").to_pylist(), strict=True)]


def relaxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows, sorted from the last to the first, the costs to go behind each of them."""
    at, behind = object(), END
    for batch in batches:
        out = []
        for conv, symbol in zip(batch.column("conv_id").to_pylist(), symbols(batch), strict=True):
            if conv != at:
                at, behind = conv, END
            out.append(behind)
            if symbol is not None:
                behind = back(symbol, behind)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "ahead"])


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of rows that are sorted from the first to the last."""
    nobody = object()
    at, n, state, kinds = nobody, 0, 0, None

    def ending() -> list[tuple]:
        """What a conversation ends with: turns put behind its last row, or the sign that it has no rows."""
        made = [(at, n + k, label, cost, None, None, role) for k, (label, cost, role) in enumerate(walk(None, b"", state)[0])]
        return made if n or made else [(at, 0, None, 0, None, None, None)]

    def batch_of(made: list[tuple], source: pa.RecordBatch) -> pa.RecordBatch:
        convs, ats, labels, costs_, faults, index, roles = ([m[k] for m in made] for k in range(7))
        took = pa.array(index, pa.int64())
        was = source.column("role").take(took)
        edit, role = pa.array(labels, pa.string()), pc.coalesce(pa.array(roles, pa.string()), was)
        text = source.column("text").take(took)
        text = pc.if_else(pc.fill_null(pc.equal(edit, INSERT), False), pa.scalar("", text.type), text)
        cols = [pa.array(convs, kinds[0]), pa.array(ats, pa.int64()), edit, pa.array(costs_, pa.int64()), pa.array(faults, pa.string()), source.column("turn").take(took), was, role, text]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", "at", "edit", "cost", "fault", "turn", "was", "role", "text"])

    batch = None
    for batch in batches:
        kinds, made = [batch.schema.field("conv_id").type], []
        for k, (conv, symbol, after) in enumerate(zip(batch.column("conv_id").to_pylist(), symbols(batch), batch.column("ahead").to_pylist(), strict=True)):
            if at is nobody or conv != at:
                if at is not nobody:
                    made += ending()
                at, n, state = conv, 0, 0
            if symbol is None:
                continue
            steps, state = walk(symbol, after, state)
            for label, cost, role in steps:
                made.append((conv, n, label, cost, None, None, role) if label == INSERT else (conv, n, label, cost, symbol[1], k, role))
                n += 1
        yield batch_of(made, batch)
    if at is not nobody:
        yield batch_of(ending(), batch)


DIGESTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of what repair() returns.

    It reads the rows as they come from repair(), clustered by conversation and in order, without a shuffle.
    gaps, the faults and illegal pairs are those before the repair; audit joins the edits; the hash is that of
    the repaired ``role:text``, joined by newlines. A conversation without rows has zeros, an empty audit and
    the hash of the empty string.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.mapInArrow(summed, f"conv_id {kind}, {DIGESTS}")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nobody = object()
    at, key_type = nobody, None
    names = ["conv_id", *(c.split()[0] for c in DIGESTS.split(", "))]

    def fresh() -> dict:
        return {"turns": 0, "least": None, "most": None, "before": None, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False} | dict.fromkeys(FAULTS, 0)

    def row(s: dict) -> tuple:
        gaps = 0 if s["least"] is None else s["most"] - s["least"] + 1 - s["turns"]
        return at, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["hash"].hexdigest()

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        types = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=names)

    s = fresh()
    for batch in batches:
        key_type, done, labels = batch.schema.field("conv_id").type, [], []
        for conv, edit, cost, fault, turn, was, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "fault", "turn", "was", "role", "text")), strict=True):
            if at is nobody or conv != at:
                if at is not nobody:
                    s["audit"].append("".join(labels))
                    done.append(row(s))
                    labels = []
                at, s = conv, fresh()
            if edit is None:
                continue
            labels.append(edit)
            s["cost"] += cost
            if edit != INSERT:
                s[fault] += 1
                if turn is not None:
                    if s["least"] is None:
                        s["least"] = turn
                    s["turns"] += turn != s["most"]
                    s["most"] = turn
                if s["before"] is not None:
                    s["illegal"] += s["before"] + was[:1] not in ("su", "ua", "au")
                s["before"] = was[:1]
            if edit != DELETE:
                s["hash"].update(("\n" if s["any"] else "").encode() + f"{role}:{text}".encode())
                s["any"] = True
        s["audit"].append("".join(labels))
        if done:
            yield batch_of(done)
    if at is not nobody:
        yield batch_of([row(s)])

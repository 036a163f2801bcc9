"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

A conversation's rows are read in order and only narrow facts of each (role, kind of fault) reach the search. A macro edit is a run
of inserted turns and what happens to the next row (Delete, Keep, Rerole): the codes `I*D`, `I*K`, `I*R` are prefix-free, so
two edit sequences compare as strings as their codes compare one by one. A layer of the search holds, for each state (nothing,
system, user, assistant last), the least cost and, in place of the audit string, the rank of that string among the layer's;
the next layer's ranks follow from (rank, code) alone. Each row stores a parent pointer and a code for each state, and the
audit is put together from the last row back. As costs count from a layer's least one, layers are few and are remembered.

Spark deals out the rows by conversation and sorts them; a task streams over its conversations and holds one's facts (about
40 bytes a row) and no texts. Edits go back to the rows as a table; a second stream hashes the repaired turns, a batch at a
time. A conversation is one task's work however long it is, since the search goes from row to row; its rows only pass
through. Copies of a conversation spread over all tasks.

Nulls: a null role or text is one space; null turns come first and don't count for gaps; a null conv_id is a conversation of
its own. Rows of the same turn are ordered by role and by a hash of the text. Repeated rows stay rows of their own (the later
is a duplicate). A conversation without rows has no edits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, small_batches

#: Costs of the edits and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: what the repaired turns end with. START and DONE may end a conversation.
START, SYSTEM, USER, DONE = range(4)
ROLES = {"s": 1, "u": 2, "a": 3}
#: Inserted turns before a row: two lead from a state to itself or to where none would do, but at the end.
RUN = 2
#: Two inserted turns and a deletion lead from any state to where another one's future serves as well: a state that costs
#: more than that above the least is never part of a cheapest result, and layers stay few.
SLACK = 2 * INSERT + DELETE
#: The macro edits, in the order of their codes as strings: the rank of a code is its place.
CODES = sorted("I" * k + x for k in range(RUN + 1) for x in "DKR")
FAULTS = ("", "blank", "duplicate", "truncated")
#: The white space that separates words.
SPACE = " \t\n\x0b\x0c\r"


def after(state: int, initial: str) -> int | None:
    """The state after a turn with this role initial; None: not allowed."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return DONE if state == USER and initial == "a" else None


def inserted(state: int, n: int) -> int:
    """The state after n inserted turns: the only role that may follow, each time."""
    for _ in range(n):
        state = DONE if state == USER else USER
    return state


def moves(state: int, role: int, fault: int) -> list[tuple[int, int, int]]:
    """(next state, cost, rank of the code) of the macro edits over a row. role: 0 other, else ROLES; fault: place in FAULTS."""
    out = []
    for rank, code in enumerate(CODES):
        n, edit = len(code) - 1, code[-1]
        s, cost, stays = inserted(state, n), INSERT * n, CUT * (fault == 3)
        if edit == "D":
            out.append((s, cost + DELETE, rank))
        elif fault not in (1, 2) and edit == "K" and role:
            out.append((after(s, " sua"[role]), cost + KEEP + stays, rank))
        elif fault not in (1, 2) and edit == "R":
            out.append((inserted(s, 1), cost + REROLE + stays, rank))
    return [m for m in out if m[0] is not None]


class Search:
    """Layers as tuples of (cost above the layer's least, rank) or None, one for each state; transitions are remembered."""

    FIRST = ((0, 0), None, None, None)

    def __init__(self):
        self.known: dict = {}

    def step(self, layer: tuple, role: int, fault: int) -> tuple:
        """(next layer, what to add to costs, parent state and code rank of each state)."""
        found = self.known.get((layer, role, fault))
        if found is None:
            best: dict[int, tuple] = {}
            for state, at in enumerate(layer):
                for to, cost, code in moves(state, role, fault) if at else ():
                    entry = (at[0] + cost, at[1], code, state)
                    best[to] = min(best.get(to, entry), entry)
            low = min(e[0] for e in best.values())
            best = {s: e for s, e in best.items() if e[0] - low <= SLACK}
            order = sorted({(e[1], e[2]) for e in best.values()})
            new = tuple((best[s][0] - low, order.index(best[s][1:3])) if s in best else None for s in range(4))
            back = tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
            found = self.known[layer, role, fault] = new, low, back
        return found

    def run(self, roles: bytes, faults: bytes) -> tuple[int, list[str], int]:
        """Cost, the code of each row, and the turns inserted at the end."""
        layer, cost, pointers = self.FIRST, 0, []
        for role, fault in zip(roles, faults, strict=True):
            layer, low, back = self.step(layer, role, fault)
            cost += low
            pointers.append(back)
        # At the end nothing, one turn or two are inserted.
        ends = [(layer[s][0] + INSERT * n, layer[s][1], n, s) for s, n in ((START, 0), (SYSTEM, 2), (USER, 1), (DONE, 0)) if layer[s]]
        more, _, tail, state = min(ends)
        codes = []
        for back in reversed(pointers):
            state, code = back[state]
            codes.append(CODES[code])
        return cost + more, codes[::-1], tail


def repaired_roles(codes: list[str], tail: int, roles: bytes) -> list[str | None]:
    """For each row the roles to put before it, then its own: 'user', 'assistant', '=' (as it is) or '-' (gone), joined by commas."""
    state, out = START, []

    def add(n: int) -> list[str]:
        nonlocal state
        names = []
        for _ in range(n):
            state = inserted(state, 1)
            names.append("assistant" if state == DONE else "user")
        return names

    for code, role in zip(codes, roles, strict=True):
        names = add(len(code) - 1)
        if code[-1] == "K":
            state = after(state, " sua"[role])
            names.append("=")
        else:
            names += add(1) if code[-1] == "R" else ["-"]
        out.append(",".join(names))
    out.append(",".join(add(tail)))
    return out


def ordered(convs: DataFrame) -> DataFrame:
    """A written table: conv_id, pos (from 1, in the order of the conversation), turn, role, text, key (of role and text)."""
    key = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), 1, 16)
    rows = convs.withColumn("key", key)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "order_role", "order_key")
    names = ("conv_id", "turn", "role", "text", "key")

    def number(batches):
        last, n = b"", 0  # no conv_id
        for batch in batches:
            ids = batch.column("conv_id")
            pos = np.empty(len(ids), np.int64)
            for i, c in enumerate(ids.to_pylist()):
                n = n + 1 if c == last else 1
                last, pos[i] = c, n
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(pos)], [*names, "pos"])

    return materialize(rows.select(*names).mapInArrow(number, "conv_id long, turn long, role string, text string, key binary, pos long"))


def initial_code(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)


def facts(rows: DataFrame) -> DataFrame:
    """conv_id, pos, turn, key, kind (role code and whether blank, whether it ends unfinished) of `ordered` rows: no texts."""
    ends = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    blank, cut = ends == "", ~ends.isin(".", "!", "?")
    return rows.select("conv_id", "pos", "turn", "key", initial_code(F.col("role")).cast("int").alias("role"), F.when(blank, 1).when(cut, 3).otherwise(0).alias("fault"))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDITS = "conv_id long, pos long, roles string"
#: Adjacent role codes that are allowed.
LEGAL = {(1, 2), (2, 3), (3, 2)}


def conversations(batches) -> Iterator[tuple]:
    """(conv_id, columns) of each conversation in sorted batches of facts."""
    last, held = None, []
    for batch in batches:
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False) if not batch.column("conv_id").null_count else np.array(batch.column("conv_id").to_pylist(), object)
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1 if len(ids) else []
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True) if len(ids) else ():
            c = None if ids[a] is None else int(ids[a])
            if held and c != last:
                yield last, held
                held = []
            last = c
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def search(rows: DataFrame) -> DataFrame:
    """A written table of REPORT and, as `edits`, EDITS' (pos, roles) of the rows that change or have turns put before them."""
    f = facts(rows).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches):
        s, out = Search(), []
        for conv, parts in conversations(batches):
            roles = b"".join(p.column("role").to_numpy().astype(np.uint8).tobytes() for p in parts)
            faults = bytearray(b"".join(p.column("fault").to_numpy().astype(np.uint8).tobytes() for p in parts))
            turns = np.concatenate([p.column("turn").drop_null().to_numpy(zero_copy_only=False).astype(np.int64) for p in parts])
            seen = set()
            for i, key in enumerate(k for p in parts for k in p.column("key").to_pylist()):
                if key in seen and faults[i] != 1:
                    faults[i] = 2
                seen.add(key)
            cost, codes, tail = s.run(roles, bytes(faults))
            gaps = int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0
            illegal = sum(p not in LEGAL for p in zip(roles, roles[1:], strict=False))
            edits = [{"pos": i + 1, "roles": x} for i, x in enumerate(repaired_roles(codes, tail, roles)) if x not in ("=", "")]
            out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, "".join(codes) + "I" * tail, edits))
            if len(out) >= 1024 or len(faults) > 1 << 16:
                yield table(out)
                out = []
        if out:
            yield table(out)

    names = [c.split()[0] for c in REPORT.split(", ")]
    types = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.struct([("pos", pa.int64()), ("roles", pa.string())]))]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*names, "edits"])

    return materialize(f.mapInArrow(run, REPORT + ", edits array<struct<pos:long,roles:string>>"))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, pos, k, role, text of the repaired turns, in the order of (pos, k); rows and found of `ordered` and `search`."""
    edits = found.select(F.col("conv_id").alias("in_conv"), F.inline("edits")).select("in_conv", F.col("pos").alias("at"), "roles")
    both = rows.select("conv_id", "pos", "role", "text").join(edits, F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("pos") == F.col("at")), "full")
    turns = both.select(F.coalesce("conv_id", "in_conv").alias("conv_id"), F.coalesce("pos", "at").alias("pos"), "role", "text", F.coalesce("roles", F.lit("=")).alias("roles"), F.col("pos").isNull().alias("end"))
    turns = turns.select("conv_id", "pos", "role", "text", "end", F.size(F.split("roles", ",")).alias("n"), F.posexplode(F.split("roles", ",")).alias("k", "new"))
    own = (F.col("k") == F.col("n") - 1) & ~F.col("end")
    role = F.when(F.col("new") == "=", F.col("role")).otherwise(F.col("new"))
    return turns.where("new <> '-'").select("conv_id", "pos", "k", role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: a stream over the sorted turns of each conversation."""
    t = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches):
        last, h, ids, out = b"", None, [], []
        for batch in batches:
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != last:
                    if h:
                        ids.append(last)
                        out.append(h.hexdigest())
                    last, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
            ids, out = [], []
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return t.mapInArrow(run, "conv_id long, repaired_sha256 string")


def prepared(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) and what orders rows of a turn."""
    small_batches(convs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))
    return rows.withColumns({"order_role": F.col("role"), "order_key": F.sha2("text", 256)})


def damaged(rows: DataFrame) -> DataFrame:
    """`prepared` rows, a quarter of them damaged by the crc32 of conversation and turn: dropped, emptied, cut, repeated, made the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("fate", (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).cast("int")).where("fate <> 0")
    new = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", new).withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def repair(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report (REPORT, edits) of each conversation that has rows, and the repaired turns (conv_id, pos, k, role, text)."""
    rows = ordered(prepared(convs))
    found = search(rows)
    return found, repaired(rows, found)


def digest(convs: DataFrame) -> DataFrame:
    """The rows of query op13_repair: conversations are damaged by a fixed rule, then repaired."""
    start = prepared(convs)
    rows = ordered(damaged(start))
    found = search(rows)
    hashes = materialize(hashed(repaired(rows, found)))
    forget(rows)
    ids = start.select("conv_id").distinct()
    same = lambda df: df.select(F.col("conv_id").alias("in_conv"), *(c for c in df.columns if c != "conv_id"))
    out = ids.join(same(found.drop("edits")), F.col("conv_id").eqNullSafe(F.col("in_conv")), "left").drop("in_conv")
    out = out.join(same(hashes), F.col("conv_id").eqNullSafe(F.col("in_conv")), "left").drop("in_conv")
    numbers = [c.split()[0] for c in REPORT.split(", ")[1:-1]]
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

"""Repair of conversations by rank-convergence parallel Viterbi.

A conversation is read as a row of edits (keep, rerole, delete, insert) whose roles must come out as an
optional system turn followed by pairs of user and assistant turns.  Four states (nothing yet, system,
user, assistant) and the costs of the edits make that a shortest path; costs are computed from the end
backwards as vectors of four numbers, and the path is traced forwards by them: where edits cost the same
the one with the least letter is taken, which gives the least string of all cheapest ones.

Rows are dealt to ranges of (conversation, turn) and cut into chunks of bounded rows and bytes, so one
conversation may span any number of tasks.  The chunks of such a conversation work at the same time.
Each starts from a speculative vector, that of a conversation ending there.  Then fix-up passes hand every
chunk the vector its right neighbour came to; it reruns the old and the new start side by side until the
two differ by a constant only, from where on all choices are the same, and it is not asked again
unless the vector it hands on changed.  What the chunks settle on drives the trace: each says where
its four entry states lead, these steps are composed along the conversation, and rows get their edits.
The number of passes is the longest run of chunks which keep a difference (a run of truncated turns can);
results are exact in any case.  Rows that must be deleted change no choice and take no part in the vectors.

One hash over a conversation's repaired text is a chain, so chunks hand on their repaired text and one task
streams it, a chunk at a time.

Defined cases: nulls in id, turn, role and text are read as one space (a null id is a conversation, null
turns come first and count in no gap); rows of equal turn go by role, then by digest of the text; a role is
known by its first letter, an empty role adds none and may stay anywhere; rows that repeat are duplicates;
a conversation without rows has an empty audit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph.llm.common import SLICE_BYTES, slices, stored
from evgraph.session import cut_lineage

#: Costs of edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: A chunk is closed at so many rows or bytes of text.
CHUNK_ROWS, CHUNK_BYTES = 16_384, 4 << 20

USER, ASSISTANT = "user", "assistant"
START, SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEPS = [
    {"s": SYSTEM, "u": AFTER_USER, "": START}, {"u": AFTER_USER, "": SYSTEM},
    {"a": AFTER_ASSISTANT, "": AFTER_USER}, {"u": AFTER_USER, "": AFTER_ASSISTANT},
]
_FAR = 1 << 40
#: Kinds of rows: first letter of the role (s, u, a, none, other), plus 5 if truncated; then those without choice.
LETTERS = ["s", "u", "a", "", "?"]
BLANK, DUPLICATE, DROPPED = 10, 11, 12
Vector = tuple[int, int, int, int]


def _turned(state: int) -> int:
    """State after the one turn of user or assistant that may follow."""
    return AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER


def _with_inserts(v: list[int]) -> Vector:
    """Costs when turns may be inserted first; two insertions reach every state that can be reached."""
    for _ in range(2):
        v = [min(v[s], INSERT + v[_turned(s)]) for s in range(4)]
    return tuple(v)


END = _with_inserts([0, _FAR, _FAR, 0])


def _edits(kind: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state as (letter, cost, next state), least letter first, without insertions."""
    letter, extra = LETTERS[kind % 5], TRUNCATED * (kind // 5)
    found = [("D", DELETE, state)]
    if letter in STEPS[state]:
        found.append(("K", extra, STEPS[state][letter]))
    found.append(("R", REROLE + extra, _turned(state)))
    return found


_EDITS = [[_edits(k, s) for s in range(4)] for k in range(10)]
_BACK: dict[tuple[int, Vector], tuple[int, Vector]] = {}


def back(kind: int, v: Vector) -> tuple[int, Vector]:
    """Costs before a row from those behind it, as (constant, vector with least entry 0).

    Costs of two states never lie further apart than two insertions and a rerole, so few vectors exist
    and each step is remembered.
    """
    found = _BACK.get((kind, v))
    if found is None:
        new = _with_inserts([min(c + v[t] for _, c, t in _EDITS[kind][s]) for s in range(4)])
        low = min(new)
        found = _BACK[kind, v] = low, tuple(x - low for x in new)
    return found


def backward(kinds: bytes, v: Vector) -> Vector:
    """Vector at the left end of a chunk whose right end has ``v``, up to a constant."""
    for k in reversed(kinds):
        v = back(k, v)[1]
    return v


def fix_up(kinds: bytes, old: Vector, new: Vector, left: Vector) -> Vector:
    """The left vector for a new right one, rerun only until it runs along with the old one.

    Vectors have least entry 0, so those that differ by a constant are equal.
    """
    for k in reversed(kinds):
        if old == new:
            return left
        old, new = back(k, old)[1], back(k, new)[1]
    return new


def trace(kinds: bytes, right: Vector, state: int) -> tuple[list[tuple[int, str, int]], int]:
    """(insertions before, letter, state before the letter) of each row from ``state`` on, and the state reached."""
    vectors = [right]
    consts = [0]
    for k in reversed(kinds):
        low, v = back(k, vectors[-1])
        vectors.append(v)
        consts.append(low)
    out = []
    for i, k in enumerate(kinds):
        after, low, now = vectors[-2 - i], consts[-1 - i], vectors[-1 - i]
        inserted = 0
        while True:
            # Cost still to pay, counted from the least entry behind the row.
            due = low + now[state]
            chosen = None
            for letter, cost, target in _EDITS[k][state]:
                if letter != "D" and chosen is None and INSERT + low + now[_turned(state)] == due:
                    chosen = ("I", _turned(state))
                if chosen is None and cost + after[target] == due:
                    chosen = (letter, target)
            if chosen[0] != "I":
                break
            inserted, state = inserted + 1, chosen[1]
        out.append((inserted, chosen[0], state))
        state = chosen[1]
    return out, state


def closing(state: int) -> list[str]:
    """Roles inserted after the last row."""
    roles = []
    while state not in (START, AFTER_ASSISTANT):
        roles.append(ASSISTANT if state == AFTER_USER else USER)
        state = _turned(state)
    return roles


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the damage of the registered query: a checksum drops, empties, cuts, repeats or reroles them.

    Dropped rows stay as ``dropped``, so that their conversation is known.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    what = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    text = F.when(what == 1, "").when(what == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(what == 4, USER).otherwise(role)
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (what == 0).alias("dropped"), (what == 3).alias("twice"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("twice"), 2).otherwise(1)))
    return d.select("conv_id", "turn", "role", "text", "dropped", copies.alias("__copy")).drop("__copy")


def _kind(role: Column, text: Column, dropped: Column) -> Column:
    """Kind of a row, but for duplicates."""
    bare = F.btrim(text, F.lit(SPACE))
    first = F.substring(role, 1, 1)
    letter = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).when(first == "", 3).otherwise(4)
    cut = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    return F.when(dropped, DROPPED).when(bare == "", BLANK).otherwise(letter + F.when(cut, 5).otherwise(0))


_ROW = "rid long, chunk long, conv_id long, turn long, role string, text string, digest binary, kind int"


def _chunked(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Rows in order with their number (``rid``) and chunk, written as a table.

    A range of rows is a task; a chunk ends where a conversation does once it is full, or within a
    conversation that fills one alone.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        rid = chunk = part
        conv, rows_in, bytes_in, own_rows, own_bytes, begun = None, 0, 0, 0, 0, False
        for b in slices(batches, "text"):
            rids, chunks = [], []
            sizes = b.column(3).cast(pa.binary()).to_pylist()
            for c, t in zip(b.column(0).to_pylist(), sizes):
                if not begun or c != conv:
                    own_rows = own_bytes = 0
                    if rows_in >= chunk_rows or bytes_in >= chunk_bytes:
                        chunk, rows_in, bytes_in = chunk + 1, 0, 0
                elif own_rows >= chunk_rows or own_bytes >= chunk_bytes:
                    chunk, rows_in, bytes_in, own_rows, own_bytes = chunk + 1, 0, 0, 0, 0
                conv, begun = c, True
                rows_in, bytes_in, own_rows, own_bytes = rows_in + 1, bytes_in + len(t), own_rows + 1, own_bytes + len(t)
                rids.append(rid)
                chunks.append(chunk)
                rid += 1
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(chunks, pa.int64()), *b.columns], ["rid", "chunk", *b.schema.names])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "digest", "__row"]
    d = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "dropped").withColumns({
        "digest": F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), "kind": _kind(F.col("role"), F.col("text"), F.col("dropped")),
        "__row": F.monotonically_increasing_id()})
    d = d.withColumn("text", F.when(F.col("dropped"), "").otherwise(F.col("text")))
    d = d.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return stored(d.select("conv_id", "turn", "role", "text", "digest", "kind").mapInArrow(number, _ROW))


def _firsts(rows: DataFrame) -> DataFrame:
    """rid, chunk of the first row with each role and text of a conversation."""
    seen = rows.filter(F.col("kind") < BLANK)
    least = F.min(F.struct("rid", "chunk")).alias("m")
    return seen.groupBy("conv_id", "role", "digest").agg(least).select("m.rid", "m.chunk")


def _streamed(rows: DataFrame, firsts: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Rows by chunk and order, each first of its role and text behind a marker, what ``head`` has for a chunk in front."""
    a = rows.select("chunk", "rid", F.lit(1).alias("row"), "conv_id", "turn", "role", "text", "kind")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"), ("kind", "int"))]
    d = a.unionByName(firsts.select("chunk", "rid", F.lit(0).alias("row"), *none))
    d = d if head is None else d.unionByName(head)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(n, "chunk").sortWithinPartitions("chunk", "rid", "row")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int | None, int], list[tuple]]]:
    """((conversation, chunk), rows) of a stream; rows are (kind, turn, role, text)."""
    key, rows, first = None, [], None
    for b in slices(batches, "text"):
        for chunk, rid, row, conv, turn, role, text, kind in zip(*[b.column(i).to_pylist() for i in range(8)]):
            if not row:
                first = rid
                continue
            if key != (conv, chunk):
                if key is not None:
                    yield key, rows
                key, rows = (conv, chunk), []
            rows.append((kind if kind >= BLANK or first == rid else DUPLICATE, turn, role, text))
    if key is not None:
        yield key, rows


def _settled(spans: DataFrame) -> DataFrame:
    """conv_id, chunk, right, state: the vector behind and the state before each chunk of conversations that span chunks.

    ``spans`` has conv_id, chunk, kinds (a byte per row with a choice).
    """
    kinds = "conv_id long, chunk long, next_chunk long, kinds binary, right string, left string, moved boolean"

    def read(v: str) -> Vector:
        return tuple(map(int, v.split(",")))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [",".join(map(str, backward(k, END))) for k in b.column(3).to_pylist()]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([",".join(map(str, END))] * n, pa.string()), pa.array(left, pa.string()), pa.array([True] * n)],
                ["conv_id", "chunk", "next_chunk", "kinds", "right", "left", "moved"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rights, lefts, moved = [], [], []
            for k, old, left, new in zip(*[b.column(i).to_pylist() for i in (3, 4, 5, 7)]):
                now = left if new is None or new == old else ",".join(map(str, fix_up(k, read(old), read(new), read(left))))
                rights.append(old if new is None else new)
                lefts.append(now)
                moved.append(now != left)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(rights, pa.string()), pa.array(lefts, pa.string()), pa.array(moved, pa.bool_())],
                ["conv_id", "chunk", "next_chunk", "kinds", "right", "left", "moved"])

    # The chunk to the right: numbers ascend, but ranges without the conversation lie between.
    after = F.lead("chunk").over(W.partitionBy("conv_id").orderBy("chunk"))
    state = cut_lineage(spans.select("conv_id", "chunk", after.alias("next_chunk"), "kinds").mapInArrow(begin, kinds))
    while True:
        handed = state.select(F.col("conv_id").alias("__c"), F.col("chunk").alias("__k"), F.col("left").alias("new"))
        met = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("next_chunk") == F.col("__k"))
        state = cut_lineage(state.join(handed, met, "left").drop("__c", "__k").mapInArrow(again, kinds))
        if state.filter("moved").isEmpty():
            break

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [[trace(k, read(v), s)[1] for s in range(4)] for k, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(to, pa.list_(pa.int32()))], ["conv_id", "chunk", "right", "to"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state_, begun = None, START, False
        for b in batches:
            states = []
            for c, to in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if not begun or c != conv:
                    conv, state_, begun = c, START, True
                states.append(state_)
                state_ = to[state_]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(states, pa.int32())], ["conv_id", "chunk", "right", "state"])

    steps = state.select("conv_id", "chunk", "kinds", "right").mapInArrow(lead, "conv_id long, chunk long, right string, to array<int>")
    return steps.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(
        enter, "conv_id long, chunk long, right string, state int")


_PART = ("conv_id long, chunk long, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, "
         "illegal long, cost long, audit string, initials string, state int, n long, repaired binary, repaired_sha256 string")


def _part(rows: list[tuple], right: Vector, state: int, last: bool) -> dict:
    """What the rows of a conversation in one chunk come to; ``last`` where the conversation ends with them."""
    rows = [r for r in rows if r[0] != DROPPED]
    kinds = bytes(r[0] for r in rows if r[0] < BLANK)
    path, end = trace(kinds, right, state)
    audit, out, cost, steps = [], [], 0, iter(path)
    for kind, _, role, text in rows:
        if kind >= BLANK:
            audit.append("D")
            cost += DELETE
            continue
        inserted, letter, at = next(steps)
        for i in range(inserted):
            # The row's own state follows all insertions; the first of two turns the role round.
            out.append((ASSISTANT if (at == AFTER_ASSISTANT) == ((inserted - i) % 2 == 1) else USER) + ":")
        audit.append("I" * inserted + letter)
        cost += inserted * INSERT + {"D": DELETE, "K": 0, "R": REROLE}[letter] + (TRUNCATED if kind >= 5 and letter != "D" else 0)
        if letter != "D":
            name = role if letter == "K" else (ASSISTANT if at == AFTER_USER else USER)
            out.append(f"{name}:{text}")
    if last:
        roles = closing(end)
        audit.append("I" * len(roles))
        cost += len(roles) * INSERT
        out += [r + ":" for r in roles]
    known = [r[1] for r in rows if r[1] is not None]
    first = [r[2][:1] for r in rows]
    return {
        "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
        "blank": sum(r[0] == BLANK for r in rows), "duplicate": sum(r[0] == DUPLICATE for r in rows),
        "truncated": sum(5 <= r[0] < BLANK for r in rows), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
        "cost": cost, "audit": "".join(audit), "initials": f"{first[0] or '-'}{first[-1] or '-'}" if rows else "",
        "state": end, "n": len(out), "text": "\n".join(out).encode(),
    }


def _parts(rows: DataFrame, firsts: DataFrame, settled: DataFrame, spanning: DataFrame) -> DataFrame:
    """One row per conversation and chunk: a finished one, or one with its repaired text where the conversation spans chunks."""
    given = settled.join(spanning.select(F.col("conv_id").alias("__c"), "last"), F.col("conv_id").eqNullSafe(F.col("__c"))).select(
        "conv_id", "chunk", "right", "state", (F.col("chunk") == F.col("last")).alias("ends"))
    # What was settled travels in front of its chunk, in the columns of a row.
    head = given.select("chunk", F.lit(-1).cast("long").alias("rid"), (F.lit(2) + F.col("ends").cast("int")).alias("row"), "conv_id",
                        F.col("state").cast("long").alias("turn"), F.col("right").alias("role"), F.lit("").alias("text"), F.lit(None).cast("int").alias("kind"))
    stream = _streamed(rows, firsts, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_: dict[tuple, tuple[Vector, int, bool]] = {}

        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(2).to_pylist()
                if max(row, default=0) >= 2:
                    for i, r in enumerate(row):
                        if r >= 2:
                            v = tuple(map(int, batch.column(5)[i].as_py().split(",")))
                            given_[batch.column(3)[i].as_py(), batch.column(0)[i].as_py()] = v, batch.column(4)[i].as_py(), r == 3
                    batch = batch.filter(pa.array([r < 2 for r in row]))
                yield batch

        out, size = [], 0
        for key, found in _segments(plain()):
            whole = key not in given_
            right, state, last = given_.pop(key, (END, START, True))
            part = _part(found, right, state, last)
            text = part.pop("text")
            part |= {"conv_id": key[0], "chunk": key[1], "whole": whole, "repaired": None if whole else text,
                     "repaired_sha256": hashlib.sha256(text).hexdigest() if whole else None}
            out.append(part)
            size += 200 + len(part["audit"]) + (0 if whole else len(text))
            if size >= SLICE_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _PART.split(", ")])
    return stream.mapInArrow(run, _PART)


_SUMS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string")


def _merged(parts: DataFrame) -> DataFrame:
    """Conversations that span chunks: sums, joined audit and one hash, a chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, total, begun = None, {}, False

        def finished() -> pa.RecordBatch:
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            row = {"conv_id": conv, "gaps": gaps, **{c: total[c] for c in _SUMS}, "audit": "".join(total["audit"]),
                   "repaired_sha256": total["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if not begun or r["conv_id"] != conv:
                    if begun:
                        yield finished()
                    conv, begun = r["conv_id"], True
                    total = {"low": None, "high": None, "turns": 0, "audit": [], "hash": hashlib.sha256(), "initial": "", "n": 0} | dict.fromkeys(_SUMS, 0)
                for c in _SUMS:
                    total[c] += r[c]
                if r["low"] is not None:
                    total["turns"] += r["turns"] - (total["high"] == r["low"])
                    total["low"] = r["low"] if total["low"] is None else total["low"]
                    total["high"] = r["high"]
                if r["initials"]:
                    if total["initial"] and total["initial"] + r["initials"][0] not in ("su", "ua", "au"):
                        total["illegal"] += 1
                    total["initial"] = r["initials"][1]
                total["audit"].append(r["audit"])
                if r["n"]:
                    total["hash"].update((b"\n" if total["n"] else b"") + r["repaired"])
                    total["n"] += r["n"]
        if begun:
            yield finished()

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _OUT.split(", ")])
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, _OUT)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation.

    ``rows`` has conv_id, turn, role, text, dropped, as :func:`damaged` gives them.
    """
    d = _chunked(rows, chunk_rows, chunk_bytes)
    firsts = _firsts(d)
    ends = d.select("conv_id", "chunk").groupBy("conv_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    spanning = cut_lineage(ends.filter(F.col("first") < F.col("last")))
    within = spanning.select(F.col("conv_id").alias("__c"))
    some = d.join(within, F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), found in _segments(batches):
            kinds = bytes(r[0] for r in found if r[0] < BLANK)
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "kinds": pa.array([kinds], pa.binary())})

    spans = _streamed(some.withColumn("text", F.lit("")), _firsts(some)).mapInArrow(coded, "conv_id long, chunk long, kinds binary")
    parts = stored(_parts(d, firsts, _settled(spans), spanning))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = parts.filter("whole").select("conv_id", gaps, *_SUMS, "audit", "repaired_sha256")
    return whole.unionByName(_merged(parts.filter("NOT whole")))

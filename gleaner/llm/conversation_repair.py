"""Conversation structure repair: the cheapest edits that make roles alternate.

A repaired conversation is empty, or an optional system turn followed by pairs
of a user and an assistant turn.  Rows are kept (0), given the role that is due
(1), deleted (2; blank and repeated ones always are), or an empty turn of the
role that is due is inserted (5); a truncated row that stays adds 5.  Among the
cheapest edits the audit string (their initials, in order) that is least in
ASCII is taken.

Two passes.  The first moves no texts: rows become a turn, a role, a fault and
a digest, are dealt by conversation and sorted.  In a task, conversations of
about one length form a time-major tensor: costs to go for each turn,
conversation and state are computed backwards, all conversations of a turn at
once, and stored; edits are then traced forwards, one step of all conversations
at a time.  The second pass deals the texts by conversation in the same order,
each conversation's edits before its rows, and digests the repaired rows as
they stream by.

A task holds some 100 bytes for each row of the conversation that it works on,
which is of the order of its audit string, and no texts but those of a batch.
A digest is sequential, so one task reads the texts of one conversation.

Edge cases.  A null role or text is one space, and so is a null id or turn in
the key of the damage; null turns come first and don't count as turns.  Rows of
one turn are ordered by role, then by the MD5 of role and text.  Rows that
repeat role and text are duplicates after the first, in whatever turn.  A role
whose first letter isn't s, u or a, or that is empty, is never legal.  Rows
without a conversation id are one conversation.  Long texts are read whole.
Conversations whose rows are all damaged away are repaired to nothing.  Other
columns are not read, so none can clash.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, input_columns, package_on_workers, pinned, released

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Cells of a tensor: turns times conversations.
CELLS = 1 << 20

#: Roles by their initials; others are 3.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: States by the turn before: none, system, user, assistant.
NONE, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state after the role that is due.
DUE = np.array([AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER])
#: The state after a row that is kept, by state and role; -1 where it isn't legal.
KEPT = np.array([[AFTER_SYSTEM, AFTER_USER, -1, -1], [-1, AFTER_USER, -1, -1], [-1, -1, AFTER_ASSISTANT, -1], [-1, AFTER_USER, -1, -1]])
FINE, BLANK, DUPLICATE, CUT = range(4)
_NEVER = 1 << 40

ROW = "conv_id", "turn", "role", "text"
_COUNTS = ("rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame, *, of: int = 20) -> DataFrame:
    """conv_id, turn, role, text, lost of conversations after damage that
    follows from crc32(conv_id:turn): rows that are dropped stay, as lost; a
    row that is repeated comes twice."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % of
    rows = rows.select(*input_columns(rows, **dict(zip(ROW, ROW)))).select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), times.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """With a digest of role and text, which also orders the rows of a turn."""
    both = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.md5(both.cast("binary"))))


def codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, lost, role, fault and first (of its conversation) of each
    row, dealt by conversation and in order; no texts."""
    bare = F.btrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(*".!?"), FINE).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    turn = F.asc_nulls_first("turn")
    short = _keyed(rows).select("conv_id", "turn", "lost", F.col("role").alias("name"), role.alias("role"), fault.alias("fault"), "digest").repartition("conv_id")
    # Rows that are lost come last, so that none of them counts as seen before.
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("lost", turn)) > 1
    order = Window.partitionBy("conv_id").orderBy("lost", turn, "name", "digest", "seen")
    fault = F.when((F.col("fault") != BLANK) & F.col("seen"), DUPLICATE).otherwise(F.col("fault"))
    return short.withColumn("seen", seen).withColumn("first", F.row_number().over(order) == 1).select("conv_id", F.col("turn").cast("long").alias("turn"), "lost", F.col("role").cast("byte").alias("role"), fault.cast("byte").alias("fault"), "first")


def _backward(role: np.ndarray, fault: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Costs to go [turns + 1, conversations, 4] of a time-major bucket."""
    turns, n = role.shape
    cost = np.empty((turns + 1, n, 4), np.int64)
    cost[turns] = end = np.array([0, 2 * INSERT, INSERT, 0])
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        here = after + DELETE
        stays = np.where(fault[t] == CUT, TRUNCATED, 0) + np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), _NEVER, 0)
        for state in range(4):
            to = KEPT[state][role[t]]
            kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0)[:, None], 1)[:, 0], _NEVER)
            here[:, state] = np.minimum(here[:, state], stays + np.minimum(kept, RETYPE + after[:, DUE[state]]))
        # At most two turns are inserted in a row; more come back to a state.
        user, assistant = here[:, AFTER_USER].copy(), here[:, AFTER_ASSISTANT].copy()
        here[:, AFTER_USER] = np.minimum(user, assistant + INSERT)
        here[:, AFTER_ASSISTANT] = np.minimum(assistant, user + INSERT)
        for state in (NONE, AFTER_SYSTEM):
            here[:, state] = np.minimum(here[:, state], here[:, AFTER_USER] + INSERT)
        cost[t] = np.where((t < size)[:, None], here, end)
    return cost


def _traced(cost: np.ndarray, role: np.ndarray, fault: np.ndarray, size: np.ndarray) -> list[str]:
    """The audit strings: at each step the least letter that costs no more."""
    turns, n = role.shape
    each = np.arange(n)
    at, state = np.zeros(n, np.int64), np.full(n, NONE)
    letters: list[np.ndarray] = []
    while True:
        more = at < size
        busy = more | (state == AFTER_SYSTEM) | (state == AFTER_USER)
        if not busy.any():
            break
        # Of conversations that are through, row 0 is looked at and not used.
        row = np.where(more, at, 0)
        goal, after = cost[at, each, state], cost[row + 1, each]
        stays = np.where(fault[row, each] == CUT, TRUNCATED, 0)
        may = more & np.isin(fault[row, each], (FINE, CUT))
        to, due = KEPT[state, role[row, each]], DUE[state]
        delete = more & (after[each, state] + DELETE == goal)
        insert = busy & ~delete & (cost[at, each, due] + INSERT == goal)
        keep = may & ~delete & ~insert & (to >= 0)
        keep &= after[each, np.maximum(to, 0)] + stays == goal
        retype = busy & ~delete & ~insert & ~keep
        letters.append(np.select([delete, insert, keep, retype], [ord("D"), ord("I"), ord("K"), ord("R")], 0).astype(np.uint8))
        state = np.where(insert | retype, due, np.where(keep, to, state))
        at = at + (busy & ~insert)
    table = np.array(letters, np.uint8).reshape(len(letters), n).T
    return [row[row > 0].tobytes().decode() for row in table]


def solve(role: np.ndarray, fault: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Costs and audits of conversations that lie one after another; ends[i] is
    where conversation i begins, ends[i + 1] where it ends."""
    size = np.diff(ends)
    costs, audits = np.zeros(len(size), np.int64), [""] * len(size)
    # Buckets hold lengths from a power of two to the next.
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for b in np.unique(bucket[size > 0]):
        members = np.flatnonzero((bucket == b) & (size > 0))
        step = max(1, CELLS >> int(b))
        for some in (members[k : k + step] for k in range(0, len(members), step)):
            turns = int(size[some].max())
            place = ends[some][None, :] + np.arange(turns)[:, None]
            place = np.minimum(place, ends[-1] - 1)
            r, f = role[place], fault[place]
            cost = _backward(r, f, size[some])
            costs[some] = cost[0, :, NONE]
            for i, audit in zip(some, _traced(cost, r, f, size[some])):
                audits[i] = audit
    return costs, audits


def _judged(rows: pa.Table) -> pa.RecordBatch:
    """The results of whole conversations."""
    column = lambda c: rows.column(c).to_numpy()
    starts = np.flatnonzero(column("first"))
    conv = np.cumsum(column("first")) - 1
    known = rows.column("turn").is_valid().to_numpy()
    turn = rows.column("turn").fill_null(0).to_numpy()
    here = ~column("lost")
    role, fault, n = column("role").astype(np.int64)[here], column("fault")[here], len(starts)
    count = lambda at: np.bincount(at, minlength=n)
    ends = np.append(0, np.cumsum(count(conv[here])))
    turn, known, conv = turn[here], known[here], conv[here]
    same = conv[1:] == conv[:-1]
    # Turns ascend within a conversation: the distinct ones are where they change.
    new = known.copy()
    new[1:] &= ~(same & known[:-1] & (turn[1:] == turn[:-1]))
    low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    seen = np.flatnonzero(known)
    low[conv[seen[::-1]]] = turn[seen[::-1]]
    high[conv[seen]] = turn[seen]
    pairs = role[:-1] * 4 + role[1:]
    legal = np.isin(pairs, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
    cost, audit = solve(role, fault, ends)
    found = {
        "rows": np.diff(ends), "gaps": high - low + 1 - count(conv[new]),
        "blank": count(conv[fault == BLANK]), "duplicate": count(conv[fault == DUPLICATE]), "truncated": count(conv[fault == CUT]),
        "illegal": count(conv[1:][same & ~legal]), "cost": cost,
    }
    columns = [rows.column("conv_id").take(pa.array(starts)).combine_chunks(), *(pa.array(found[c], pa.int64()) for c in _COUNTS), pa.array(audit, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_COUNTS, "audit"])


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit of
    every conversation of rows (conv_id, turn, role, text, lost)."""
    package_on_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # a conversation goes on in the next batch
        for batch in filter(len, batches):
            starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1]):
                yield _judged(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]))
                held = []
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held:
            yield _judged(pa.Table.from_batches(held))

    kind = rows.schema["conv_id"].dataType.simpleString()
    return codes(rows).mapInArrow(released(run), ", ".join([f"conv_id {kind}", *(f"{c} long" for c in _COUNTS), "audit string"]))


class _Repair:
    """The digest of one conversation, row by row."""

    def __init__(self, audit: str):
        self._audit, self._at, self._state = audit, 0, NONE
        self._sha, self._empty = hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self._sha.update((f"{role}:{text}" if self._empty else f"\n{role}:{text}").encode())
        self._empty = False

    def _due(self) -> str:
        self._state = int(DUE[self._state])
        return "user" if self._state == AFTER_USER else "assistant"

    def _insert(self) -> None:
        while self._audit[self._at : self._at + 1] == "I":
            self._put(self._due(), "")
            self._at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self._audit[self._at]
        self._at += 1
        if edit == "R":
            self._put(self._due(), text)
        elif edit == "K":
            self._put(role, text)
            self._state = int(KEPT[self._state, "sua".index(role[0])])

    def digest(self) -> str:
        self._insert()
        return self._sha.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of every conversation of rows (conv_id, turn, role, text,
    and lost: rows that only name their conversation)."""
    results = pinned(judged(rows))
    kind = rows.schema["conv_id"].dataType.simpleString()
    result = F.struct(*_COUNTS, "audit")
    none = lambda of: F.lit(None).cast(of)
    texts = _keyed(rows.where("not lost")).select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text", "digest", none(results.select(result.alias("r")).schema["r"].dataType).alias("result"))
    heads = results.select("conv_id", F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("digest"), result.alias("result"))
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, own = None, None  # the conversation at hand: its line of results
        for batch in batches:
            done, digests = [own] if own is not None else [], []
            part = batch.column("part").to_pylist()
            for i, (role, text) in enumerate(zip(batch.column("role"), batch.column("text"))):
                if part[i]:
                    open_.row(role.as_py(), text.as_py())
                    continue
                if open_ is not None:
                    digests.append(open_.digest())
                own = batch.slice(i, 1).select(["conv_id", "result"])
                open_ = _Repair(own.column("result")[0]["audit"].as_py())
                done.append(own)
            if digests:
                yield _line(done[: len(digests)], digests)
        if own is not None:
            yield _line([own], [open_.digest()])

    fields = ", ".join([f"conv_id {kind}", *(f"{c} long" for c in _COUNTS), "audit string", "repaired_sha256 string"])
    return both.select("conv_id", "part", "role", "text", "result").mapInArrow(released(run), fields)


def _line(results: list[pa.RecordBatch], digests: list[str]) -> pa.RecordBatch:
    table = pa.Table.from_batches(results).combine_chunks()
    fields = table.column("result").combine_chunks().flatten()
    return pa.RecordBatch.from_arrays([table.column("conv_id").combine_chunks(), *fields, pa.array(digests)], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

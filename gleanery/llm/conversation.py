"""Repair of conversation structure by the cheapest edits, found by a Viterbi search that streams.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles: a system turn if any, then user and
assistant in turn. The search keeps one survivor per state (nothing said yet, after system, after user, after
assistant). Survivors are leaves of a backpointer tree whose nodes count who refers to them; as soon as all survivors
descend from one node, the edits up to it are certain, leave the tree and are handed on with their rows. So memory
holds the open part of one conversation only, however long it is, and a task sees its rows as a stream.

Among equal costs the smallest text of edits wins, compared whole: texts of survivors never are prefixes of each other
(each ends with an edit of the same row), so their order is kept as a rank and settles every later tie.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.ordering import null_safe_join

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What a row cut off in mid-sentence costs beyond its edit, unless it is deleted.
TRUNCATED_COST = 3
#: Numbers of the faults; 0 is none.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: The states reached from a state by inserts alone.
_INSERTS = {
    _NOTHING: ((_NOTHING, ""), (_USER, "I"), (_ASSISTANT, "II")), _SYSTEM: ((_SYSTEM, ""), (_USER, "I"), (_ASSISTANT, "II")),
    _USER: ((_USER, ""), (_ASSISTANT, "I")), _ASSISTANT: ((_ASSISTANT, ""), (_USER, "I")),
}
#: The state after a turn with an initial.
_AFTER = {
    (_NOTHING, "s"): _SYSTEM, (_NOTHING, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: How much dearer than another state's survivor a state's survivor may be and still win: what the other pays at
#: most to do the same from there on.
_SLACK = {
    _NOTHING: {_SYSTEM: 6, _USER: 7, _ASSISTANT: 4}, _SYSTEM: {_NOTHING: 0, _USER: 3, _ASSISTANT: 0},
    _USER: {_NOTHING: 3, _SYSTEM: 3, _ASSISTANT: 3}, _ASSISTANT: {_NOTHING: 0, _SYSTEM: 6, _USER: 3},
}
_NORMAL = {("s", "u"), ("u", "a"), ("a", "u")}


@cache
def _moves(state: int, initial: str, fault: int) -> tuple[tuple[int, int, str], ...]:
    """(next state, cost, edits) of all ways to take a row from a state, inserts before it included."""
    out, more = [], TRUNCATED_COST if fault == TRUNCATED else 0
    for at, inserts in _INSERTS[state]:
        paid = COST[INSERT] * len(inserts)
        out.append((at, paid + COST[DELETE], inserts + DELETE))
        if fault in (BLANK, DUPLICATE):
            continue
        if (at, initial) in _AFTER:
            out.append((_AFTER[at, initial], paid + COST[KEEP] + more, inserts + KEEP))
        for letter in "ua":
            if (at, letter) in _AFTER:
                out.append((_AFTER[at, letter], paid + COST[REROLE] + more, inserts + REROLE))
    return tuple(out)


class _Node:
    """The edits of one row on one survivor's path. ``refs``: nodes and survivors that refer to it."""

    __slots__ = ("parent", "edits", "state", "refs", "kids")

    def __init__(self, parent: _Node | None, edits: str, state: int):
        self.parent, self.edits, self.state, self.refs, self.kids = parent, edits, state, 0, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)


class Viterbi:
    """The search over one conversation. ``push`` and ``finish`` return the edits that have become certain, one item
    per row in order: (edits, state before them, state after them)."""

    def __init__(self):
        self.root = _Node(None, "", _NOTHING)
        self.root.refs = 1
        #: (cost, node) by ascending text of edits
        self.survivors = [(0, self.root)]
        self.open = 0

    def push(self, initial: str, fault: int) -> list[tuple[str, int, int]]:
        best: dict[int, tuple[int, int, str]] = {}
        for rank, (cost, node) in enumerate(self.survivors):
            for state, more, edits in _moves(node.state, initial, fault):
                found = (cost + more, rank, edits)
                if state not in best or found < best[state]:
                    best[state] = found
        kept = [
            (rank, edits, cost, state) for state, (cost, rank, edits) in best.items()
            if not any(cost > best[other][0] + slack for other, slack in _SLACK[state].items() if other in best)]
        return self._advance([(cost, self.survivors[rank][1], edits, state) for rank, edits, cost, state in sorted(kept)])

    def finish(self) -> list[tuple[str, int, int]]:
        """The rest of the edits; those after the last row come as a last item."""
        ends = [
            (cost + COST[INSERT] * len(edits), rank, edits, state) for rank, (cost, node) in enumerate(self.survivors)
            for state, edits in _INSERTS[node.state] if state in (_NOTHING, _ASSISTANT)]
        cost, rank, edits, state = min(ends)
        return self._advance([(cost, self.survivors[rank][1], edits, state)])

    def _advance(self, chosen: list[tuple[int, _Node, str, int]]) -> list[tuple[str, int, int]]:
        before, self.survivors = self.survivors, []
        for cost, node, edits, state in chosen:
            new = _Node(node, edits, state)
            new.refs = 1
            self.survivors.append((cost, new))
        self.open += 1
        for _, node in before:
            self._release(node)
        certain = []
        while self.root.refs == 1 and len(self.root.kids) == 1:
            child = self.root.kids[0]
            certain.append((child.edits, self.root.state, child.state))
            child.parent, self.root = None, child
        self.open -= len(certain)
        return certain

    @staticmethod
    def _release(node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            node = parent


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with planted faults by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes
    its ``.!?``, 3 repeats it, 4 makes it the user's. A null is one space, but a null turn or conv_id stays null."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    kind = F.col("__kind")
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("__kind"))
        .filter(kind != 0)
        .select(
            "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"))
        .drop("__copy")
    )


def _is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def find_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``fault`` (0 none, else BLANK, DUPLICATE or TRUNCATED, the first that holds).

    A row is a duplicate if its role and text stand in an earlier turn of its conversation; repeats within one
    turn are told apart where the rows stream by. Which texts repeat is an aggregate over digests that combines before
    the shuffle, so neither a long conversation nor a phrase said all over meets in one task.
    """
    rows = rows.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("__digest"))
    said = rows.groupBy("conv_id", "role", "__digest").agg(
        F.min("turn").alias("__first"), F.max(F.col("turn").isNull()).alias("__null"), F.count("*").alias("__n")).filter("__n > 1")
    rows = null_safe_join(rows, said, ["conv_id", "role", "__digest"], "left")
    earlier = F.when(F.col("__null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("__first"))
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = (
        F.when(_is_blank(F.col("text")), F.lit(BLANK)).when(F.coalesce(earlier, F.lit(False)), F.lit(DUPLICATE))
        .when(ended, F.lit(0)).otherwise(F.lit(TRUNCATED)))
    return rows.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"))


_EDITS = "place long, edit string, turn long, role string, text string, fault int, breaks boolean, last boolean"
_BATCH_ROWS, _BATCH_CHARS = 4_096, 4 << 20


class _Repair:
    """Rows of conversations in, edits out."""

    def __init__(self, key: pa.DataType):
        self.key, self.search = key, None
        self.out: list[tuple] = []
        self.chars = 0

    def start(self, conv) -> None:
        self.conv, self.search, self.waiting, self.place, self.previous = conv, Viterbi(), deque(), 0, None

    def row(self, turn, role: str, text: str, fault: int) -> None:
        if self.previous is not None and fault != BLANK and self.previous[:3] == (turn, role, text):
            fault = DUPLICATE
        breaks = self.previous is not None and (self.previous[1][:1], role[:1]) not in _NORMAL
        self.previous = (turn, role, text)
        self.waiting.append((turn, role, text, fault, breaks))
        self.settle(self.search.push(role[:1], fault))
        if self.waiting and all(node.edits.endswith(DELETE) for _, node in self.search.survivors):
            self.waiting[-1] = (turn, role, None, fault, breaks)  # gone whichever survivor wins

    def settle(self, certain: list[tuple[str, int, int]]) -> None:
        for edits, state, after in certain:
            for edit in edits:
                if edit == INSERT:
                    state = _USER if state in (_NOTHING, _SYSTEM, _ASSISTANT) else _ASSISTANT
                    self.emit(edit, None, _ROLE[state], "", None, None)
                    continue
                turn, role, text, fault, breaks = self.waiting.popleft()
                if edit == REROLE:
                    role = _ROLE[after]
                self.emit(edit, turn, role, None if edit == DELETE else text, fault, breaks)

    def emit(self, edit, turn, role, text, fault, breaks) -> None:
        self.out.append((self.conv, self.place, edit, turn, role, text, fault, breaks, False))
        self.place += 1
        self.chars += len(text or "")

    def end(self) -> None:
        if self.search is not None:
            self.settle(self.search.finish())
            self.out[-1] = (*self.out[-1][:-1], True)

    def batch(self, final: bool = False) -> pa.RecordBatch:
        """What has been put out; but for the final batch the newest row stays, as it may turn out to be the last."""
        kinds = [self.key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
        names = ["conv_id", "place", "edit", "turn", "role", "text", "fault", "breaks", "last"]
        cut = len(self.out) if final else len(self.out) - 1
        columns = list(zip(*self.out[:cut], strict=True)) if cut > 0 else [()] * len(names)
        self.out, self.chars = self.out[cut:], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repair(rows: DataFrame) -> DataFrame:
    """One row per edit: conv_id, ``place`` (from 0), ``edit`` (K, R, D or I), turn, role and text after the edit (text null
    if deleted), the row's ``fault``, ``breaks`` (its initial cannot follow the one before it) and ``last``.

    ``rows``: conv_id, turn, role, text. A conversation is read by turn, nulls first; rows of one turn by role and
    text. A null role or text counts as one space; a role without a legal initial can only be changed or deleted. Rows of
    a null conv_id are one conversation. Other columns are left out; an empty table gives an empty result. Edits of a
    conversation stand together and in order within a partition.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    marked = find_faults(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *texts))
    kind = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, now = None, None
        for batch in batches:
            if work is None:
                work = _Repair(batch.schema.field("conv_id").type)
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if work.search is None or conv != now:
                    work.end()
                    work.start(conv)
                    now = conv
                work.row(turn, role, text, fault)
                if len(work.out) >= _BATCH_ROWS or work.chars >= _BATCH_CHARS:
                    yield work.batch()
        if work is not None:
            work.end()
            yield work.batch(final=True)

    placed = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(run, f"conv_id {kind}, {_EDITS}")


def summarize(edits: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of the repaired turns.

    ``edits`` as ``repair`` gives them: each conversation together and in order. Only counters, the digest's state
    and the text of edits are held.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, count, edit_text, turns, said = hashlib.sha256(), [0] * 6, [], None, False
        for batch in batches:
            done = []
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "edit", "turn", "role", "text", "fault", "breaks", "last"))
            for conv, edit, turn, role, text, fault, breaks, last in zip(*columns, strict=True):
                edit_text.append(edit)
                count[5] += COST[edit] + (TRUNCATED_COST if fault == TRUNCATED and edit != DELETE else 0)
                if edit != DELETE:
                    digest.update(f"{chr(10) if said else ''}{role}:{text}".encode())
                    said = True
                if edit != INSERT:
                    if fault:
                        count[fault] += 1
                    count[4] += breaks
                    if turn is not None:
                        turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
                if last:
                    if turns is not None:
                        count[0] = turns[1] - turns[0] + 1 - turns[2]
                    done.append((conv, *count, "".join(edit_text), digest.hexdigest()))
                    digest, count, edit_text, turns, said = hashlib.sha256(), [0] * 6, [], None, False
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            found = list(zip(*done, strict=True)) if done else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=["conv_id", *numbers, "audit", "repaired_sha256"])

    return edits.mapInArrow(run, f"conv_id {kind}, {', '.join(n + ' long' for n in numbers)}, audit string, repaired_sha256 string")


def repaired_conversations(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The summary of ``rows`` for every conv_id of ``original``; one without rows has zeros, no edits and the digest of
    the empty string."""
    found = null_safe_join(original.select("conv_id").distinct(), summarize(repair(rows)), ["conv_id"], "left")
    return found.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna(
        {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})

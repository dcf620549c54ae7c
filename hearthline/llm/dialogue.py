"""Conversation structure repair as a shortest path.

A conversation is legal if its roles' initials read (s?(ua)+)?. Keeping a turn,
giving it another role, deleting it and inserting an empty one have small
integer costs, so the cheapest repair is a shortest path over the nodes (turns
done, state of the pattern). Dial's bucket queue records every node's distance
to the end; then the arcs that lie on shortest paths are walked from the start,
the least letter first, which gives the least of the cheapest audits.

Work is shared out by rows, not by conversations. Turns travel without their
texts, as digests, counted before they are shuffled, and are sorted into ranges
of (conversation, turn); a conversation that lies within one range and block is
solved there. Of a longer one each block gives its 4 x 4 distances between
states, these are chained backwards to the distances at the blocks' ends, the
blocks' walks are chained forwards to their first states, and the blocks are
solved again with both. Texts are shuffled once, for the repaired turns. Only
this last step has a conversation in one task, as a stream of bounded memory: a
digest of the whole text can be had in no other way.

Defined results: nulls in role and text count as one space; turns without a
number come first; turns of one number go by their role's initial and a digest
of role and text; a role without a first character can't be kept; equal rows of
one turn are a turn and its repeats; a null conversation is one of its own;
repeated rows, texts and conversations of any length are worked on whole; other
columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Distinct turns of one conversation that are solved at once; longer ones are cut.
BLOCK_ROWS = 1 << 18
WHITE = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, OPEN_END = 3, 4, 3, 3
_FAR = 1 << 40
#: States: nothing yet, after system, after user, after assistant; the first and last may end.
_END = (0, _FAR, _FAR, 0)
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_FORCED = (2, 2, 3, 2)  # the state after an inserted or re-roled turn
_ROLE = ("user", "user", "assistant", "user")


def _arcs(initial: str, fault: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """Of each state the arcs over a turn, (letter, next state, cost), by letter."""
    late = OPEN_END if fault == TRUNCATED else 0
    out = []
    for state in range(4):
        arcs = [("D", state, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            kept = _NEXT.get(initial, (None,) * 4)[state]
            arcs += [("K", kept, late)] * (kept is not None) + [("R", _FORCED[state], REROLE + late)]
        out.append(tuple(arcs))
    return tuple(out)


_ARCS = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "") for f in range(4)}
_BACK = {k: tuple(tuple((s, cost) for s, own in enumerate(arcs) for _, to, cost in own if to == t) for t in range(4)) for k, arcs in _ARCS.items()}
_BACK_INSERT = tuple(tuple(s for s in range(4) if _FORCED[s] == t) for t in range(4))

Turn = tuple[str, int]  # initial and fault


def distances(turns: list[Turn], goal: tuple[int, ...]) -> list[int]:
    """Dial's algorithm backwards: of each node 4 * turns done + state the least cost to the end, where goal has the costs of the states."""
    n = len(turns)
    dist = [_FAR] * (4 * n + 4)
    buckets: dict[int, list[int]] = {}
    for s, d in enumerate(goal):
        if d < _FAR:
            dist[4 * n + s] = d
            buckets.setdefault(d, []).append(4 * n + s)
    while buckets:
        # The costs are at most REROLE + OPEN_END, so only a few buckets are open at any time.
        now = min(buckets)
        for node in (bucket := buckets[now]):  # arcs without cost lengthen the bucket while it is read
            if dist[node] != now:
                continue
            i, t = divmod(node, 4)
            near = [(4 * i + s, INSERT) for s in _BACK_INSERT[t]]
            if i:
                near += [(4 * i - 4 + s, cost) for s, cost in _BACK[turns[i - 1]][t]]
            for other, cost in near:
                if now + cost < dist[other]:
                    dist[other] = now + cost
                    buckets.setdefault(now + cost, []).append(other)
        bucket.clear()
        del buckets[now]
    return dist


def walk(turns: list[Turn], dist: list[int], state: int, last: bool) -> tuple[list[str], int]:
    """Of each turn the edits up to and with its own, by the least letters on shortest paths; those after the last turn are its own if nothing follows. And the state reached."""
    n, i, edits, own = len(turns), 0, [], ""
    while True:
        here = dist[4 * i + state]
        if i == n:
            if not last or not here:
                break
            own, state = own + "I", _FORCED[state]
            continue
        arcs = _ARCS[turns[i]][state]
        letter, to, _ = next((a for a in arcs if a[0] == "D" and dist[4 * i + 4 + a[1]] + a[2] == here), ("", 0, 0))
        if not letter and dist[4 * i + _FORCED[state]] + INSERT == here:
            own, state = own + "I", _FORCED[state]
            continue
        if not letter:
            letter, to, _ = next(a for a in arcs if dist[4 * i + 4 + a[1]] + a[2] == here)
        edits.append(own + letter)
        own, state, i = "", to, i + 1
    if own and edits:
        edits[-1] += own
    return edits, state


def crossing(turns: list[Turn]) -> list[int]:
    """Least costs from each state before the turns to each state after them, row by row."""
    ends = [distances(turns, tuple(0 if s == t else _FAR for s in range(4)))[:4] for t in range(4)]
    return [ends[t][s] for s in range(4) for t in range(4)]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies and present after faults drawn by a checksum of conversation and turn; dropped rows stay as rows that aren't present."""
    c = {name: F.col(f"`{name}`") for name in ("conv_id", "turn", "role", "text")}
    plain = [F.coalesce(c[x].cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")]
    draw = F.crc32(F.concat(plain[0], F.lit(":"), plain[1])) % 20
    return conversations.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(plain[2]).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(plain[3], "[.!?]", "")).otherwise(plain[3]).alias("text"),
        F.when(draw == 3, 2).otherwise(1).alias("copies"), (draw != 0).alias("present"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with nulls as one space, the role's initial and a digest of role and text."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    own = {"copies": F.lit(1), "present": F.lit(True)}
    extra = [F.col(x) if x in rows.columns else v.alias(x) for x, v in own.items()]
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), *extra)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumns({"initial": F.left("role", F.lit(1)), "digest": digest})


_ORDER = ["conv_id", "turn", "initial", "digest"]  # Spark sorts nulls first


def _faults(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn and digest: n copies and the first one's fault. No text."""
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    light = rows.where("present").select(*_ORDER, "copies", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    light = light.groupBy(*_ORDER, "blank", "cut").agg(F.sum("copies").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = light.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    joined = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("first") != place, F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    return joined.select(*_ORDER, "n", fault.alias("fault"))


_BLOCK = "conv_id bigint, id bigint, turn array<bigint>, initial array<string>, digest array<binary>, n array<bigint>, fault array<int>, crossing array<bigint>, edits array<string>"
_KINDS = pa.schema([
    ("conv_id", pa.int64()), ("id", pa.int64()), ("turn", pa.list_(pa.int64())), ("initial", pa.list_(pa.string())), ("digest", pa.list_(pa.binary())),
    ("n", pa.list_(pa.int64())), ("fault", pa.list_(pa.int32())), ("crossing", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())),
])


def _turns(initials: list[str], faults: list[int]) -> list[Turn]:
    return [(i if i in _NEXT else "", f) for i, f in zip(initials, faults, strict=True)]


def _solved(turns: list[Turn], copies: list[int], goal: tuple[int, ...], state: int, last: bool) -> list[str]:
    """Edits of each row: a row's further copies go right after its first."""
    edits, _ = walk(turns, distances(turns, goal), state, last)
    return [f"{e[: (k := len(e.rstrip('I')))]}{'D' * (n - 1)}{e[k:]}" for e, n in zip(edits, copies, strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows into blocks. A conversation that can't go on in another task and fits a block has its edits, others their crossing costs."""
    part, held, first, number = TaskContext.get().partitionId() << 32, [], True, 0

    def block(rows: list[tuple], whole: bool) -> tuple:
        nonlocal number
        number += 1
        _, turn, initial, digest, n, fault = map(list, zip(*rows, strict=True))
        turns = _turns(initial, fault)
        edits, cost = (_solved(turns, n, _END, 0, True), None) if whole else (None, crossing(turns))
        return rows[0][0], part + number, turn, initial, digest, n, fault, cost, edits

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _KINDS, strict=True)], schema=_KINDS)

    cut = False  # whether a block of the present conversation went out already
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                out.append(block(held, not first and not cut))
                held, first, cut = [], False, False
            elif len(held) == BLOCK_ROWS:
                out.append(block(held, False))
                held, cut = [], True
            held.append(row)
        if out:
            yield batch_of(out)
    if held:  # the task's last conversation may go on in the next
        yield batch_of([block(held, False)])


def _ends(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of each block of a conversation the cost from each state at its end."""
    blocks = blocks.sort_values("id")
    goal, out = np.array(_END, np.int64), []
    for cost in reversed(blocks["crossing"].tolist()):
        out.append(goal.tolist())
        goal = np.minimum((np.asarray(cost, np.int64).reshape(4, 4) + goal).min(axis=1), _FAR)
    return pd.DataFrame({"id": blocks["id"], "goal": out[::-1], "last": blocks["id"] == blocks["id"].max()})


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of each block of a conversation its first state."""
    blocks, state, out = blocks.sort_values("id"), 0, []
    for exits in blocks["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"id": blocks["id"], "state": out})


def _long(blocks: DataFrame) -> DataFrame:
    """Edits of the blocks that have none yet. Per conversation some numbers of each block meet in one task, one block being BLOCK_ROWS rows or a task's whole share of it."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, key, initial, fault, goal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = _turns(initial, fault)
                dist = distances(turns, tuple(goal))
                out.append((conv_id, key, [walk(turns, dist, s, False)[1] if dist[s] < _FAR else 0 for s in range(4)]))
            yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "id", "exits"), map(list, zip(*out, strict=True)), strict=True)) if out else {"conv_id": [], "id": [], "exits": []}, pa.schema([("conv_id", pa.int64()), ("id", pa.int64()), ("exits", pa.list_(pa.int32()))]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True))
            own["edits"] = [
                _solved(_turns(i, f), n, tuple(goal), state, last)
                for i, f, n, goal, state, last in zip(own["initial"], own["fault"], own["n"], own["goal"], own["state"], own["last"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) for f in _KINDS], schema=_KINDS)

    ends = materialize(blocks.groupBy("conv_id").applyInPandas(lambda b: _ends(b), "id bigint, goal array<bigint>, last boolean"), "ends")
    states = blocks.join(ends, "id").select("conv_id", "id", "initial", "fault", "goal").mapInArrow(exits, "conv_id bigint, id bigint, exits array<int>")
    starts = states.groupBy("conv_id").applyInPandas(lambda b: _starts(b), "id bigint, state int")
    return blocks.join(ends, "id").join(starts, "id").select(*_KINDS.names, "goal", "state", "last").mapInArrow(solve, _BLOCK)


def _decided(rows: DataFrame) -> DataFrame:
    """_ORDER, n, fault and edits of each distinct turn."""
    light = _faults(rows).select(*_ORDER, "n", "fault")
    blocks = materialize(light.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_blocks, _BLOCK), "blocks")
    every = blocks.where("edits IS NOT NULL").unionByName(_long(blocks.where("edits IS NULL")))
    zipped = F.explode(F.arrays_zip("turn", "initial", "digest", "n", "fault", "edits")).alias("z")
    return every.select("conv_id", zipped).select("conv_id", *(f"z.{c}" for c in ("turn", "initial", "digest", "n", "fault", "edits")))


class _Replay:
    """One conversation's turns as they stream by: numbers of its faults, and the repaired turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.audit, self.rest, self.turn, self.initial = conv_id, 0, [], "", None, None
        self.low = self.high = None
        self.distinct = self.cost = self.illegal = self.position = 0
        self.faults = [0] * 4

    def decide(self, turn: int | None, initial: str, n: int, fault: int, edits: str) -> list[tuple]:
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial, self.turn = initial, turn
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += n - 1
        self.cost += REROLE * edits.count("R") + DELETE * edits.count("D") + INSERT * edits.count("I")
        self.cost += OPEN_END if fault == TRUNCATED and ("K" in edits or "R" in edits) else 0
        self.audit.append(edits)
        at = min((i for i, e in enumerate(edits) if e in "KR"), default=len(edits))
        self.rest = edits[at:]
        return self._inserted(edits[:at])

    def _inserted(self, edits: str) -> list[tuple]:
        return [self._turn("I", None, _ROLE[self.state], "") for _ in range(edits.count("I"))]

    def _turn(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        self.state = _FORCED[self.state] if edit != "K" else _NEXT[role[:1]][self.state]
        self.position += 1
        return self.conv_id, self.position - 1, edit, turn, role, text

    def text(self, role: str, text: str) -> list[tuple]:
        """The text of the turn decided on last, if it stays; its copies come after it and are ignored."""
        if not self.rest:
            return []
        edit, rest, self.rest = self.rest[0], self.rest[1:], ""
        return [self._turn(edit, self.turn, role if edit == "K" else _ROLE[self.state], text), *self._inserted(rest)]

    def numbers(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit)


_TURNS = "conv_id bigint, position bigint, edit string, turn bigint, role string, text string"
_AUDITS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _replayed(rows: DataFrame, digests: bool) -> DataFrame:
    """Decisions and texts, by conversation in order: the repaired turns, or each conversation's numbers and digest."""
    keyed = _keyed(rows)
    decided = _decided(keyed).select(*_ORDER, F.lit(0).alias("kind"), "n", "fault", "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("fault", "int"), ("edits", "string"))]
    texts = keyed.select(*_ORDER, F.when(F.col("present"), 1).otherwise(2).alias("kind"), *none, "role", F.when(F.col("present"), F.col("text")).alias("text"))
    stream = decided.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_ORDER, "kind").drop("digest")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, hashlib.sha256()
        for batch in slices(batches, 7):
            out: list[tuple] = []
            for conv_id, turn, initial, kind, n, fault, edits, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None and digests:
                        out.append((*now.numbers(), hashed.hexdigest()))
                    now, hashed = _Replay(conv_id), hashlib.sha256()
                turns = [] if kind == 2 else now.decide(turn, initial, n, fault, edits) if kind == 0 else now.text(role, text)
                if not digests:
                    out += turns
                    continue
                for _, position, _, _, own, said in turns:
                    hashed.update(f"{chr(10) if position else ''}{own}:{said}".encode())
            if out:
                yield _batch(out, digests)
        if now is not None and digests:
            yield _batch([(*now.numbers(), hashed.hexdigest())], digests)

    return stream.mapInArrow(replay, _AUDITS if digests else _TURNS)


def _batch(rows: list[tuple], digests: bool) -> pa.RecordBatch:
    fields = [f.split(" ") for f in (_AUDITS if digests else _TURNS).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "bigint" else pa.string()) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of every conversation: conv_id, position from 0, edit (K, R or I), turn (null if inserted), role, text."""
    return _replayed(rows, digests=False)


def audit(rows: DataFrame) -> DataFrame:
    """Per conversation, those without a present row too: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    return _replayed(rows, digests=True)

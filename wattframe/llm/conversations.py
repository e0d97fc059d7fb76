"""Faults in conversations, and the cheapest edits that repair their structure."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space; a text of nothing else is blank.
SPACE = b" \t\n\v\f\r"
SENTENCE_END = b".!?"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: Where ``(s?(ua)+)?`` stands after a role: 0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an
#: assistant's.  A place and an edit's letter fix the role that comes out, so an audit names one path.
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
ROLES = {2: b"user", 3: b"assistant"}

#: A longer conversation is repaired in pieces of this many rows or bytes, so a task never holds more of its texts.
PIECE_ROWS, PIECE_BYTES = 512, 16 << 20

_RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Turn(NamedTuple):
    role: bytes
    text: bytes
    initial: str
    goes: bool  # blank or duplicate
    cut: bool  # truncated


# ---- repair of one piece -------------------------------------------------------------


def edges(turns: list[Turn], row: int, place: int) -> Iterator[tuple[int, str, int, int]]:
    """Edits at a node of the lattice (rows read, place in the pattern): cost, letter, and the node that follows."""
    for after in (x for x in STEP[place].values() if x in ROLES):
        yield INSERT, "I", row, after
    if row == len(turns):
        return
    turn = turns[row]
    yield DELETE, "D", row + 1, place
    if turn.goes:
        return
    extra = TRUNCATED if turn.cut else 0
    if (kept := STEP[place].get(turn.initial)) is not None:
        yield KEEP + extra, "K", row + 1, kept
    for after in (x for x in STEP[place].values() if x in ROLES):
        yield REROLE + extra, "R", row + 1, after


def cheapest(turns: list[Turn], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost from place ``start`` to one of ``ends`` over all turns, and the least of its audits; None: no way.

    Dijkstra's search from both sides of the edit lattice.  A heap gives nodes by cost and, among equal ones, by rows
    read from its side, so an edit that costs nothing is followed before what it leads to is settled; with equal costs
    the lesser audit stays.  The heaps go on until together they exceed the best meeting, so all crossings of that
    cost are seen.  Two audits of equal cost to a node are never one the beginning of the other (a longer one has more
    insertions), so joining the least of both sides at a crossing gives the least.
    """
    n = len(turns)
    back: dict[tuple[int, int], list[tuple[int, str, int, int]]] = {}
    for row in range(n + 1):
        for place in STEP:
            for cost, letter, r, p in edges(turns, row, place):
                back.setdefault((r, p), []).append((cost, letter, row, place))
    labels: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, end): (0, "") for end in ends})
    settled: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([(0, 0, start)], sorted((0, 0, end) for end in ends))
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, depth, place = heappop(heaps[side])
        node = (depth, place) if side == 0 else (n - depth, place)
        if node in settled[side]:
            continue
        own = settled[side][node] = labels[side][node]
        crossings = []
        if node in settled[1 - side]:
            crossings.append((0, "", node))
        following = ((c, x, (r, p)) for c, x, r, p in (edges(turns, *node) if side == 0 else back.get(node, ())))
        for step, letter, other in following:
            if other in settled[1 - side]:
                crossings.append((step, letter, other))
            if other in settled[side]:
                continue
            label = (cost + step, own[1] + letter if side == 0 else letter + own[1])
            if other not in labels[side] or label < labels[side][other]:
                if other not in labels[side] or label[0] < labels[side][other][0]:
                    heappush(heaps[side], (label[0], other[0] if side == 0 else n - other[0], other[1]))
                labels[side][other] = label
        for step, letter, other in crossings:
            there = settled[1 - side][other]
            audit = own[1] + letter + there[1] if side == 0 else there[1] + letter + own[1]
            whole = (own[0] + step + there[0], audit)
            best = whole if best is None or whole < best else best
    return best


def repaired(turns: list[Turn], place: int, audit: str) -> Iterator[bytes]:
    """The turns that an audit leaves, as ``role:text``."""
    row = 0
    for letter in audit:
        if letter == "I":
            place = next(x for x in STEP[place].values() if x in ROLES)
            yield ROLES[place] + b":"
            continue
        turn, row = turns[row], row + 1
        if letter == "K":
            place = STEP[place][turn.initial]
            yield turn.role + b":" + turn.text
        elif letter == "R":
            place = next(x for x in STEP[place].values() if x in ROLES)
            yield ROLES[place] + b":" + turn.text


# ---- a stream of rows, by conversation and in order ----------------------------------


class _Conversation:
    """What is known of a conversation while its rows come in; texts only of the present piece."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.last_turn = None
        self.turns_seen = 0
        self.last_row: tuple | None = None
        self.last_initial: str | None = None
        self.piece: list[Turn] = []
        self.piece_bytes = 0
        # for each place in the pattern: cost, audit, digest of what is left so far
        self.ways = {0: (0, "", None)}

    def add(self, turn: int | None, role: bytes, text: bytes, first: bool, copies: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns_seen += turn != self.last_turn
            self.last_turn = turn
        core = text.rstrip(SPACE)
        blank, cut = not core, core[-1:] not in (b".", b"!", b"?")
        initial = role[:1].decode("latin-1")
        again = (turn, role, text) == self.last_row
        self.last_row = (turn, role, text)
        for copy in range(copies):
            duplicate = not first or again or copy > 0
            if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.last_initial = initial
            self.counts["blank"] += blank
            self.counts["duplicate"] += duplicate and not blank
            self.counts["truncated"] += cut and not duplicate and not blank
            self.piece.append(Turn(role, text, initial, blank or duplicate, cut))
            self.piece_bytes += len(role) + len(text)
            if len(self.piece) >= PIECE_ROWS or self.piece_bytes >= PIECE_BYTES:
                self._close(tuple(STEP))

    def _close(self, ends: tuple[int, ...]) -> None:
        """Lead every way through the present piece; of ways to one place the cheapest with the least audit stays."""
        found: dict[int, tuple] = {}
        for start, (cost, audit, digest) in self.ways.items():
            for group in (ends,) if ends == ENDS else ((end,) for end in ends):
                part = cheapest(self.piece, start, group)
                if part is None:
                    continue
                whole = (cost + part[0], audit + part[1])
                if group[0] not in found or whole < found[group[0]][:2]:
                    found[group[0]] = (*whole, start, part[1], digest)
        self.ways = {}
        for end, (cost, audit, start, part, digest) in found.items():
            digest = digest.copy() if digest is not None else None
            for left in repaired(self.piece, start, part):
                if digest is None:
                    digest = hashlib.sha256(left)
                else:
                    digest.update(b"\n")
                    digest.update(left)
            self.ways[end] = (cost, audit, digest)
        self.piece, self.piece_bytes = [], 0

    def result(self) -> tuple:
        self._close(ENDS)
        cost, audit, digest = self.ways[ENDS[0]]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns_seen
        return (
            self.conv_id, gaps, *self.counts.values(), cost, audit, (digest or hashlib.sha256()).hexdigest(),
        )


def _repairer(schema: pa.Schema) -> Callable:
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "first", "copies"))
            for conv, turn, role, text, first, copies in zip(*columns):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv)
                if copies:
                    now.add(turn, role, text, first, copies)
            yield out()
            done = []
        if now is not None:
            done.append(now.result())
            yield out()

    return repair


def repair_structure(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies: Column | None = None,
) -> DataFrame:
    """Faults of every conversation and its cheapest repair to the roles ``(s?(ua)+)?``, by their first letters.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  Rows count by turn, null first;
    rows of one turn by role, then text.  A row's first fault counts: blank (nothing but ASCII white space), duplicate
    (role and text seen earlier in the conversation), truncated (not ended by ``.``, ``!`` or ``?``).  Edits are Keep (0),
    Rerole to user or assistant (1), Delete (2, and the only one for blank and duplicate rows) and Insert of an
    empty turn (5); a truncated row that stays costs 5 more.  Of the cheapest ways the one with the least audit counts.

    ``copies`` tells how often a row counts (1 unless given); a conversation whose rows all count 0 times is returned
    with zeros.  Null roles and texts are one space; a null ``conv_id`` is a conversation of its own; null turns don't
    count as gaps.  Other columns of ``df`` don't matter.

    First occurrences are found by digests, aggregated before they are shuffled, and joined to the rows, where the
    adaptive planner splits a text that is everywhere.  Then a conversation's rows pass through one task in order, a
    piece at a time: from piece to piece go four costs, audits and states of the digest, one for each place in the
    pattern, so memory doesn't follow its texts, only its audit, which is one value of the result.
    """
    spaced = {c: F.coalesce(F.col(n).cast("string"), F.lit(" ")) for c, n in (("role", role_col), ("text", text_col))}
    rows = df.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced["role"].alias("role"),
        spaced["text"].alias("text"), F.coalesce(copies if copies is not None else F.lit(1), F.lit(0)).cast("int").alias("copies"),
    )
    rows = rows.select(
        "conv", "turn", *(F.when(F.col("copies") > 0, F.col(c)).otherwise("").alias(c) for c in ("role", "text")), "copies",
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    same = ("conv", "digest")
    first = rows.where("copies > 0").groupBy(*same).agg(
        F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("least")
    )
    meets = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in same]
    is_first = F.when(F.col("f.untimed"), F.col("r.turn").isNull()).otherwise(F.col("r.turn") == F.col("f.least"))
    marked = rows.alias("r").join(first.alias("f"), meets, "left").select(
        "r.conv", "r.turn", F.col("r.role").cast("binary").alias("role"), F.col("r.text").cast("binary").alias("text"),
        F.coalesce(is_first, F.lit(False)).alias("first"), "r.copies",
    )
    schema = df.sparkSession.createDataFrame([], _RESULT).toArrow().schema
    return marked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(_repairer(schema), _RESULT)

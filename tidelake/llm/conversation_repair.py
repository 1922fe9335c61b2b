"""Repair of the structure of conversations: the cheapest edits that give alternating turns, with their audit.

Edits of a turn: keep (K, costs 0), rerole to user or assistant (R, 3), delete (D, 4); an empty turn of either role may
be inserted anywhere (I, 3). Blank and repeated turns must go, a truncated turn that stays adds 3. The initials of the
roles that are left read `(s?(ua)+)?`. Of equally cheap edits the ASCII-least string of initials wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import broadcast_if_small, durable, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A block of a conversation is closed at so many turns or characters.
BLOCK_TURNS, BLOCK_CHARS = 4096, 4_000_000
SPACE = " \t\n\x0b\x0c\r"
#: States of a conversation: nothing yet, after the system's, the user's, the assistant's turn. It may end in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that can follow an edit, by state; more could only lead back.
INSERTS = {START: ((START, ""), (USER, "I"), (ASSISTANT, "II")), SYSTEM: ((SYSTEM, ""), (USER, "I"), (ASSISTANT, "II")), USER: ((USER, ""), (ASSISTANT, "I")), ASSISTANT: ((ASSISTANT, ""), (USER, "I"))}
GONE, CUT, WHOLE = range(3)

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Node:
    """The edits of one turn (with inserts after it) behind those of `up[0]`: equal beginnings are shared.

    `up[j]` is the ancestor 2^j steps back, `mark` a rolling hash of all edits so far and `state` the one they lead to.
    """

    __slots__ = ("depth", "mark", "piece", "state", "up")

    def __init__(self, parent: Node | None, piece: str, state: int = START) -> None:
        self.piece, self.state, self.depth = piece, state, 0 if parent is None else parent.depth + 1
        mark = 0 if parent is None else parent.mark
        for c in piece:
            mark = (mark * _BASE + ord(c)) % _PRIME
        self.mark = (mark * _BASE + 1) % _PRIME
        self.up: list[Node] = [] if parent is None else [parent]
        while parent is not None and len(parent.up) >= len(self.up):
            self.up.append(parent := parent.up[len(self.up) - 1])

    def back(self, steps: int) -> Node:
        at = self
        while steps:
            at = at.up[steps.bit_length() - 1]
            steps -= 1 << (steps.bit_length() - 1)
        return at

    def way(self) -> list[Node]:
        """All nodes from the root to this one."""
        out, at = [self], self
        while at.up:
            out.append(at := at.up[0])
        return out[::-1]

    def edits(self) -> str:
        return "".join(n.piece for n in self.way())


def same(a: Node, b: Node) -> bool:
    """Whether two nodes of equal hash stand for equal edits; they nearly always are one node or soon meet."""
    while a is not b:
        if a.piece != b.piece or not a.up:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether the edits of `a` sort before those of `b`, both of equal depth and cost.

    Binary lifting over the hashes finds the longest common beginning in whole turns. The pieces after it decide, or,
    if one begins the other, the next edit of the shorter one against an insert: as all edits of as many turns
    cost the same, neither string begins the other.
    """
    x, y = a, b
    if x.mark == y.mark and same(x, y):
        return False
    for j in reversed(range(len(x.up))):
        if j < len(x.up) and x.up[j].mark != y.up[j].mark:
            x, y = x.up[j], y.up[j]
    if x.mark == y.mark or not same(x.up[0], y.up[0]):  # two strings of one hash: compare them as they are
        return a.edits() < b.edits()
    p, q = x.piece, y.piece
    if q.startswith(p):
        return _after(a, x) < q[len(p) :]
    if p.startswith(q):
        return p[len(q) :] < _after(b, y)
    return p < q


def _after(end: Node, x: Node) -> str:
    """The piece of the node after `x` on the way to `end`."""
    return end.back(end.depth - x.depth - 1).piece if end.depth > x.depth else ""


def _steps(kind: int, initial: str) -> list[list[tuple[int, int, str]]]:
    """For each state after a turn: the states before it with the cheapest edits between, and their cost."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if kind == CUT else 0
    for p in range(4):
        edits = [(DELETE, "D", p)]
        if kind != GONE:
            edits.append((REROLE + extra, "R", NEXT[p]))
            if (p, initial) in KEPT:
                edits.append((KEEP + extra, "K", KEPT[p, initial]))
        for cost, letter, q in edits:
            for to, more in INSERTS[q]:
                one = (cost + INSERT * len(more), letter + more)
                best[p, to] = min(best.get((p, to), one), one)
    return [[(p, *best[p, q]) for p in range(4) if (p, q) in best] for q in range(4)]


STEPS = {(kind, i): _steps(kind, i) for kind in range(3) for i in ("s", "u", "a", "")}
Cells = list[tuple[int, Node] | None]


def begin() -> Cells:
    """Before the first turn: nothing, or inserts."""
    root = Node(None, "")
    cells: Cells = [None] * 4
    for q, piece in INSERTS[START]:
        cells[q] = (INSERT * len(piece), Node(root, piece, q))
    return cells


def advance(cells: Cells, steps: list[list[tuple[int, int, str]]]) -> Cells:
    """The cheapest, then least, edits for each state after one more turn, or one more block."""
    after: Cells = []
    for q, ways in enumerate(steps):
        cost, best = -1, []
        for p, more, piece in ways:
            if cells[p] is not None:
                total = cells[p][0] + more
                if cost < 0 or total < cost:
                    cost, best = total, [(p, piece)]
                elif total == cost:
                    best.append((p, piece))
        if cost < 0:
            after.append(None)
            continue
        node = Node(cells[best[0][0]][1], best[0][1], q)
        for p, piece in best[1:]:
            other = Node(cells[p][1], piece, q)
            node = other if less(other, node) else node
        after.append((cost, node))
    return after


def finish(cells: Cells) -> tuple[int, Node]:
    ends = [cells[q] for q in ENDS if cells[q] is not None]
    cost = min(c for c, _ in ends)
    nodes = [n for c, n in ends if c == cost]
    return cost, (nodes[1] if len(nodes) > 1 and less(nodes[1], nodes[0]) else nodes[0])


def rewrite(roles: list[str], texts: list[str], edits: str, state: int = START) -> tuple[list[str], list[str]]:
    """The turns that the edits leave."""
    out: tuple[list[str], list[str]] = ([], [])
    turns = iter(zip(roles, texts, strict=True))
    for e in edits:
        role, text = next(turns) if e != "I" else ("", "")
        if e == "D":
            continue
        state = KEPT[state, role[:1]] if e == "K" else NEXT[state]
        out[0].append(role if e == "K" else NAMES[state])
        out[1].append(text)
    return out


@dataclass
class Block:
    """Turns that follow each other in one conversation, and what joining them to their neighbours needs."""

    conv: object
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        seen = text.strip(SPACE)
        blank, duplicate = not seen, bool(seen) and again
        cut = bool(seen) and not again and seen[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(GONE if blank or duplicate else CUT if cut else WHOLE)
        self.chars += len(text)

    def run(self, cells: Cells) -> Cells:
        for kind, role in zip(self.kinds, self.roles, strict=True):
            cells = advance(cells, STEPS[kind, role[:1] if role[:1] in ("s", "u", "a") else ""])
        return cells

    def between(self) -> list[dict]:
        """The cheapest, least edits from each state before the block to each after it, without inserts before its first turn."""
        out = []
        for p in range(4):
            cells: Cells = [None] * 4
            cells[p] = (0, Node(None, ""))
            out += [{"p": p, "q": q, "cost": c[0], "edits": c[1].edits()} for q, c in enumerate(self.run(cells)) if c is not None]
        return out


CELLS = "array<struct<p:int,q:int,cost:bigint,edits:string>>"
_CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
_TEXTS = pa.list_(pa.string())
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a partition as blocks; one conversation that surely begins and ends here is done at once."""
    part, no, size = TaskContext.get().partitionId(), 0, 0
    columns = ["conv", "part", "no", "whole", "roles", "texts", "cells", "cost", "audit", *_COUNTS]
    types = [kind, pa.int64(), pa.int64(), pa.bool_(), _TEXTS, _TEXTS, _CELLS, pa.int64(), pa.string(), *[pa.int64()] * len(_COUNTS)]
    ready: list[tuple] = []

    def close(b: Block, whole: bool) -> None:
        nonlocal no, size
        roles, texts, cells, cost, audit = b.roles, b.texts, None, None, None
        if whole:
            cost, end = finish(b.run(begin()))
            roles, texts = rewrite(roles, texts, audit := end.edits())
        else:
            cells = b.between()
        ready.append((b.conv, part, no, whole, roles, texts, cells, cost, audit, *(getattr(b, c) for c in _COUNTS)))
        no, size = no + 1, size + b.chars + 100 * len(b.roles) + (16 * len(b.roles) if cells else 0)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ready, size
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], names=columns)
        ready, size = [], 0

    block, first, single = None, True, True
    for batch in batches:
        for conv, turn, role, text, again, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block is not None and block.conv != conv:
                close(block, single and not first)
                block, first, single = None, False, True
            for copy in range(many):
                if block is not None and (len(block.roles) >= BLOCK_TURNS or block.chars >= BLOCK_CHARS):
                    close(block, False)
                    block, single = None, False
                block = block or Block(conv)
                block.add(turn, role, text, again or copy > 0)
                if size >= BLOCK_CHARS:
                    yield from flush()
    if block is not None:
        close(block, False)
    yield from flush()


def _combine(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Sorted open blocks, without their texts, joined to conversations: a row for each block with its state before and edits."""
    names = ["conv", "part", "no", "state", "edits", "cost", "audit", *_COUNTS]
    types = [kind, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * len(_COUNTS)]
    conv, cells, at, total, last = None, None, [], None, None

    def close() -> pa.RecordBatch:
        cost, end = finish(cells)
        way = end.way()[1:]  # the inserts before the first turn, then a node for each block
        out = [(conv, *place, before.state if i else START, (before.piece if not i else "") + node.piece) for i, (place, before, node) in enumerate(zip(at, way, way[1:], strict=False))]
        audit = end.edits()
        first = (cost, audit, *(total[c] for c in _COUNTS))
        rows = [(*r, *(first if i == 0 else (None,) * len(first))) for i, r in enumerate(out)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if cells is None or r["conv"] != conv:
                if cells is not None:
                    yield close()
                conv, cells, at, total, last = r["conv"], begin(), [], None, None
            ways: list[list[tuple[int, int, str]]] = [[] for _ in range(4)]
            for c in r["cells"]:
                ways[c["q"]].append((c["p"], c["cost"], c["edits"]))
            cells = advance(cells, ways)
            at.append((r["part"], r["no"]))
            if total is None:
                total = {c: r[c] for c in _COUNTS}
            else:
                for c in ("blank", "duplicate", "truncated"):
                    total[c] += r[c]
                total["illegal"] += r["illegal"] + (last + r["first"] not in ("su", "ua", "au"))
                if r["low"] is not None:
                    total["turns"] += r["turns"] - (r["low"] == total["high"])
                    total["low"] = r["low"] if total["low"] is None else total["low"]
                    total["high"] = r["high"]
            last = r["last"]
    if cells is not None:
        yield close()


@dataclass
class Repaired:
    """`summary`: a row a conversation. `blocks`: its repaired turns, `roles` and `texts` in order of (`part`, `no`)."""

    summary: DataFrame
    blocks: DataFrame


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest repair of every conversation, `rows` being its turns in order of `turn`, nulls first.

    Turns of one number come by role and then text; null roles and texts count as one space; a null key is one
    conversation; other columns are left out. A turn is blank without a character but white space, else a duplicate if
    its role and text were seen earlier, else truncated if its last character but white space is none of `.!?`. An empty table
    gives no rows.

    Rows that are alike in all four columns become one with a count, repeated turns are found by digests, and all rows are dealt by
    ranges of (conversation, turn, role, beginning of the text), so a conversation may be of any size: its blocks turn
    into tables of costs between states, which are joined in order, without the texts. Edits in a block share their beginnings as
    linked nodes, and so do edits of joined blocks. One task holds one block, or the audit of one conversation.
    """
    kind = rows.schema[conv].dataType.simpleString()
    arrow = rows.select(conv).limit(0).toArrow().schema[0].type
    clean = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    key = F.sha2(F.concat_ws("\x00", F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string"))), F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    turns = stored(clean.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("many")).withColumn("key", key))
    seen = durable(turns.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1").drop("n"))
    marked = turns.join(broadcast_if_small(seen, 250), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    dealt = marked.select("conv", "turn", "role", "text", again.alias("again"), "many").repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    schema = f"conv {kind}, part long, no long, whole boolean, roles array<string>, texts array<string>, cells {CELLS}, cost long, audit string, {counts}"
    blocks = stored(dealt.sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(lambda b: _blocks(b, arrow), schema))

    initial = lambda c: F.substring(c, 1, 1)
    light = blocks.where("NOT whole").select("conv", "part", "no", "cells", initial(F.element_at("roles", 1)).alias("first"), initial(F.element_at("roles", -1)).alias("last"), *_COUNTS)
    joined = stored(light.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInArrow(lambda b: _combine(b, arrow), f"conv {kind}, part long, no long, state int, edits string, cost long, audit string, {counts}"))
    tail = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    done = blocks.where("whole").select("conv", gaps, *tail).unionByName(joined.where("audit IS NOT NULL").select("conv", gaps, *tail))
    return Repaired(done.withColumnRenamed("conv", conv), _rewritten(blocks, joined).withColumnRenamed("conv", conv))


def _rewritten(blocks: DataFrame, joined: DataFrame) -> DataFrame:
    """All blocks with their turns after the edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = zip(batch["roles"].to_pylist(), batch["texts"].to_pylist(), batch["edits"].to_pylist(), batch["state"].to_pylist(), strict=True)
            done = [rewrite(r, t, e, s) for r, t, e, s in edits]
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], batch["no"], batch["whole"], pa.array([d[0] for d in done], _TEXTS), pa.array([d[1] for d in done], _TEXTS)], names=["conv", "part", "no", "whole", "roles", "texts"])

    columns = ["conv", "part", "no", "whole", "roles", "texts"]
    opened = blocks.where("NOT whole").select(*columns).join(joined.select("part", "no", "edits", "state"), ["part", "no"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*columns).schema)
    return blocks.where("whole").select(*columns).unionByName(opened.select(*columns, "edits", "state").mapInArrow(run, schema))


def digest(done: Repaired, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's repaired `role:text` turns, joined by newlines, as lower-case hex.

    The hash of one conversation takes its blocks in order, one at a time; those in one block are hashed by the JVM.
    """
    kind = done.blocks.schema[conv].dataType.simpleString()
    arrow = done.blocks.select(conv).limit(0).toArrow().schema[0].type
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, some = None, None, False
        made = lambda: pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([state.hexdigest()])], names=["conv", "sha256"])
        for batch in batches:
            for c, roles, texts in zip(batch["conv"].to_pylist(), batch["roles"].to_pylist(), batch["texts"].to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        yield made()
                    conv, state, some = c, hashlib.sha256(), False
                for r, t in zip(roles, texts, strict=True):
                    state.update((("\n" if some else "") + r + ":" + t).encode())
                    some = True
        if state is not None:
            yield made()

    blocks = done.blocks.withColumnRenamed(conv, "conv")
    opened = blocks.where("NOT whole").select("conv", "part", "no", "roles", "texts").repartition("conv").sortWithinPartitions("conv", "part", "no")
    whole = blocks.where("whole").select("conv", F.sha2(lines.cast("binary"), 256).alias("sha256"))
    return whole.unionByName(opened.mapInArrow(run, f"conv {kind}, sha256 string")).withColumnRenamed("conv", conv)

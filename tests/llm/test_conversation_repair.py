"""Conversation repair against all edit strings, in blocks of all sizes, and on awkward rows."""

import hashlib
import itertools
import random
import re

import pytest

from tidelake.llm import conversation_repair as cr

SHAPE = re.compile(r"(s?(ua)+)?")


def kinds(turns):
    """(fault, initial) of each (role, text)."""
    seen, out = set(), []
    for role, text in turns:
        core = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def all_edits(turns):
    """The cheapest, then least edit string, by trying every one with up to 2 inserts at each place."""
    faults, best = kinds(turns), None
    slots = ["", "I", "II"]
    for edits in itertools.product("DKR", repeat=len(turns)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults, strict=True)):
            continue
        for gaps in itertools.product(slots, repeat=len(turns) + 1):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:], strict=True))
            cost = sum({"D": 4, "K": 0, "R": 3, "I": 3}[e] for e in audit) + sum(3 for e, f in zip(edits, faults, strict=True) if e != "D" and f == "truncated")
            if best is not None and (cost, audit) >= best[:2]:
                continue
            shapes = [""]
            at = iter(turns)
            for e in audit:
                role = next(at)[0] if e != "I" else ""
                shapes = [s + c for s in shapes for c in ({"D": [""], "K": [role[:1] or "?"]}.get(e) or ["u", "a"])]
            if any(SHAPE.fullmatch(s) for s in shapes):
                best = (cost, audit)
    return best


def plain(turns):
    """The same by strings instead of nodes, for longer conversations."""
    steps = {0: (0, ""), 2: (3, "I"), 3: (6, "II")}
    for (role, _), fault in zip(turns, kinds(turns), strict=True):
        new = {}
        for p, (cost, audit) in steps.items():
            ways = [("D", 4, p)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                ways.append(("R", 3 + extra, cr.NEXT[p]))
                if (p, role[:1]) in cr.KEPT:
                    ways.append(("K", extra, cr.KEPT[p, role[:1]]))
            for e, c, q in ways:
                for to, more in cr.INSERTS[q]:
                    one = (cost + c + 3 * len(more), audit + e + more)
                    new[to] = min(new.get(to, one), one)
        steps = new
    return min(steps[q] for q in cr.ENDS if q in steps)


def found(cells):
    cost, node = cr.finish(cells)
    return cost, node.edits()


def random_turns(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool", "", "user", "assistant"]), rng.choice(["Yes.", "no", "", " \n", "One! ", f"{rng.random()}?", f"{rng.random()}"])) for _ in range(n)]


def block_of(turns):
    b, seen = cr.Block("c"), set()
    for i, (role, text) in enumerate(turns):
        b.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    return b


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_equals_all_edit_strings(n):
    rng = random.Random(n)
    for _ in range(60 if n < 4 else 12):
        turns = random_turns(rng, n)
        assert found(block_of(turns).run(cr.begin())) == all_edits(turns) == plain(turns)


def test_long_conversations_and_joined_blocks():
    rng = random.Random(5)
    for n in (30, 200, 700):
        turns = random_turns(rng, n)
        want = plain(turns)
        whole = block_of(turns)
        assert found(whole.run(cr.begin())) == want
        cells, at = cr.begin(), 0
        while at < n:
            size = rng.randrange(1, 60)
            part = cr.Block("c")
            part.roles, part.kinds = whole.roles[at : at + size], whole.kinds[at : at + size]
            ways = [[] for _ in range(4)]
            for c in part.between():
                ways[c["q"]].append((c["p"], c["cost"], c["edits"]))
            cells, at = cr.advance(cells, ways), at + size
        assert found(cells) == want


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash of two values nearly all strings collide, and the results stay."""
    monkeypatch.setattr(cr, "_PRIME", 2)
    rng = random.Random(6)
    for _ in range(40):
        turns = random_turns(rng, 25)
        assert found(block_of(turns).run(cr.begin())) == plain(turns)


def expected(turns):
    """turns: (turn, role, text) of one conversation."""
    rows = sorted([(t, r or " " if r is None else r, " " if x is None else x) for t, r, x in turns], key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    pairs = [(r, x) for _, r, x in rows]
    faults = kinds(pairs)
    cost, audit = plain(pairs)
    numbers = {t for t, _, _ in rows if t is not None}
    roles, texts = cr.rewrite([p[0] for p in pairs], [p[1] for p in pairs], audit)
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in zip(roles, texts, strict=True)).encode()).hexdigest()
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)


@pytest.mark.parametrize("turns_a_block", [4096, 3, 1])
def test_tables_in_blocks_of_all_sizes(spark, monkeypatch, turns_a_block):
    monkeypatch.setattr(cr, "BLOCK_TURNS", turns_a_block)
    blocks = cr._blocks  # in the worker's own copy of the module, too
    monkeypatch.setattr(cr, "_blocks", lambda b, k, n=turns_a_block, f=blocks: (setattr(cr, "BLOCK_TURNS", n), f(b, k))[1])
    rng = random.Random(7)
    rows = [(c, rng.choice([i, i + 2, None]), r, x) for c in [*range(25), None] for i, (r, x) in enumerate(random_turns(rng, rng.randrange(1, 14)))]
    rows += [(100, i // 3, r, x) for i, (r, x) in enumerate(random_turns(rng, 400))]
    rows += [(101, 1, "user", "again.")] * 50 + [(102, None, None, None), (103, 5, "user", "x" * 100_000 + "."), (103, 6, "assistant", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, many int, KEY string").repartition(5)
    done = cr.repair(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in done.summary.join(cr.digest(done).withColumnRenamed("conv_id", "i"), done.summary.conv_id.eqNullSafe(cr.F.col("i"))).drop("i").collect()}
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    assert cr.repair(df.limit(0)).summary.count() == 0 == cr.digest(cr.repair(df.limit(0))).count()

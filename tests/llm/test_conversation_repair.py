import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import pytest

from revlens.llm import conversation_repair as R

WS = " \t\n\v\f\r"


def classes(rows):
    """(initial, fault) of (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WS)
        fault = (R.BLANK if not bare else R.DUPLICATE if (role, text) in seen else R.TRUNCATED if bare[-1] not in ".!?" else R.FINE)
        seen.add((role, text))
        out.append(({"s": 1, "u": 2, "a": 3}.get(role[:1], 0), fault))
    return out


def fits(pattern):
    rest = pattern[1:] if pattern[:1] == "s" else pattern
    return pattern == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def every_edit(rows):
    """The least (cost, audit, repaired rows) over all edit sequences with up to two inserts between rows."""
    kinds = classes(rows)
    best = None
    options = []
    for (role, text), (_, fault) in zip(rows, kinds):
        edits = [("D", 2, None)]
        if fault not in (R.BLANK, R.DUPLICATE):
            more = 5 if fault == R.TRUNCATED else 0
            edits += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        options.append(edits)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for chosen in product(*options):
        for gaps in product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for name in gaps[k]:
                    cost, audit = cost + 5, audit + "I"
                    out.append((name, ""))
                if k < len(rows):
                    edit, c, kept = chosen[k]
                    cost, audit = cost + c, audit + edit
                    if kept:
                        out.append(kept)
            if fits("".join(role[:1] or "-" for role, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def state_by_state(kinds):
    """The least (cost, audit) by dynamic programming over the states."""
    def inserted(at):
        for s, t in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if s in at:
                at[t] = min(at.get(t, (10**9, "")), (at[s][0] + 5, at[s][1] + "I"))
        return at
    at = inserted({0: (0, "")})
    for initial, fault in kinds:
        nxt = {s: (c + 2, a + "D") for s, (c, a) in at.items()}
        for s, (c, a) in at.items() if fault not in (R.BLANK, R.DUPLICATE) else ():
            more = 5 if fault == R.TRUNCATED else 0
            due = 3 if s == 2 else 2
            moves = [(due, (c + more + 1, a + "R"))]
            if initial == due or initial == 1 and s == 0:
                moves.append((initial, (c + more, a + "K")))
            for t, v in moves:
                nxt[t] = min(nxt.get(t, (10**9, "")), v)
        at = inserted(nxt)
    return min(v for s, v in at.items() if s in (0, 3))


def run(rows):
    c = R.Conversation()
    for turn, ((role, text), (initial, fault)) in enumerate(zip(rows, classes(rows))):
        c.add(turn, role, text, initial, fault)
    return c.result()


def sha(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_small_conversations_against_every_edit():
    r = random.Random(4)
    for _ in range(60):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["a.", "b", " ", "c!"])) for _ in range(r.randrange(4))]
        cost, audit, out = every_edit(rows)
        assert run(rows)[5:] == (cost, audit, sha(out)), rows


@pytest.mark.parametrize("size", [5, 63, 64, 65, 128, 129, 400])
def test_blocks_chain_to_the_optimum(size):
    r = random.Random(size)
    for mode in range(6):
        roles = [["user", "assistant"], ["tool"], ["user"], ["system", "user", "assistant", "tool"], ["tool", "user", "assistant"], ["assistant"]][mode]
        rows = [(roles[i % 2] if mode == 0 and r.random() < .9 else r.choice(roles), f"{i}{r.choice(['.', '.', ''])}" if r.random() < .9 else "") for i in range(size)]
        got = run(rows)
        assert got[5:7] == state_by_state(classes(rows))
        out, state, at = [], 0, iter(rows)
        for edit in got[6]:
            role, text = ("", "") if edit == "I" else next(at)
            if edit != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[0]] if edit == "K" else R.turn_due(state)
                out.append((role if edit == "K" else R.NAMES[state], text))
        assert fits("".join(role[0] for role, _ in out)) and got[7] == sha(out)


def expected(data):
    """Plain Python from table rows to the report."""
    by = defaultdict(list)
    for conv, turn, role, text in data:
        by[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        by[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort()
        told = [r[2:] for r in rows]
        kinds = classes(told)
        turns = [t for some, t, _, _ in rows if some]
        initials = [r[:1] for r, _ in told]
        cost, audit = state_by_state(kinds)
        out[conv] = ((max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), *(sum(f == k for _, f in kinds) for k in (R.BLANK, R.DUPLICATE, R.TRUNCATED)),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit)
    return out


def test_report_against_plain_python(spark):
    r = random.Random(9)
    data = []
    for conv in [*range(120), None]:
        n = r.choice([1, 2, 3, 6, 9, 150 if conv == 7 else 4])
        for t in range(n):
            turn = None if r.random() < .05 else t + (r.random() < .1) * 3
            data.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         r.choice([f"Text {t}.", f"cut {t}", "Same!", None, "", " ", "a\v\f ", " ? "])))
    data += [(500, 1, "user", "twice."), (500, 1, "user", "twice."), (500, 1, "assistant", "x" * 300_000)]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as _fault", "1 as cost", "2 as _kind")
    got = {x.conv_id: tuple(x)[1:8] for x in R.report(table.repartition(5)).collect()}
    assert got == expected(data)


def test_dropped_conversations_and_empty_tables(spark):
    dropped = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(x) for x in R.report(table).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.report(table.limit(0)).count() == 0


def test_one_shuffle(spark, sf_small):
    plan = R.report(spark.read.parquet(f"{sf_small}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm.repair import KEEP, NEXT, best_edits, digests, repair_conversations, search, transfers

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, edits) by dynamic programming over whole edit lists."""
    best = {0: (0, "")}

    def inserts(ways):
        for _ in range(2):
            more = dict(ways)
            for state, (cost, edits) in ways.items():
                new = cost + 3, edits + "I"
                more[NEXT[state]] = min(more.get(NEXT[state], new), new)
            ways = more
        return ways

    for row in rows:
        after = {}
        for state, (cost, edits) in inserts(best).items():
            extra = 3 if row.isupper() else 0
            steps = [(state, cost + 4, "D")]
            if row != "-":
                steps.append((NEXT[state], cost + 3 + extra, "R"))
                if (state, row.lower()) in KEEP:
                    steps.append((KEEP[state, row.lower()], cost + extra, "K"))
            for to, total, edit in steps:
                after[to] = min(after.get(to, (10**9, "")), (total, edits + edit))
        best = after
    return min(way for state, way in inserts(best).items() if state in (0, 3))


def brute(rows):
    """Every conversation's digest row, from (conv_id, turn, role, text, present)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(-1 if t is None else t, " " if r is None else r, " " if x is None else x, t) for c, t, r, x, p in rows if c == conv and p]
        mine.sort(key=lambda r: r[:3])
        faults, seen, symbols = [], set(), ""
        for _, role, text, _ in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in tuple("sua") else "x"
            symbols += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, edits = cheapest(symbols)
        turns = {t for *_, t in mine if t is not None}
        lines, source, last = [], iter(mine), None
        for edit in edits:
            row = None if edit == "I" else next(source)
            if edit == "D":
                continue
            last = row[1] if edit == "K" else {"user": "assistant"}.get("user" if last and last[0] == "u" else "", "user")
            lines.append(f"{last}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False)), cost, edits,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n, longest, seed=1):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(("user", "assistant")) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            role = rng.choice(("system", "", None, "tool")) if rng.random() < 0.06 else role
            text = rng.choice(("Fine.", "Really?\n", "cut off", "", None, " \t", f"Number {turn}!", f"Number {turn} é "))
            rows.append((None if conv == 3 else conv, None if rng.random() < 0.05 else turn, role, text, rng.random() < 0.9 and conv != 4))
    return rows


def test_search_against_all_ways():
    rng = random.Random(7)
    for _ in range(600):
        rows = "".join(rng.choice("uauauasxUASX-") for _ in range(rng.randrange(12)))
        assert search(rows) == cheapest(rows)
        assert best_edits(rows, segment=3) == cheapest(rows)


def test_edit_rules():
    assert best_edits("") == (0, "")
    assert best_edits("sua") == (0, "KKK")
    assert best_edits("u") == (3, "KI")
    assert best_edits("a") == (3, "IK")
    assert best_edits("-") == (4, "D")
    assert best_edits("uA") == (3, "KK")
    assert best_edits("s") == (4, "D")
    assert transfers("s", range(4))[0, 1] == (0, "K")
    assert (2, 1) not in transfers("s", range(4))


@pytest.mark.parametrize("sizes", [(4096, 1024), (5, 4)])
def test_against_brute(spark, sizes):
    rows = conversations(60, 24)
    frame = spark.createDataFrame(rows, SCHEMA + ", present boolean").withColumn("audit", F.lit(1)).repartition(4)
    parts = repair_conversations(frame, present=F.col("present"), most_rows=sizes[0], part_rows=sizes[1])
    got = {r.conv: tuple(r)[1:] for r in digests(parts).collect()}
    assert got == brute(rows)


def test_long_conversation(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Line {t}.", True) for t in range(3000) if t % 50]
    rows.append((8, 0, "user", "word " * 300_000 + "end.", True))
    frame = spark.createDataFrame(rows, SCHEMA + ", present boolean")
    for most in (4096, 500):
        got = {r.conv: tuple(r)[1:] for r in digests(repair_conversations(frame, most_rows=most, part_rows=100)).collect()}
        assert got == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert digests(repair_conversations(empty)).collect() == []
    rows = [(1, None, None, None), (1, None, None, None), (None, 5, "user", "Hi."), (None, 5, "user", "Hi.")]
    got = {r.conv: (r.blank, r.duplicate, r.cost, r.audit) for r in digests(repair_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: (2, 0, 8, "DD"), None: (0, 1, 7, "KDI")}

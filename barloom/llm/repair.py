"""Conversation structure repair: the cheapest edits that leave an optional system turn and then user and assistant in turn.

Edits are Delete, Insert, Keep and Rerole. A* with iterative deepening finds them: a depth-first search tries the edits of each row in
ASCII order under a cost bound, remembers the states that failed with what was left of the bound, and raises the bound to the least
cost that was cut off. The first accepting path is the answer, and the ASCII-least one of its cost.

A search spans at most ``SEGMENT`` rows. Longer conversations are cut into segments, searched from every state to every state. An
edit list of a segment ends with the edit of its last row, so no list is the beginning of another one of the same segment: cheapest
lists, ties ASCII-least, join to cheapest lists, ties ASCII-least. Conversations beyond ``most_rows`` or ``most_bytes`` are dealt to
tasks in parts of ``part_rows`` rows; only sixteen costs and ranks a part pass through one stream per conversation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.grouping import ordered
from barloom.llm.columns import stored

SEGMENT = 32
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
NEW, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row kept with this initial leads, and where an inserted or re-roled turn leads.
KEEP = {(NEW, "s"): SYSTEM, (NEW, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {NEW: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
ENDS = {NEW, ASSISTANT}
NEVER = 10**9
WHITE = " \t\n\x0b\x0c\r"

Found = tuple[int, str]


def symbol(role: str, fault: str | None) -> str:
    """One character a row: its initial (x: no role of the pattern), upper case where truncated, - where it has to go."""
    if fault in ("blank", "duplicate"):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == "truncated" else initial


def _least_costs(rows: str, after: str) -> tuple[list[int], list[int], list[str]]:
    """For every suffix: what its rows' faults cost at least, twice what its illegal pairs cost at least, and its first row that may stay.

    One edit mends at most two illegal pairs and costs 3, or 1 more than keeping it where it deletes a truncated row. ``after`` is a
    row that could follow the last one.
    """
    must, pairs, first = [0], [0], [after]
    for row in reversed(rows):
        if row == "-":
            must.append(must[-1] + DELETE)
            pairs.append(pairs[-1])
            first.append(first[-1])
        else:
            must.append(must[-1] + (CUT_OFF if row.isupper() else 0))
            pairs.append(pairs[-1] + _pair_price(row, first[-1]))
            first.append(row)
    return must[::-1], pairs[::-1], first[::-1]


def _pair_price(left: str, right: str) -> int:
    if (left + right).lower() in LEGAL:
        return 0
    return 1 if left.isupper() or right.isupper() else 3


def _entry_price(state: int, first: str) -> int:
    if (state, first.lower()) in KEEP:
        return 0
    return 1 if first.isupper() else 3


def search(rows: str, entry: int = NEW, goal: int | None = None) -> Found | None:
    """(cost, edits) from ``entry`` over all rows to ``goal``; without a goal, to an accepted end, with inserts after the last row."""
    if goal is not None and not _reachable(rows, entry, goal):
        return None
    must, pairs, first = _least_costs(rows, "a" if goal == USER else "u")
    n, path = len(rows), []

    def least(i: int, state: int) -> int:
        if goal in (NEW, SYSTEM):  # no row may stay but one system turn
            return NEVER if state > goal else DELETE * (n - i - (state < goal))
        return must[i] + (pairs[i] + _entry_price(state, first[i]) + 1) // 2

    def visit(i: int, state: int, left: int) -> bool:
        nonlocal beyond
        need = least(i, state)
        if need > left:
            beyond = min(beyond, need - left)
            return False
        if i == n and (state in ENDS if goal is None else state == goal):
            return True
        if failed.get((i, state), -1) >= left:
            return False
        for edit, step, to, cost in edits(i, state):
            path.append(edit)
            if visit(i + step, to, left - cost):
                return True
            path.pop()
        failed[i, state] = left
        return False

    def edits(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        row = rows[i] if i < n else ""
        if row:
            yield "D", 1, state, DELETE
        if row or goal is None:
            yield "I", 0, NEXT[state], INSERT
        if row and row != "-":
            extra = CUT_OFF if row.isupper() else 0
            kept = KEEP.get((state, row.lower()))
            if kept is not None:
                yield "K", 1, kept, extra
            yield "R", 1, NEXT[state], REROLE + extra

    bound = least(0, entry)
    while True:
        beyond, failed = NEVER, {}
        if visit(0, entry, bound):
            return bound, "".join(path)
        bound += beyond


def _reachable(rows: str, entry: int, goal: int) -> bool:
    if goal == NEW:
        return entry == NEW
    if goal == SYSTEM:
        return entry == SYSTEM or (entry == NEW and "s" in rows.lower())
    return len(rows) > 0


_search = lru_cache(maxsize=50_000)(search)


def best_edits(rows: str, segment: int = SEGMENT) -> Found:
    """(cost, edits) of a whole conversation."""
    return transfers(rows, [NEW], segment, only_ends=True)[NEW, None]


def transfers(rows: str, entries: Iterable[int], segment: int = SEGMENT, only_ends: bool = False) -> dict[tuple[int, int | None], Found]:
    """The best (cost, edits) for every entry and every goal that can be reached; goal None: an accepted end of the conversation."""
    cuts = [rows[i:i + segment] for i in range(0, len(rows), segment)] or [""]
    found: dict[tuple[int, int | None], Found] = {}
    for entry in entries:
        best: dict[int, Found] = {entry: (0, "")}
        for i, cut in enumerate(cuts):
            goals: list[int | None] = list(range(4))
            if i == len(cuts) - 1:
                goals = [None] if only_ends else [*goals, None]
            after: dict[int | None, Found] = {}
            for state, (cost, edits) in best.items():
                for goal in goals:
                    step = _search(cut, state, goal)
                    if step is not None:
                        new = cost + step[0], edits + step[1]
                        after[goal] = min(after.get(goal, new), new)
            best = after
        found |= {(entry, goal): way for goal, way in best.items()}
    return found


def apply_edits(edits: str, rows: Iterable[tuple[str, str]], state: int = NEW) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) turns, and the state after them."""
    source, out = iter(rows), []
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        state = KEEP[state, role[:1]] if edit == "K" else NEXT[state]
        out.append((role if edit == "K" else NAMES[state], text))
    return out, state


def fault_of(role: str, text: str, seen: set[tuple[str, str]]) -> str | None:
    """The first fault of a row: blank, duplicate, truncated or none; the row is then seen."""
    bare = text.rstrip(WHITE)
    if not bare:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return None if bare[-1] in ".!?" else "truncated"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _report(conv: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), T.StructField("part", T.LongType()), T.StructField("n_parts", T.LongType()),
                         *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("turns", TURNS)])


ARROW_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None,
    most_rows: int = 4096, most_bytes: int = 2**24, part_rows: int = 1024,
) -> DataFrame:
    """Repaired conversations: (conv, part, n_parts, gaps, blank, duplicate, truncated, illegal, cost, audit, turns).

    Rows stand in the order of turn (null first), role, text. Null role and text count as one space; null conversations are one
    conversation; equal rows are duplicates of each other; a role that begins with none of s, u, a (also an empty one) can't be kept.
    Rows for which ``present`` is not true do not count, but their conversation has its row: all zeros where no row is left.

    A conversation has one row (part 0 of 1), unless it is longer than ``most_rows`` or ``most_bytes``: then one per ``part_rows`` rows,
    whose counts add up, whose audits and turns join in the order of ``part``, and whose gaps stand in part 0.
    """
    name = F.when(F.col(conv).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    slim = rows.select(name.alias("key"), F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                       F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), here.alias("here"))
    sizes = slim.filter("here").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    long = sizes.filter((F.col("n") > most_rows) | (F.col("b") > most_bytes)).select("key")
    if long.isEmpty():
        return _gathered(slim)
    long = stored(long)
    return _gathered(slim.join(long, "key", "left_anti")).unionByName(_in_parts(slim.join(long, "key", "left_semi").filter("here"), part_rows))


def _gathered(slim: DataFrame) -> DataFrame:
    """Conversations of bounded size, streamed one after the other through sorted partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, key, conv, held = 0, None, None, []
        for batch in batches:
            schema = batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != key:
                    if key is not None:
                        out.append((conv, *_repaired(held)))
                        size += sum(len(r[2]) for r in held) + 100
                        if size > 2**22:
                            yield _as_batch(out, schema.field("conv").type)
                            out, size = [], 0
                    key, conv, held = row[0], row[1], []
                if row[5]:
                    held.append(row[2:5])
        if key is not None:
            out.append((conv, *_repaired(held)))
            yield _as_batch(out, schema.field("conv").type)

    sorted_rows = slim.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return sorted_rows.mapInArrow(work, _report(slim.schema["conv"].dataType))


def _repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    seen: set[tuple[str, str]] = set()
    faults = [fault_of(role, text, seen) for _, role, text in rows]
    cost, edits = best_edits("".join(symbol(r[1], f) for r, f in zip(rows, faults, strict=True)))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    repaired, _ = apply_edits(edits, [r[1:] for r in rows])
    return (0, 1, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], _illegal([r[1][:1] for r in rows]), cost, edits,
            [{"role": r, "text": t} for r, t in repaired])


def _as_batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [conv, *[pa.int64()] * 8, pa.string(), ARROW_TURNS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                      ["conv", "part", "n_parts", *COUNTS, "audit", "turns"])


def _in_parts(slim: DataFrame, part_rows: int) -> DataFrame:
    """Conversations of any size: parts of ``part_rows`` rows, solved apart, tied together by their costs and ranks."""
    placed = ordered(slim.drop("here"), ["key"], ["turn", "role", "text"], "at")
    placed = stored(placed.withColumn("at", F.col("at") - 1).withColumn("part", F.floor(F.col("at") / part_rows)))
    marks = placed.select("key", "conv", "turn", "at", "part", F.substring("role", 1, 1).alias("initial"),
                          F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("digest"),
                          F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1).alias("last"))
    firsts = marks.groupBy("key", "digest").agg(F.min("at").alias("first"))
    fault = (F.when(F.col("last") == "", "blank").when(F.col("first") < F.col("at"), "duplicate")
             .when(~F.col("last").isin(".", "!", "?"), "truncated"))
    judged = marks.join(firsts, ["key", "digest"]).select("key", "part", "at", "initial", fault.alias("fault"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        initials, faults = rows["initial"].tolist(), rows["fault"].tolist()
        ways = transfers("".join(symbol(i, f) for i, f in zip(initials, faults, strict=True)), range(4))
        costs, ranks, edits = [], [], []
        for entry in range(4):
            order = sorted(ways[entry, g][1] for g in range(4) if (entry, g) in ways)
            for goal in [*range(4), None]:
                cost, way = ways.get((entry, goal), (-1, ""))
                costs.append(cost)
                ranks.append(order.index(way) if goal is not None and cost >= 0 else 0)
                edits.append(way)
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "part": [rows["part"].iloc[0]], "costs": [costs], "ranks": [ranks], "edits": [edits],
                             **{f: [faults.count(f)] for f in ("blank", "duplicate", "truncated")}, "illegal": [_illegal(initials)],
                             "head": [initials[0]], "tail": [initials[-1]]})

    solved = stored(judged.groupBy("key", "part").applyInPandas(
        solve, "key string, part long, costs array<long>, ranks array<long>, edits array<string>, blank long, duplicate long, truncated long, "
               "illegal long, head string, tail string"))
    chosen = _chosen(solved.select("key", "part", "costs", "ranks", "head", "tail"))
    turns = placed.filter(F.col("turn").isNotNull()).groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    totals = placed.groupBy("key").agg(F.first("conv").alias("conv"), (F.max("part") + 1).alias("n_parts")).join(turns, "key", "left")
    slot = F.col("entry") * 5 + F.col("goal")
    parts = stored(solved.join(chosen, ["key", "part"]).join(totals, "key").select(
        "conv", "key", "part", "n_parts", F.when(F.col("part") == 0, F.coalesce("gaps", F.lit(0))).otherwise(0).alias("gaps"), "blank", "duplicate",
        "truncated", (F.col("illegal") + F.col("joint")).alias("illegal"), F.get("costs", slot.cast("int")).alias("cost"),
        F.get("edits", slot.cast("int")).alias("audit"), "entry"))

    def rebuild(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        turns, _ = apply_edits(rows["audit"].iloc[0], zip(rows["role"], rows["text"], strict=True), int(rows["entry"].iloc[0]))
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "part": [rows["part"].iloc[0]], "turns": [[{"role": r, "text": t} for r, t in turns]]})

    texts = placed.select("key", "part", "at", "role", "text").join(parts.select("key", "part", "audit", "entry"), ["key", "part"])
    rebuilt = texts.groupBy("key", "part").applyInPandas(
        rebuild, T.StructType([T.StructField("key", T.StringType()), T.StructField("part", T.LongType()), T.StructField("turns", TURNS)]))
    return parts.join(rebuilt, ["key", "part"]).select("conv", "part", "n_parts", *COUNTS, "audit", "turns")


def _chosen(solved: DataFrame) -> DataFrame:
    """(key, part, entry, goal, joint): the way through the parts of each conversation, and whether its border to the part before is
    illegal. Parts stream by twice, backwards for the best goal of every entry, forwards for the entry; four costs are held."""

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, [0] * 4
        for batch in batches:
            goals = []
            for k, costs, ranks in zip(*[batch.column(c).to_pylist() for c in ("key", "costs", "ranks")], strict=True):
                if k != key:
                    key, best = k, [(costs[5 * e + 4], 0, 4) for e in range(4)]
                else:
                    best = [min((costs[5 * e + g] + value[g], ranks[5 * e + g], g) for g in range(4) if costs[5 * e + g] >= 0) for e in range(4)]
                value = [b[0] for b in best]
                goals.append([b[2] for b in best])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "part", "head", "tail")], pa.array(goals, pa.list_(pa.int64()))],
                                             ["key", "part", "head", "tail", "goals"])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, tail = None, NEW, ""
        for batch in batches:
            out = []
            for k, head, end, goals in zip(*[batch.column(c).to_pylist() for c in ("key", "head", "tail", "goals")], strict=True):
                first = k != key
                key, state = k, NEW if first else state
                out.append((state, goals[state], 0 if first or tail + head in LEGAL else 1))
                state, tail = goals[state], end
            ways = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), *ways], ["key", "part", "entry", "goal", "joint"])

    down = solved.repartition("key").sortWithinPartitions("key", F.desc("part"))
    ends = down.mapInArrow(backwards, "key string, part long, head string, tail string, goals array<long>")
    return ends.sortWithinPartitions("key", "part").mapInArrow(forwards, "key string, part long, entry long, goal long, joint long")


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation: its counts, whole audit, and the SHA-256 of its ``role:text`` turns joined by line feeds.

    A digest is one sequence: the parts of a long conversation stream by in order, one part at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = parts.filter("n_parts = 1").select("conv", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        digest, key, conv, any_line = None, None, None, False
        done: list[tuple] = []
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("conv").type
            for k, c, text, n in zip(*[batch.column(x).to_pylist() for x in ("key", "conv", "lines", "n")], strict=True):
                if k != key:
                    if key is not None:
                        done.append((conv, digest.hexdigest()))
                    digest, key, conv, any_line = hashlib.sha256(), k, c, False
                if n:
                    digest.update((("\n" if any_line else "") + text).encode())
                    any_line = True
        if key is not None:
            done.append((conv, digest.hexdigest()))
            convs, hexes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hexes)], ["conv", "repaired_sha256"])

    name = F.when(F.col("conv").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    cut = parts.filter("n_parts > 1").withColumn("key", name)
    hashes = (cut.select("key", "conv", "part", lines.alias("lines"), F.size("turns").alias("n")).repartition("key").sortWithinPartitions("key", "part")
              .mapInArrow(stream, T.StructType([T.StructField("conv", parts.schema["conv"].dataType), T.StructField("repaired_sha256", T.StringType())])))
    totals = cut.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    joined = hashes.withColumn("key", name).join(totals, "key").select("conv", *COUNTS, "audit", "repaired_sha256")
    return whole.unionByName(joined)

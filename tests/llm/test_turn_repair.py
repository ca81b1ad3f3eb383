"""Conversation repair against a search over all edits, and the same rows in one task and in many."""

import re
import zlib
from collections import Counter
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pacelake.llm import turn_repair as T
from test_llm import prose

LONG = prose(77, 60_000) + "."
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(rows):
    """Counts, cost, audit and repaired lines of rows (turn, role, text) in order, by cheapest-first search over all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if (state, role[0]) in GRAMMAR:
                heappush(heap, (cost + 3, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in GRAMMAR:
                    heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in GRAMMAR:
                        heappush(heap, (cost + 3 + late, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()


def whole(rows):
    part = T.Part()
    for turn, role, text in rows:
        part.add(turn, role, text, 1)
    edits, _, cost = part.edits()
    lines = [f"{r}:{t}" for _, own in edits for r, t in own]
    return part.gaps(), *part.faults[1:], part.illegal, cost, "".join(x for x, _ in edits), sha256("\n".join(lines).encode()).hexdigest()


ROWS = st.lists(st.tuples(st.sampled_from([None, 0, 1, 2, 5]), st.sampled_from(["user", "assistant", "system", "s", "tool", "", " "]), st.sampled_from(["A.", "B", "c!", " ", "", "d? ", "e .x"])), max_size=9).map(lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_repair_is_the_cheapest_and_least(rows):
    assert whole(rows) == plain(rows)


def long_rows(n, seed):
    rng = np.random.default_rng(seed)
    roles = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"], n)
    return [(i - i % 3 if i % 7 else None, str(roles[i]), f"text {i % (n // 2 + 1)}" + "..!? "[int(rng.integers(0, 5))]) for i in range(n)]  # not by turn


@pytest.mark.parametrize("n", [64, 65, 128, 300])
def test_blocks_give_what_one_search_gives(n):
    rows = long_rows(n, n)
    assert whole(rows)[1:] == plain(rows)[1:]


@settings(max_examples=150, deadline=None)
@given(ROWS, st.lists(st.integers(0, 9), max_size=3))
def test_parts_of_a_conversation_meet(rows, cuts):
    at = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    parts, seen = [], set()
    for a, b in zip(at, at[1:]):
        part = T.Part()
        for turn, role, text in rows[a:b]:
            part.add(turn, role, text, 1, (role, text) in seen)
        seen |= {(role, text) for _, role, text in rows[a:b]}
        parts.append(part)
    ends, after = T.END, []
    for p in reversed(parts):
        after.append(ends)
        m = T.matrix(p.live())
        ends = tuple(min(T.FAR, *(m[4 * q + to] + ends[to] for to in range(4))) for q in range(4))
    q, audit, lines = T.START, "", []
    for p, end in zip(parts, reversed(after)):
        edits, q, _ = p.edits(q, end)
        audit += "".join(x for x, _ in edits)
        lines += [f"{r}:{t}" for _, own in edits for r, t in own]
    want = plain(rows)
    forced = sum(p.faults[1] + p.faults[2] for p in parts)
    assert (ends[0] + 4 * forced, audit, sha256("\n".join(lines).encode()).hexdigest()) == want[-3:]


SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """rows with what the report does to them, by conversation; rows of one turn stay in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        mark = lambda v: " " if v is None else v
        role, text = mark(role), mark(text)
        act = zlib.crc32(f"{mark(conv)}:{mark(turn)}".encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        own += [(turn, "user" if act == 4 else role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for k, v in out.items()}


def report(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in T.repair_report(df).collect()}


def clashing(df):
    for c in ("part", "pos", "copies", "digest", "hash_", "salt_", "act_", "lines", "audit", "repeated"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("coalesced", [True, False])
def test_report_of_many_conversations(spark, coalesced):
    rng = np.random.default_rng(11)
    rows = [(c, t, str(rng.choice(["user", "assistant", "assistant", "user", "system"])), f"w{int(rng.integers(0, 40))}{'.!? '[int(rng.integers(0, 4))]}") for c in range(120) for t in range(int(rng.integers(1, 9)))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"hot {t % 150}.") for t in range(1_500)]  # half of all rows
    rows += [(None, 1, "user", LONG), (None, 2, "assistant", None), (600, None, "user", "a."), (600, 1, None, "b."), (600, 2, "", "b."), (601, None, None, None), (602, -5, "system", "x" + LONG), (602, 1 << 40, "assistant", "y.")]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(coalesced).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "4" if coalesced else "16")
    try:
        got = report(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: plain(v) for k, v in damage(rows).items()}


def test_equal_rows_of_one_turn_over_many_tasks(spark):
    rows = [(1, 7, "user", "same.")] * 600 + [(2, 0, "user", "q?"), (2, 1, "assistant", "a.")] + [(0, 0, "user", "only")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: r for r in T.repair(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got[1]["duplicate"], got[1]["cost"], got[1]["audit"]) == (599, 599 * 4 + 3, "K" + "D" * 599 + "I")
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "same."), ("assistant", "")]
    assert got[2]["audit"] == "KK" and [tuple(t) for t in got[2]["turns"]] == [("user", "q?"), ("assistant", "a.")]
    assert (got[0]["truncated"], got[0]["cost"], got[0]["audit"], got[0]["turns"]) == (1, 4, "D", [])


def test_dropped_and_empty(spark):
    gone = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    assert report(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)) == {gone: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    assert report(spark.createDataFrame([], SCHEMA)) == {}

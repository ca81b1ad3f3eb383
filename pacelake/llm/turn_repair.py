r"""Repair of the structure of conversations: the cheapest edits that make the roles of each one fit a grammar.

A conversation's role initials must be `(s?(ua)+)?`: nothing, or an optional system turn and then pairs of user and
assistant. A row is kept (0), given the role user or assistant (3) or deleted (4, required where it is blank or
repeats an earlier role and text); a turn without text may be inserted anywhere (3); a truncated row that
is not deleted costs 3 more. The audit has the edits' initials in order; of equally cheap ones the least counts.

The search goes by cost layers, in the manner of Wu and Manber: layer c has, for each turn, the bitset of grammar states from
which the rest of the conversation can be brought to its end for at most c. A layer follows from the layers three, four
and six below it and, where a row is kept as it is, from its own next turn. Layers are made for c = 0, 1, 2, ...; the first that
accepts the start gives the cost, and a walk along the bits, taking the least initial that stays within it, the audit. Long
conversations are cut into blocks of BLOCK turns: what each state costs at a block's start follows from what it costs at its end.

Rows are range-sorted by conversation and turn, so a conversation of any size is spread over as many tasks as it fills. What lies within a
task is repaired there; the first and last conversation of each task may go on elsewhere. For these, repeated
texts are found by a shuffle of digests, each task's part is summed up by the cost between any two of its end states (a matrix
of sixteen numbers), and the driver, which gets at most two parts a task, finds the state in which each part begins. Only the
digest of the repaired text of such a conversation is made in one task, row by row.

Defined results: a null role or text counts as one space (so the row is blank, or its role fits nowhere), and so does an empty role; a
null conversation is one of its own; rows without a turn come first; rows of one turn are ordered by role and by a hash of the text; a
conversation whose rows are all dropped has zeros, an empty audit and no text; other columns are ignored; texts of any length are read whole;
an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dealt, small_batches
from .merkle import crc32_sql

#: Grammar states as bits: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = (1, 2, 4, 8)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that can be inserted in each state, and the state after it.
NEXT = {q: next((role, AFTER[q, role[0]]) for role in ("user", "assistant") if (q, role[0]) in AFTER) for q in STATES}
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
FAR = 1 << 60
#: What each state costs at the end of a conversation.
END = (0, FAR, FAR, 0)
#: Turns of a block.
BLOCK = 64
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def _before(symbol: str) -> tuple[int, ...]:
    """For each set of states, the states from which symbol leads into it."""
    return tuple(sum(q for (q, x), to in AFTER.items() if x == symbol and to & into) for into in range(16))


NOWHERE = (0,) * 16
BEFORE = {x: _before(x) for x in "sua"}
#: The same for a turn that may get either role.
EITHER = tuple(a | b for a, b in zip(BEFORE["u"], BEFORE["a"]))

#: A turn that need not go: initial of its role, and whether it is truncated.
Live = tuple[str, bool]


def layers(turns: list[Live], ends: tuple[int, ...], wanted: int) -> list[list[int]]:
    """Cost layers of a block, until all states of wanted are in the first turn's set. Six empty ones come first; ends count from the least of them."""
    n, low = len(turns), min(ends)
    own = [(BEFORE.get(x, NOWHERE), late) for x, late in turns]
    out = [[0] * (n + 1)] * 6
    while True:
        c = len(out) - 6
        three, four, six = out[-3], out[-4], out[-6]
        at = [0] * (n + 1)
        kept = at[n] = sum(q for q, e in zip(STATES, ends) if e - low <= c) | EITHER[three[n]]
        for i in range(n - 1, -1, -1):
            keep, late = own[i]
            if late:
                kept = keep[three[i + 1]] | EITHER[six[i + 1]]
            else:
                kept = keep[kept] | EITHER[three[i + 1]]
            kept |= four[i + 1] | EITHER[three[i]]
            at[i] = kept
        out.append(at)
        if kept & wanted == wanted:
            return out


def costs(turns: list[Live], ends: tuple[int, ...]) -> tuple[int, ...]:
    """What each state costs before a block, if ends is what each costs after it."""
    can = sum(q for q, e in zip(STATES, ends) if e < FAR)
    can |= EITHER[can]
    can |= EITHER[can]
    for x, _ in reversed(turns):
        can |= BEFORE.get(x, NOWHERE)[can] | EITHER[can]
        can |= EITHER[can]
    found = layers(turns, ends, can)[6:]
    low = min(ends)
    return tuple(low + next(c for c, at in enumerate(found) if at[0] & q) if q & can else FAR for q in STATES)


def _ends(turns: list[Live], ends: tuple[int, ...]) -> list[tuple[int, ...]]:
    """What each state costs before each block (one without turns too: a turn may be inserted there), and after the last."""
    out = [ends]
    for a in range(max(0, len(turns) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        out.append(costs(turns[a : a + BLOCK], out[-1]))
    return out[::-1]


def matrix(turns: list[Live]) -> list[int]:
    """The cost from each state before the turns to each state after them, row by row."""
    by_end = [_ends(turns, tuple(0 if q == to else FAR for q in STATES))[0] for to in STATES]
    return [by_end[to][q] for q in range(4) for to in range(4)]


def walk(turns: list[Live], start: int = START, ends: tuple[int, ...] = END) -> tuple[list[tuple[str, str | None]], int, int]:
    """The least audit: for each turn, and once more at the end, the initials of what is done up to it, and the role it ends with (None: its own or none); the last state; and the cost."""
    after = _ends(turns, ends) if len(turns) > BLOCK else [(), ends]
    out: list[tuple[str, str | None]] = []
    cost, q = None, start
    for k, bounds in enumerate(after[1:]):
        block = turns[k * BLOCK : (k + 1) * BLOCK]
        found = layers(block, bounds, q)
        low, left = min(bounds), len(found) - 7
        if cost is None:
            cost = low + left
        for i, (x, late) in enumerate(block):
            more = CUT if late else 0
            done = ""
            while True:
                role, to = NEXT[q]
                own = AFTER.get((q, x), 0)
                if found[left + 6 - DELETE][i + 1] & q:
                    left -= DELETE
                    out.append((done + "D", None))
                elif found[left + 6 - INSERT][i] & to:
                    left -= INSERT
                    done, q = done + "I", to
                    continue
                elif found[left + 6 - more][i + 1] & own:
                    left, q = left - more, own
                    out.append((done + "K", None))
                else:
                    left, q = left - RENAME - more, to
                    out.append((done + "R", role))
                break
    done = ""
    while ends[STATES.index(q)] - low != left:
        done, q, left = done + "I", NEXT[q][1], left - INSERT
    return [*out, (done, None)], q, cost


def fault(text: str) -> int:
    """BLANK, TRUNCATED or 0."""
    end = text.rstrip(SPACE)
    return BLANK if not end else 0 if end[-1] in ".!?" else TRUNCATED


class Part:
    """Rows of one conversation in order, with what is counted of them."""

    def __init__(self):
        self.rows: list[tuple[str, str, int]] = []  # role, text, fault
        self.seen: set[tuple[str, str]] = set()
        self.turns: list[int] = []  # distinct ones
        self.faults = [0, 0, 0, 0]
        self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, repeated: bool = False) -> None:
        bad = fault(text)
        for _ in range(copies):
            own = bad
            if bad != BLANK and (repeated or (role, text) in self.seen):
                own = DUPLICATE
            self.seen.add((role, text))
            self.faults[own] += 1
            if self.rows:
                self.illegal += self.rows[-1][0][:1] + role[:1] not in ("su", "ua", "au")
            self.rows.append((role, text, own))
        if copies and turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def live(self) -> list[Live]:
        return [(role[:1], bad == TRUNCATED) for role, _, bad in self.rows if bad not in (BLANK, DUPLICATE)]

    def edits(self, start: int = START, ends: tuple[int, ...] = END) -> tuple[list[tuple[str, list[tuple[str, str]]]], int, int]:
        """For each row, and once more for the end: the initials, and the repaired turns (role, text); the last state; the cost."""
        done, q, cost = walk(self.live(), start, ends)
        out, k, state = [], 0, start

        def inserted(initials: str) -> list[tuple[str, str]]:
            nonlocal state
            made = []
            for _ in range(initials.count("I")):
                role, state = NEXT[state]
                made.append((role, ""))
            return made

        for role, text, bad in self.rows:
            if bad in (BLANK, DUPLICATE):
                out.append(("D", []))
                continue
            initials, given = done[k]
            k += 1
            lines = inserted(initials)
            if initials[-1] != "D":
                lines.append((given or role, text))
                state = AFTER[state, (given or role)[0]]
            out.append((initials, lines))
        out.append((done[k][0], inserted(done[k][0])))
        return out, q, cost + DELETE * (self.faults[BLANK] + self.faults[DUPLICATE])

    def gaps(self) -> int:
        return self.turns[-1] - self.turns[0] + 1 - len(self.turns) if self.turns else 0


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_OPEN = "part int, pos long, turn long, role string, text string, copies int"
_OPEN_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
_LINES, _TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), "lines array<struct<role: string, text: string>>"
_NAMES = [x.split()[0] for x in f"{RESULT}, {_OPEN}, lines".split(", ")]


def _put(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def _sweep(sorted_rows: DataFrame, with_turns: bool) -> DataFrame:
    """Results of the conversations that lie within a task; rows (part, pos, ...) of the first and the last one of each."""

    def whole(key, part: Part) -> tuple:
        edits, _, cost = part.edits()
        lines = [x for _, own in edits for x in own]
        audit = "".join(x for x, _ in edits)
        digest = sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()
        return key, part.gaps(), *part.faults[1:], part.illegal, cost, audit, digest, *(None,) * 6, lines if with_turns else None

    def rows_of(number: int, batches):
        first, key, held, at = True, None, [], 0
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns):
                if at and row[0] != key:
                    if not first:
                        part = Part()
                        for x in held:
                            part.add(*x[1:])
                        yield whole(key, part)
                    first, held = False, []
                key = row[0]
                if first:  # it may have begun in the task before
                    yield row[0], *(None,) * 8, number, at, *row[1:], None
                else:
                    held.append(row)
                at += 1
        for i, row in enumerate(held):
            yield row[0], *(None,) * 8, number, at - len(held) + i, *row[1:], None

    def run(batches):
        made, size = [], 0
        for row in rows_of(TaskContext.get().partitionId(), batches):
            made.append(row)
            size += 500 + len(row[-3] or "") + sum(len(text) for _, text in row[-1] or ())
            if size > 4 << 20:
                yield _put(made, kinds, _NAMES)
                made, size = [], 0
        if made:
            yield _put(made, kinds, _NAMES)

    kinds = [*_KINDS, *_OPEN_KINDS, _LINES]
    return sorted_rows.mapInArrow(run, f"{RESULT}, {_OPEN}, {_TURNS}")


def _parts(rows: DataFrame, make, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows that make(conversation, task, its Part) gives for the part of each conversation in each task."""
    names = [x.split()[0] for x in schema.replace(_TURNS, "lines").split(", ")]

    def run(batches):
        key, part = None, None
        for b in batches:
            for conv, number, _, turn, role, text, copies, repeated in zip(*(c.to_pylist() for c in b.columns)):
                if part is None or key != (conv, number):
                    if part is not None and (made := make(*key, part)):
                        yield _put(made, kinds, names)
                    key, part = (conv, number), Part()
                part.add(turn, role, text, copies, repeated)
        if part is not None and (made := make(*key, part)):
            yield _put(made, kinds, names)

    own = rows.select("conv_id", "part", "pos", "turn", "role", "text", "copies", "repeated")
    return own.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(run, schema)


def _open(rows: DataFrame, scratch: Scratch, with_turns: bool) -> DataFrame:
    """Results of the conversations that may span tasks, from their rows (conv_id, part, pos, turn, role, text, copies)."""
    spark = rows.sparkSession
    # digests of role and text that come again, with the place of the first; summed up before the shuffle
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    named = rows.withColumn("digest", digest)
    here = F.struct("part", "pos")
    again = named.where("copies > 0").groupBy("conv_id", "digest").agg(F.min(here).alias("least"), F.count("*").alias("n")).where("n > 1")
    again = scratch.save(again.select(F.col("conv_id").alias("conv_"), "digest", "least"), "again")
    judged = named.join(dealt(again), F.col("conv_id").eqNullSafe(F.col("conv_")) & (named["digest"] == again["digest"]), "left")
    judged = scratch.save(judged.select("conv_id", "part", "pos", "turn", "role", "text", "copies", F.coalesce(here > F.col("least"), F.lit(False)).alias("repeated")), "judged")

    def summed(conv, number, part):
        ends = (part.rows[0][0][:1], part.rows[-1][0][:1]) if part.rows else (None, None)
        spans = (part.turns[0], part.turns[-1]) if part.turns else (None, None)
        return [(conv, number, matrix(part.live()), *part.faults[1:], part.illegal, *ends, *spans, len(part.turns))]

    schema = "conv_id long, part int, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, n_turns long"
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
    conversations: dict[int | None, list] = {}
    # at most two rows a task
    for p in sorted(scratch.save(_parts(judged, summed, schema, kinds), "parts").collect(), key=lambda p: p["part"]):
        conversations.setdefault(p["conv_id"], []).append(p)

    after: dict[tuple, tuple[int, ...]] = {}  # what each state costs after a part
    results = []
    for conv, parts in conversations.items():
        ends = END
        for p in reversed(parts):
            after[conv, p["part"]] = ends
            ends = tuple(min(FAR, *(p["matrix"][4 * q + to] + ends[to] for to in range(4))) for q in range(4))
        full = [p for p in parts if p["first"] is not None]
        illegal = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in pairwise(full))
        timed = [p for p in parts if p["n_turns"]]
        distinct = sum(p["n_turns"] for p in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in pairwise(timed))
        gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
        total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")}
        results.append((conv, gaps, *total.values(), illegal, ends[0] + DELETE * (total["blank"] + total["duplicate"])))

    def states(conv, number, part):
        return [(conv, number, [walk(part.live(), q, after[conv, number])[1] if n < FAR else 0 for q, n in zip(STATES, _ends(part.live(), after[conv, number])[0])])]

    into = {(r["conv_id"], r["part"]): r["states"] for r in _parts(judged, states, "conv_id long, part int, states array<int>", [pa.int64(), pa.int32(), pa.list_(pa.int32())]).collect()}
    begins: dict[tuple, int] = {}
    for conv, parts in conversations.items():
        q = START
        for p in parts:
            begins[conv, p["part"]] = q
            q = into[conv, p["part"]][STATES.index(q)]

    def edited(conv, number, part):
        made, _, _ = part.edits(begins[conv, number], after[conv, number])
        return [(conv, number, i, initials, lines) for i, (initials, lines) in enumerate(made)]

    edits = _parts(judged, edited, f"conv_id long, part int, i long, initials string, {_TURNS}", [pa.int64(), pa.int32(), pa.int64(), pa.string(), _LINES])

    def join(batches):
        key, digest, audit, lines, any_ = None, None, [], [], False

        def result():
            return _put([(key[0], "".join(audit), digest.hexdigest(), lines if with_turns else None)], [pa.int64(), pa.string(), pa.string(), _LINES], ["conv_", "audit", "repaired_sha256", "lines"])

        for b in batches:
            for conv, initials, own in zip(*(b.column(c).to_pylist() for c in ("conv_id", "initials", "lines"))):
                if key != (conv,):
                    if key is not None:
                        yield result()
                    key, digest, audit, lines, any_ = (conv,), sha256(), [], [], False
                audit.append(initials)
                for x in own:
                    digest.update(f"{'\n' if any_ else ''}{x['role']}:{x['text']}".encode())
                    any_ = True
                if with_turns:
                    lines += own
        if key is not None:
            yield result()

    joined = edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i").mapInArrow(join, f"conv_ long, audit string, repaired_sha256 string, {_TURNS}")
    # at most two rows a task
    counted = F.broadcast(spark.createDataFrame(results, RESULT.rpartition(", audit")[0]))
    return joined.join(counted, F.col("conv_id").eqNullSafe(F.col("conv_"))).select(*_NAMES[:9], "lines")


def _repair(turns: DataFrame, with_turns: bool) -> DataFrame:
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "turns")
    # short keys, as a range sort gathers a sample of them; the last one parts equal rows too
    order = ["conv_id", "turn", "role", "hash_", "salt_"]
    rows = turns.withColumns({"hash_": F.xxhash64("text"), "salt_": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash_", "salt_")
    swept = scratch.save(_sweep(rows, with_turns), "swept")
    rest = swept.where("part is not null").select("conv_id", "part", "pos", "turn", "role", "text", "copies")
    done = swept.where("part is null").select(*_NAMES[:9], "lines")
    return done if rest.isEmpty() else done.unionByName(_open(rest, scratch, with_turns))


def _own(rows: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)  # noqa: E731
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), F.lit(1).alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit, and turns: the repaired conversation as an array of struct(role, text)."""
    return _repair(_own(rows), True).select(*_NAMES[:9], F.col("lines").alias("turns"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as an unsteady source would give them, by the hash of conversation and turn: some twentieth each dropped (copies 0), emptied, without sentence ends, repeated (copies 2), and said by the user."""
    own = _own(rows)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    own = own.withColumn("act_", F.crc32(key) % 20)
    act: Column = F.col("act_")
    text = F.when(act <= 1, "").when(act == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    return own.select(
        "conv_id", "turn", F.when(act == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(act == 0, 0).when(act == 3, 2).otherwise(1).alias("copies")
    )  # fmt: skip


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged conversations."""
    return _repair(damaged(rows), False).drop("lines")


def oracle() -> str:
    """SQL of repair_report: the cheapest, then least, audit for each state after each row, row by row."""
    number = {q: i for i, q in enumerate(STATES)}
    inserted = []
    for q in STATES:  # none, one or two turns before a row or at the end
        at, lines = q, []
        for _ in range(3):
            inserted.append(f"({number[q]}, {number[at]}, {len(lines)}, [{', '.join(repr(x) for x in lines)}]::VARCHAR[])")
            role, at = NEXT[at]
            lines.append(f"{role}:")
    given = [f"({number[q]}, '{role}', {number[to]})" for q, (role, to) in NEXT.items()]
    kept = [f"({number[q]}, '{x}', {number[to]})" for (q, x), to in AFTER.items()]
    mark = lambda c: f"coalesce({c}::VARCHAR, ' ')"  # noqa: E731
    crc = crc32_sql(f"{mark('conv_id')} || ':' || {mark('turn')}")
    return rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, {mark('role')} AS role, {mark('text')} AS text, {crc} % 20 AS act FROM conversations),
r AS (SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE act WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 3 ELSE 0 END AS fault,
  i > 0 AND lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
ins(q, qi, k, own) AS (VALUES {', '.join(inserted)}), given(qi, role, q2) AS (VALUES {', '.join(given)}), kept(qi, initial, q2) AS (VALUES {', '.join(kept)}),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM f UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT w.conv_id, w.i + 1 AS i, a.q, w.cost + {INSERT} * ins.k + a.cost AS cost, w.audit || repeat('I', ins.k) || a.letter AS audit, w.lines || ins.own || a.own AS lines
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i JOIN ins ON ins.q = w.q JOIN LATERAL (
      SELECT ins.qi AS q, {DELETE} AS cost, 'D' AS letter, []::VARCHAR[] AS own
      UNION ALL SELECT kept.q2, CASE f.fault WHEN 3 THEN {CUT} ELSE 0 END, 'K', [f.role || ':' || f.text] FROM kept WHERE kept.qi = ins.qi AND kept.initial = left(f.role, 1) AND f.fault NOT IN (1, 2)
      UNION ALL SELECT given.q2, CASE f.fault WHEN 3 THEN {RENAME + CUT} ELSE {RENAME} END, 'R', [given.role || ':' || f.text] FROM given WHERE given.qi = ins.qi AND f.fault NOT IN (1, 2)) a ON true)
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT n.*, w.cost + {INSERT} * ins.k AS cost, w.audit || repeat('I', ins.k) AS audit, w.lines || ins.own AS lines FROM n JOIN w ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n JOIN ins ON ins.q = w.q AND ins.qi IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY n.conv_id ORDER BY w.cost + {INSERT} * ins.k, w.audit || repeat('I', ins.k)) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = oracle()

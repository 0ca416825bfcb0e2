"""Repair of conversations whose turns are out of form, by the cheapest edits.

A conversation is well formed if its roles begin with s, u and a for system, user and assistant
in the order ``(s?(ua)+)?``. The edits go through the turns in order: Keep (0), Rerole a turn to
user or assistant (2), Delete it (3; blank and repeated turns must go), Insert an empty turn of
user or assistant anywhere (2); a truncated turn that stays adds 1. Of all cheapest edits those
are taken whose initials come first in ASCII order.

Method: a Viterbi search over the four states of the form (start, after s, after u, after a). Each
state keeps one survivor, a leaf of a tree of edits whose nodes point backwards and count what
hangs on them. Where two paths into a state cost the same, their edits are compared from their
last common node on, however far back it lies. As soon as all survivors share an ancestor, the
edits up to it are given out and forgotten, so that memory holds what is still undecided only. A
survivor that can't be on a cheapest path any more, because another one can follow any of its
continuations for less, is dropped.

A conversation's turns are dealt by ranges of ``segment_turns`` turn numbers, so that a long one
is no single task's. Where a conversation has several, each is first searched from every state it
could start in, which gives the costs of its ends and the order of their edits; those of a
conversation are put together (16 numbers a segment), and every segment is then edited from the
start to the end that are so fixed. Repeated turns are found by the digests of all turns, grouped
and joined by Spark; a segment gets the few that concern it in its own stream.

Defined cases: a null role or text counts as one space, so that such a turn is blank or fits no
state; null turn numbers come first; turns of equal number go by role and text; rows that are
repeated in the table are repeated turns; an empty role begins with nothing and fits no state. A
null conv_id is a conversation of its own. Extra columns are ignored, an empty table gives an
empty result. Texts of any length are handled whole; a text that must go isn't kept.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import cmp_to_key
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._store import dropped, staged

SEGMENT_TURNS = 4096
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a turn of user or assistant that is put in or re-roled.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What it costs to bring a conversation that ends in a state to its end.
CLOSING = [0, 4, 2, 0]
#: (a, b): what it costs at most to follow from state a any continuation from state b.
FOLLOW = {(ASSISTANT, SYSTEM): 0, (START, ASSISTANT): 0, (START, SYSTEM): 0, (ASSISTANT, START): 3, (USER, START): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (START, USER): 2, (SYSTEM, USER): 2, (ASSISTANT, USER): 2, (SYSTEM, ASSISTANT): 4, (SYSTEM, START): 4}


class Edit:
    """A node of the tree: an edit, the role it gives, and how many edits and survivors hang on it."""

    __slots__ = ("parent", "edit", "role", "depth", "held")

    def __init__(self, parent: Edit | None, edit: str, role: str | None) -> None:
        self.parent, self.edit, self.role, self.held = parent, edit, role, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.held += 1


def _released(node: Edit | None) -> None:
    """Takes away what nothing hangs on any more."""
    while node and node.held == 0:
        node, up = node.parent, node
        up.parent = None
        if node:
            node.held -= 1


def _compared(a: Edit, first: str, b: Edit, second: str) -> int:
    """Below zero if the edits up to ``a`` and ``first`` come before those up to ``b`` and ``second``: the whole way back to the last common node."""
    mine, other = [first], [second]
    while a is not b:
        if a.depth >= b.depth:
            mine.append(a.edit)
            a = a.parent
        else:
            other.append(b.edit)
            b = b.parent
    mine.reverse()
    other.reverse()
    return (mine > other) - (mine < other)


class Survivors:
    """The search through the turns of a conversation, or of a part of one, from a given state."""

    def __init__(self, start: int, give: Callable[[str, str | None], None] | None = None) -> None:
        self.root = Edit(None, "", None)
        self.best: dict[int, tuple[int, Edit]] = {start: (0, self.root)}
        self.root.held += 1
        self.give, self.rest, self.undecided = give or (lambda edit, role: None), 0, 0

    def _inserted(self) -> dict[int, tuple[int, Edit]]:
        """The survivors with any turns put in after them."""
        opened = dict(self.best)
        for _ in range(2):
            for state, (cost, node) in list(opened.items()):
                to, now = NEXT[state], opened.get(NEXT[state])
                if not now or cost + 2 < now[0] or (cost + 2 == now[0] and _compared(node, "I", now[1].parent, now[1].edit) < 0):
                    opened[to] = (cost + 2, Edit(node, "I", NAMES[to]))
                    _released(now and now[1])
        return opened

    def step(self, initial: str, must_go: bool, truncated: bool) -> None:
        """The next turn."""
        found: dict[int, tuple[int, Edit, str, str | None]] = {}

        def offer(to: int, cost: int, node: Edit, edit: str, role: str | None) -> None:
            now = found.get(to)
            if not now or cost < now[0] or (cost == now[0] and _compared(node, edit, now[1], now[2]) < 0):
                found[to] = (cost, node, edit, role)

        opened = self._inserted()
        for state, (cost, node) in opened.items():
            offer(state, cost + 3, node, "D", None)
            if not must_go:
                if (state, initial) in KEPT:
                    offer(KEPT[state, initial], cost + truncated, node, "K", None)
                else:
                    offer(NEXT[state], cost + 2 + truncated, node, "R", NAMES[NEXT[state]])
        costs = {state: x[0] for state, x in found.items()}
        kept = {state: x for state, x in found.items() if not any(costs[other] + more < x[0] for (other, of), more in FOLLOW.items() if of == state and other in costs)}
        self._replace(opened, {state: (cost, Edit(node, edit, role)) for state, (cost, node, edit, role) in kept.items()})
        self._decide()

    def _replace(self, opened: dict[int, tuple[int, Edit]], best: dict[int, tuple[int, Edit]]) -> None:
        before, self.best = self.best, best
        for _, node in best.values():
            node.held += 1
        for _, node in before.values():
            node.held -= 1
        for _, node in [*opened.values(), *before.values()]:
            _released(node)

    def _decide(self) -> None:
        """Gives out the edits that all survivors share; looks again once a quarter more is undecided."""
        self.rest -= 1
        if self.root.held > 1 or self.rest > 0:
            return
        path, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.held == 1:
            child = path.pop()
            self.give(child.edit, child.role)
            child.parent, self.root = None, child
        self.undecided = len(path)
        self.rest = self.undecided // 4

    def close(self, state: int | None, last: bool) -> int:
        """Takes the survivor of a state, or the best of all at the conversation's end, and gives out its edits; its cost."""
        opened = self._inserted() if last else self.best
        ends = opened if last else {state: opened[state]}
        if last and state is not None:  # only what comes from the state that was fixed
            cost, node = self.best[state]
            while state not in (START, ASSISTANT):
                state = NEXT[state]
                cost, node = cost + 2, Edit(node, "I", NAMES[state])
            ends = {state: (cost, node)}
        cost, node = min((x for s, x in ends.items() if not last or s in (START, ASSISTANT)), key=cmp_to_key(lambda x, y: x[0] - y[0] or (_compared(x[1], "", y[1], "") if x[1] is not y[1] else 0)))
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.give(node.edit, node.role)
        return cost

    def ends(self) -> tuple[list[int], list[int]]:
        """(cost, place in the order of edits) of each state, -1 where there is no survivor."""
        order = sorted(self.best, key=cmp_to_key(lambda x, y: _compared(self.best[x][1], "", self.best[y][1], "")))
        return [self.best[s][0] if s in self.best else -1 for s in range(4)], [order.index(s) if s in self.best else -1 for s in range(4)]


HEADER, REPEATED, TURN = range(3)
_STREAM = "conv_id long, segment long, kind int, turn long, role string, text string, numbers array<long>"


def _segment(turns: int):
    return F.col("turn") - F.pmod("turn", F.lit(turns).cast("long"))


def _turns(conversations: DataFrame, segment_turns: int) -> DataFrame:
    """The turns of the stream."""
    return conversations.select("conv_id", _segment(segment_turns).alias("segment"), F.lit(TURN).alias("kind"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(None).cast("array<long>").alias("numbers"))


def _repeated(turns: DataFrame) -> DataFrame:
    """For each turn number, role and digest that was seen earlier or comes several times: how many of its turns are the first (1 or 0)."""
    digests = turns.groupBy("conv_id", "segment", "turn", "role", F.sha2("text", 256).alias("text")).agg(F.count("*").alias("n"))
    first = digests.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"), F.sum("n").alias("all")).filter("`all` > 1")
    d, f = digests.alias("d"), first.alias("f")
    same = F.col("d.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("d.role") == F.col("f.role")) & (F.col("d.text") == F.col("f.text"))
    return d.join(f, same).select("d.conv_id", "d.segment", F.lit(REPEATED).alias("kind"), "d.turn", "d.role", "d.text", F.array(F.col("d.turn").eqNullSafe(F.col("first.turn")).cast("long")).alias("numbers"))


def _dealt(stream: DataFrame) -> DataFrame:
    """A segment's header, then its turns in order, each turn number's repeats first."""
    return stream.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", F.col("kind") > HEADER, "turn", "kind", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def _judged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(turn, role, text or None where it must go, fault) of each turn of a segment."""
    at, seen = object(), {}
    for _, _, kind, turn, role, text, numbers in rows:
        if turn != at:
            at, seen = turn, {}
        if kind == REPEATED:
            seen[role, text] = numbers[0]
            continue
        body, fault = text.rstrip(SPACE), None
        if seen:
            key = (role, hashlib.sha256(text.encode()).hexdigest())
            if key in seen:
                seen[key] -= 1
                fault = "duplicate" if seen[key] < 0 else None
        if not body:
            fault = "blank"
        elif not fault and body[-1] not in ".!?":
            fault = "truncated"
        yield turn, role, None if fault in ("blank", "duplicate") else text, fault


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment and state it could start in: costs and order of the states it could end in."""
    for (conv, segment), rows in groupby(_rows(batches), key=lambda r: r[:2]):
        runs = [Survivors(s) for s in range(4)]
        for _, role, text, fault in _judged(rows):
            for run in runs:
                run.step(role[:1], text is None, fault == "truncated")
        found = [run.ends() for run in runs]
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([segment], pa.int64()), pa.array([[c for costs, _ in found for c in costs]], pa.list_(pa.int64())), pa.array([[r for _, ranks in found for r in ranks]], pa.list_(pa.int64()))], names=["conv_id", "segment", "costs", "ranks"])


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment: the state it starts in, the one it ends in, and whether it is its conversation's last."""
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        parts = list(rows)
        rest = [CLOSING]
        for _, _, costs, _ in reversed(parts):
            rest.append([min(costs[4 * i + j] + rest[-1][j] for j in range(4) if costs[4 * i + j] >= 0) for i in range(4)])
        state, plans = START, []
        for k, (_, _, costs, ranks) in enumerate(parts):
            left = rest[len(parts) - 1 - k]
            end = min((j for j in range(4) if costs[4 * state + j] >= 0), key=lambda j: (costs[4 * state + j] + left[j], ranks[4 * state + j]))
            plans.append([state, end, int(k == len(parts) - 1)])
            state = end
        yield pa.RecordBatch.from_arrays([pa.array([conv] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.int64()), pa.array(plans, pa.list_(pa.int64()))], names=["conv_id", "segment", "numbers"])


_EDITS = [("conv_id", pa.int64()), ("segment", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every edit of each segment, in order."""
    out: list[tuple] = []
    for (conv, segment), rows in groupby(_rows(batches), key=lambda r: r[:2]):
        waiting: deque[tuple] = deque()
        place = 0

        def give(edit: str, role: str | None, conv=conv, segment=segment, waiting=waiting) -> None:
            nonlocal place
            turn, was, text, fault = waiting.popleft() if edit != "I" else (None, None, "", None)
            out.append((conv, segment, place, edit, turn, was, None if edit == "D" else role or was, None if edit == "D" else text, fault))
            place += 1

        first = next(rows)
        start, end, last = first[6] if first[2] == HEADER else (START, None, 1)
        search = Survivors(start, give)
        for turn in _judged(rows if first[2] == HEADER else (r for part in ([first], rows) for r in part)):
            waiting.append(turn)
            search.step(turn[1][:1], turn[2] is None, turn[3] == "truncated")
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _EDITS)], names=[n for n, _ in _EDITS])
                out.clear()
        search.close(end, bool(last))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _EDITS)], names=[n for n, _ in _EDITS])


def repair(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Every edit of each conversation, by (conv_id, segment, place): edit, turn, was (the role before), role, text, fault.

    A deleted turn has no role and text; one that is put in has no turn, role before and fault.
    fault: blank, duplicate, truncated or null, the first that holds.
    """
    turns = _turns(conversations, segment_turns)
    repeated = _repeated(turns)
    spans = turns.groupBy("conv_id").agg(F.min("segment").alias("low"), F.max("segment").alias("high"), F.max(F.col("segment").isNull()).alias("nulls"))
    long = staged(spans.filter("low <> high OR (nulls AND high IS NOT NULL)").select("conv_id"), "long-conversations")
    stream = turns.unionByName(repeated)
    if not long.isEmpty():
        a, b = stream.alias("a"), long.alias("b")
        own = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left_semi")
        ends = _dealt(own).mapInArrow(_summaries, "conv_id long, segment long, costs array<long>, ranks array<long>")
        plans = ends.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_fixed, "conv_id long, segment long, numbers array<long>")
        none = F.lit(None)
        stream = stream.unionByName(plans.select("conv_id", "segment", F.lit(HEADER).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), "numbers"))
    else:
        dropped(long)
    return _dealt(stream).mapInArrow(_edited, "conv_id long, segment long, place long, edit string, turn long, was string, role string, text string, fault string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with the faults that the checksum of ``conv_id:turn`` (a null: one space) gives them."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", how.alias("how")).filter("how <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.explode(F.expr("CASE WHEN how = 3 THEN array(1, 2) ELSE array(1) END")).alias("copy")).drop("copy")


_DIGEST = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its edits in order; the text is hashed as it passes."""
    out: list[tuple] = []
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        audit, digest, lines, illegal, cost, distinct, low, high, before, at = [], hashlib.sha256(), 0, 0, 0, 0, None, None, None, None
        for _, _, edit, turn, was, line, fault in rows:
            if edit is None:
                continue
            audit.append(edit)
            cost += {"K": 0, "R": 2, "D": 3, "I": 2}[edit] + (fault == "truncated" and edit != "D")
            if edit != "D":
                digest.update((b"\n" if lines else b"") + line.encode())
                lines += 1
            if edit != "I":
                if fault:
                    counts[fault] += 1
                illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
                before = was[:1]
                if turn is not None and turn != at:
                    at, distinct = turn, distinct + 1
                    low, high = turn if low is None else low, turn
        out.append((conv, high - low + 1 - distinct if distinct else 0, *counts.values(), illegal, cost, "".join(audit), digest.hexdigest()))
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _DIGEST)], names=[n for n, _ in _DIGEST])
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _DIGEST)], names=[n for n, _ in _DIGEST])


def digested(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """A row for each conversation of the first table: its counts, its edits and the hash of what they leave.

    A hash goes through a conversation's turns in order, so that one task reads them all; it holds one at a time and the initials of the edits.
    """
    none = F.lit(None)
    ids = conversations.select("conv_id").distinct().select("conv_id", F.lit(0).alias("begun"), none.cast("long").alias("segment"), none.cast("long").alias("place"), *[none.cast(t).alias(c) for c, t in (("edit", "string"), ("turn", "long"), ("was", "string"), ("line", "string"), ("fault", "string"))])
    rows = edits.select("conv_id", F.lit(1).alias("begun"), "segment", "place", "edit", "turn", "was", F.concat("role", F.lit(":"), "text").alias("line"), "fault")
    ordered = ids.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "begun", "segment", "place")
    return ordered.select("conv_id", "place", "edit", "turn", "was", "line", "fault").mapInArrow(_folded, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op12_survivor_viterbi(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults, the cheapest edits and the hash of the repaired text."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digested(conversations, repair(damaged(conversations)))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string of ASCII characters in SQL."""
    step = "xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda acc, x: {step}), 4294967295)"


def op12_sql() -> str:
    """The same edits by a recursion over the turns that keeps every state's whole edits."""
    moves = [(s, "D", "", s, 3, "") for s in range(4)] + [(s, "K", i, to, 0, "") for (s, i), to in KEPT.items()] + [(s, "R", "", to, 2, NAMES[to]) for s, to in NEXT.items()]
    opened = [(s, "", s, 0, "") for s in range(4)] + [(s, "I", to, 2, f"{NAMES[to]}:") for s, to in NEXT.items()]
    values = lambda rows: ", ".join(str(r) for r in rows)
    return rf"""
WITH RECURSIVE moves(state, edit, initial, to_state, cost, new_role) AS (VALUES {values(moves)}),
opened(from_state, pre, state, pre_cost, pre_line) AS (VALUES {values(opened)}),
steps AS (SELECT * FROM opened JOIN moves USING (state)),
keyed AS (SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS how FROM conversations),
hurt AS (SELECT k, conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE how <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k, copy) AS again,
  lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k, copy) AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
turns AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, role[1:1] AS own FROM placed),
v AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT v.conv_id, v.i + 1, to_state, min({{'c': best.c + pre_cost + cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 1 ELSE 0 END, 'a': best.a || pre || edit,
    'r': list_concat(best.r, CASE WHEN pre = '' THEN []::VARCHAR[] ELSE [pre_line] END, CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [new_role || ':' || text] END)}})
  FROM v JOIN turns t ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.i = v.i + 1
  JOIN steps s ON s.from_state = v.state AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (edit <> 'K' OR initial = own)
  GROUP BY v.conv_id, v.i + 1, to_state
),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || own NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
closed AS (SELECT v.conv_id, min({{'c': best.c + CASE state WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 0 END, 'a': best.a || CASE state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END,
  'r': list_concat(best.r, CASE state WHEN 2 THEN ['assistant:'] WHEN 1 THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END)}}) AS best
  FROM v JOIN counted c ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND c.n = v.i GROUP BY v.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN closed ON closed.conv_id IS NOT DISTINCT FROM d.conv_id
"""

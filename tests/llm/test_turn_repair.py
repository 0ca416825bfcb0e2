"""Cheapest edits of conversations against a plain search over whole edits."""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import turn_repair as R

sys.setrecursionlimit(20_000)  # the plain search goes down a turn at a time
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.strip(R.SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit) by a search backwards over complete edits."""
    fault = faults(turns)

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        options = []
        if i == len(turns) and state in (R.START, R.ASSISTANT):
            options.append((0, ""))
        if inserts < 3:
            options.append((2, "I", i, R.NEXT[state], inserts + 1))
        if i < len(turns):
            options.append((3, "D", i + 1, state, 0))
            if fault[i] not in ("blank", "duplicate"):
                more = fault[i] == "truncated"
                if (state, turns[i][0][:1]) in R.KEPT:
                    options.append((more, "K", i + 1, R.KEPT[state, turns[i][0][:1]], 0))
                options.append((2 + more, "R", i + 1, R.NEXT[state], 0))
        whole = []
        for o in options:
            if len(o) == 2:
                whole.append(o)
            elif rest := best(*o[2:]):
                whole.append((o[0] + rest[0], o[1] + rest[1]))
        return min(whole, default=None)

    return best(0, R.START, 0)


def lines(turns, audit):
    out, state, rows = [], R.START, iter(turns)
    for edit in audit:
        role, text = next(rows) if edit != "I" else (None, "")
        if edit in "RI":
            state = R.NEXT[state]
            out.append(f"{R.NAMES[state]}:{text}")
        elif edit == "K":
            state = R.KEPT[state, role[:1]]
            out.append(f"{role}:{text}")
    return out


def searched(turns):
    given, fault = [], faults(turns)
    search = R.Survivors(R.START, lambda edit, role: given.append(edit))
    for (role, _), f in zip(turns, fault):
        search.step(role[:1], f in ("blank", "duplicate"), f == "truncated")
    return search.close(None, True), "".join(given)


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", " \n", "One.", "Two?", "cut", "Three!", "a b"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=14))
def test_search_equals_whole_comparison(turns):
    assert searched(turns) == cheapest(turns)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.integers(0, 40).map(lambda i: f"Text {i}" + ".?,"[i % 3])), max_size=120))
def test_long_ties_and_bounded_memory(turns):
    assert searched(turns) == cheapest(turns)


def test_undecided_edits_stay_few():
    search, most = R.Survivors(R.START), 0
    for i in range(20_000):
        search.step("uaxsua"[i % 6], i % 11 == 0, i % 7 == 0)
        most = max(most, search.undecided)
    assert most < 40


def digest(rows):
    """The contract's row of each conversation of a table, walked plainly."""
    groups, every = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        part = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = "user" if how == 4 else part(role), "" if how == 1 else part(text)
        if how == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(how, 1)
    out = []
    for conv in every:
        turns = sorted(groups[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        numbers = {t[0] for t in turns if t[0] is not None}
        pairs = [t[1:] for t in turns]
        fault = faults(pairs)
        cost, audit = cheapest(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        text = "\n".join(lines(pairs, audit))
        out.append((conv, gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, turns, extra=""):
    df = spark.createDataFrame([(*r, "x") if extra else r for r in rows], SCHEMA + extra)
    return sorted((tuple(r) for r in R.digested(df, R.repair(R.damaged(df), turns)).collect()), key=str)


def random_rows(seed, n, conversations):
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    rows = [(int(rng.integers(conversations)), int(rng.integers(12)), pick("system", "user", "assistant", "user", "assistant", "tool", None, ""), pick("One.", "Two?", "cut", "", "\t ", None, f"Text {rng.integers(50)}!")) for _ in range(n)]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (7, None, "user", "One."), (7, None, "user", "One."), (99, -5, "user", "x" * 50_000), (98, None, None, None)]
    return rows + rows[:5]


@pytest.mark.parametrize("turns", [4096, 1, 3])
def test_segments_equal_the_plain_walk(spark, turns):
    rows = random_rows(turns, 150, 9)
    assert found(spark, rows, turns, ", score string") == digest(rows)


def test_hot_conversation_is_dealt_in_segments(spark):
    rows = [(5, i, ("user", "assistant", "tool")[i % 3], f"Text {i % 23}" + ".,"[i % 2]) for i in range(400)] + random_rows(1, 30, 4)
    assert found(spark, rows, 16) == digest(rows)
    edits = R.repair(spark.createDataFrame(rows, SCHEMA), 16).filter("conv_id = 5").groupBy("segment").count().collect()
    assert len(edits) == 25


def test_empty_and_dropped(spark):
    assert found(spark, [], 4096) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hi.")], 4096) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_edits_are_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", ""), (1, 3, "user", "cut")]
    got = [tuple(r)[3:] for r in R.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("segment", "place").collect()]
    print(got)
    # Insert before the greeting (2), against deleting it and keeping the cut turn with an answer put in (3 + 1 + 2).
    assert got == [("K", 0, "system", "system", "Be kind.", None), ("I", None, None, "user", "", None), ("K", 1, "assistant", "assistant", "Hello.", None), ("D", 2, "user", None, None, "blank"), ("D", 3, "user", None, None, "truncated")]


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = con.sql(R.op12_sql())
    got = R.op12_survivor_viterbi(spark, small)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())

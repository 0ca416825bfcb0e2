"""The trie of rebuilt conversations against one that is built from whole texts."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from loomgraph.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) - abs(c) % 5
        whole = tuple(turns.get(base if c >= 0 else -base, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def below(path):
        saved = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        parts = [below(k) for k in kids[path]]
        return saved + sum(p[0] for p in parts), sum(p[1] for p in parts) or int(not parts)

    out = []
    for path, ids in members.items():
        saved, leaves = below(path)
        text = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids[path]), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **kw):
    trie = T.rebuilt_trie(df, **kw)
    return sorted((tuple(r) for r in trie.drop("turn_conv_id", "turn_place").collect()), key=str)


def random_rows(seed, conversations, most):
    rng = np.random.default_rng(seed)
    rows = [(c, t if t % 7 else None, ("system", "user", None)[int(rng.integers(3))], ("A.", "", None, "é日本", "long " * 50)[int(rng.integers(5))]) for c in rng.choice(range(-12, 60), conversations, replace=False).tolist() for t in range(int(rng.integers(1, most)))]
    rows += [(None, 1, "user", "x")] * 3 + rows[:4]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 2), (3, 3)])
def test_random_conversations(spark, seed, block):
    rows = random_rows(seed, 40, 14)
    assert found(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", depth string"), block=block) == plain(rows)


def test_copies_and_long_chains(spark):
    """A third of the conversations are equal, others branch off them ever deeper, one is long."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 100, 5) for t in range(6)]
    rows += [(c, t, "user", f"same {t}" if t < c % 40 else f"own {c} {t}") for c in range(200, 240, 5) for t in range(c % 40 + 3)]
    rows += [(300, t, "user", f"turn {t % 9}") for t in range(300)]
    assert found(spark.createDataFrame(rows, SCHEMA), block=64) == plain(rows)


def test_collision_is_seen_and_done_again(spark, monkeypatch):
    """With a base of one every order of the same turns has one fingerprint."""
    real = T.base_of
    monkeypatch.setattr(T, "base_of", lambda seed: 1 if seed == 0 else real(seed))
    rows = [(0, 0, "user", "a"), (0, 1, "user", "b"), (5, 0, "user", "b"), (5, 1, "user", "a"), (5, 2, "user", "c")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_monoid():
    base = T.base_of(3)
    runs = [(1, 5), (3, 17), (2, 99)]
    left = T.product(T.product(runs[0], runs[1], base), runs[2], base)
    assert left == T.product(runs[0], T.product(runs[1], runs[2], base), base)
    assert T.rest_of(left, runs[0], base) == T.product(runs[1], runs[2], base)


def test_empty_table_and_references(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = random_rows(5, 20, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    stored = {}
    for c in {r[0] for r in rows if r[0] is not None}:
        digest = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
        stored[c] = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
    parts = defaultdict(dict)
    for r in T.rebuilt_trie(df).collect():
        if r["depth"]:
            _, _, role, text = stored[r["turn_conv_id"]][r["turn_place"] - 1]
            parts[r["conv_id"]][r["depth"]] = (role or "", text or "")
    whole = {}
    for c in stored:
        h, base = zlib.crc32(str(c).encode()) % 9, abs(c) - abs(c) % 5
        whole[c] = [(r[2] or "", r[3] or "") for r in stored.get(base if c >= 0 else -base, [])[:h] + stored[c][h:]]
    assert parts and all(whole[c][d - 1] == turn for c, own in parts.items() for d, turn in own.items())


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = con.sql(T.op13_sql())
    got = T.op13_monoid_prefix_trie(spark, small)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)

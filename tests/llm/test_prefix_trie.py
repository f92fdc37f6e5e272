"""The trie against a plain version; its hash table, its shards and its cut paths on their own."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from millrace.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """rows: (conv_id, turn, role, text) without ties -> sorted nodes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:n] + turns[n:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        children = sum(len(x) == len(node) + 1 for x in below)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    pool = [("user", "hi"), ("user", "hello é"), ("assistant", "yes"), (None, "no"), ("user", None), ("", "")]
    return [(c, (None if t == 0 and c % 2 else t), *rng.choice(pool)) for c in rng.sample(range(-10, 3 * n), n) for t in range(rng.randint(1, 7))]


@pytest.mark.parametrize("size", [P.SHARD, 7])
def test_equals_a_plain_trie(spark, size, monkeypatch):
    rows = made(4, 60) + [(None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as depth", "2 as a", "3 as pos", "4 as size", "5 as b")
    if size != P.SHARD:
        own = P.sharded
        monkeypatch.setattr(P, "sharded", lambda frames: own(frames, 7))
    assert sorted((tuple(r) for r in P.prefix_trie(df).collect()), key=str) == plain(rows)


def test_empty_and_repeated_rows(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    got = {r.depth: r for r in P.prefix_trie(spark.createDataFrame([(0, 1, "u", "ab")] * 3, SCHEMA)).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[3].n_leaves == 1 and got[0].n_children == 1  # each repeated turn is a turn


def test_slots_are_minimal_and_perfect_and_refuse_strangers():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 2), dtype=np.uint64)
    slots = P.Slots(keys)
    assert sorted(slots(keys)) == list(range(5000)) and (slots.keys[slots(keys)] == keys).all()
    assert (slots(keys ^ np.uint64(1)) == -1).all() and len(P.Slots(keys[:0])(keys)) == 5000 and (P.Slots(keys[:0])(keys) == -1).all()


def test_one_long_conversation_over_many_shards():
    n = 500
    rows = pd.DataFrame({"depth": range(n, -1, -1), "a": range(n, -1, -1), "b": 7, "pa": [*range(n - 1, -1, -1), -1], "pb": 7, "saved": 1, "leaf": [1] + [0] * n, "child": 1})
    out = pd.concat(P.sharded(iter([rows]), 11)).groupby(["a", "b"]).sum().reset_index()
    assert list(out.sort_values("a")["saved"]) == [n + 1 - i for i in range(n + 1)] and (out["leaves"] == 1).all()
    assert list(out.sort_values("a")["children"]) == [1] * n + [0]


def test_ends_of_a_node_come_in_pieces(spark):
    """Thousands of equal conversations: their ids are hashed in pieces of 4,096."""
    rows = [(c, 1, "u", "same") for c in range(0, 50_000, 5)]
    got = {r.depth: r for r in P.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    stay = [c for c in range(0, 50_000, 5)]
    assert got[1].n_convs == 10_000 and got[1].ends_sha256 == hashlib.sha256(",".join(map(str, stay)).encode()).hexdigest()

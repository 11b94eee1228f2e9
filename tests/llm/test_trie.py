"""The prefix trie by brute force, the double array by dictionaries, and edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapix.llm import queries, trie
from terrapix.llm.double_array import DoubleArray

SF = "/root/testdata/sf0.001"


def brute(paths):
    """Rows of the trie of {conversation: [(role, text), ...]}."""
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    ends = {n: ",".join(str(c) for c in m if len(paths[c]) == len(n)) for n, m in members.items()}
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
        for n, m in members.items()
    )


def grafted(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def turns_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, (role or "", text or "")))
    return {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items() if c is not None}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_prefix_trie(spark, SF)) == brute(grafted(turns_of(rows)))


@pytest.mark.parametrize("small", [False, True])
def test_random_tries(spark, monkeypatch, tmp_path, small):
    """Many shared beginnings; with small limits also many stretches, runs, shards and conversations ordered in ranges."""
    if small:
        for name, value in (("STRETCH", 3), ("RUN", 2), ("SHARD_TURNS", 40), ("LONG", 20), ("IDS", 3)):
            monkeypatch.setattr(trie, name, value)
    rnd = random.Random(8)
    rows = []
    for c in [*range(-7, 60), 1 << 40]:
        size = rnd.choice([1, 2, 5, 9, 30, 31])
        rows += [(c, t if t else rnd.choice([0, None]), rnd.choice("ua"), "é" * rnd.randint(0, 2)) for t in range(size)]
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(12)]
    rows += [(None, 1, "u", "x"), (200, 0, None, None)]
    df = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c int, t1 string, n int").repartition(3)
    convs = turns_of(rows)
    assert rows_of(trie.prefix_trie(df)) == brute(convs)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(queries.op12_prefix_trie(spark, str(tmp_path))) == brute(grafted(convs))


def test_ties_repeats_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, "u", "z"), (2, 7, "u", "z"), (2, 9, "u", "a"), (2, 9, "u", "a")], kind)
    got = rows_of(trie.prefix_trie(df))
    assert got == brute({1: [("u", "z"), ("u", "a"), ("u", "a")], 2: [("u", "z"), ("u", "a"), ("u", "a")]})
    mixed = spark.createDataFrame([(1, 3, "u", "a"), (1, 3, "u", "b"), (2, 5, "u", "b"), (2, 5, "u", "a")], kind)
    assert {r[3] for r in rows_of(trie.prefix_trie(mixed))} == {2}  # turns of one number have one order everywhere
    assert trie.prefix_trie(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=7), max_size=40), st.lists(st.integers(0, 12), max_size=7))
def test_double_array_against_a_set(sequences, other):
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
    array = DoubleArray(offsets, np.array([x for s in sequences for x in s], np.int64), 13)
    prefixes = {tuple(s[:k]) for s in sequences for k in range(len(s) + 1)} | {()}
    assert (array.check >= 0).sum() == len(prefixes) - 1
    for asked in [*sequences, other]:
        at = np.zeros(1, np.int64)
        for k, x in enumerate(asked, 1):
            at = array.step(at, np.array([x]))
            assert (at[0] >= 0) == (tuple(asked[:k]) in prefixes)
            if at[0] < 0:
                break

"""Trie nodes against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagemill.llm.conversation_trie import DoubleArray, trie_nodes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 string, n string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    return sorted((tuple(r) for r in trie_nodes(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), **how).collect()), key=str)


def random_rows(seed, convs, words, long=()):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.choice(long) if long and rng.random() < 0.2 else rng.randrange(1, 6)):
            rows.append((c, turn, rng.choice(["user", "system"]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"chunk": 3, "shard_turns": 7}, {"chunk": 1, "shard_turns": 1}, {"chunk": 4, "shard_turns": 40}])
def test_random_conversations(spark, how):
    rows = random_rows(3, [*range(0, 60), 100, 105, 199, 250, -100, -130], ["a", "bb", "cécé"], long=(12, 17))
    assert run(spark, rows, **how) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "late"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (7, 0, "", ""), (None, 0, "user", "lost"),
            (200, 0, "user", "head"), (203, 0, "user", "own"), (203, 1, None, "x" * 50_000), (299, 5, "user", None)]
    assert run(spark, rows) == brute(rows)


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", text) for c in range(300, 900) for t, text in enumerate(["hello", "same", "end"] if c % 3 else ["hello", str(c % 17)])]
    assert run(spark, rows, chunk=2, shard_turns=5) == brute(rows)


def test_only_turnless_and_empty(spark):
    short = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0][:5]
    rows = [(c, 0, "user", "cut") for c in short]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, rows)) == 1
    assert run(spark, []) == []


def test_double_array_holds_the_trie():
    rng = np.random.default_rng(4)
    parents, symbols, seen = [], [], set()
    for node in range(1, 2000):
        while (edge := (int(rng.integers(0, node)) if node % 3 else 0, int(rng.integers(1, 900)))) in seen:
            pass
        seen.add(edge)
        parents.append(edge[0])
        symbols.append(edge[1])
    trie = DoubleArray(np.array(parents), np.array(symbols))
    state = np.zeros(2000, dtype=np.int64)
    for k, (p, c) in enumerate(zip(parents, symbols, strict=True)):
        state[k + 1] = trie.step(state[p:p + 1], np.array([c]))[0]
    assert len(set(state.tolist())) == 2000 and (state >= 0).all()
    for p in range(0, 2000, 7):
        absent = np.array([c for c in range(1, 901) if (p, c) not in seen])
        assert (trie.step(np.full(len(absent), state[p]), absent) == -1).all()
    assert len(trie.check) < 4 * 2000

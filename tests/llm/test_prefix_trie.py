"""Conversation prefix trie: against a trie built of dictionaries, in one shard and in many, and on odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from lociary.llm import prefix_trie, queries


@pytest.mark.parametrize("deep", [0.1, 0.5, 0.9, 0.999])
def test_find_close(deep):
    rng = random.Random(int(1000 * deep))
    for n in (1, 2, 63, 64, 65, 4000):
        opens, stack, closes, left = [], [], {}, n
        while left or stack:
            if left and (not stack or rng.random() < deep):
                stack.append(len(opens))
                opens.append(1)
                left -= 1
            else:
                closes[stack.pop()] = len(opens)
                opens.append(0)
        tree = prefix_trie.Parentheses(np.array(opens))
        places = np.flatnonzero(tree.opens)
        assert tree.find_close(places).tolist() == [closes[p] for p in places.tolist()]


def brute_trie(conversations):
    """Rows of the contract's result from conv_id -> list of (role, text)."""
    nodes = collections.defaultdict(list)
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            nodes[tuple(turns[:depth])].append(conv)
    words = lambda key: len(key[-1][1].encode().split()) if key else 0
    rows = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        children = lambda x: [k for k in nodes if len(k) == len(x) + 1 and k[:-1] == x]
        ended = sorted(c for c in members if len(conversations[c]) == len(key))
        rows.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children(key)),
            sum(not children(k) for k in under), sum((len(nodes[k]) - 1) * words(k) for k in under),
            hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def grafted(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    return {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + turns[zlib.crc32(str(c).encode()) % 4 :] for c, turns in own.items()}


def some_conversations(seed):
    rng = random.Random(seed)
    said = ["yes", "no no", " a\tb  c ", "", None]
    rows = []
    for conv in range(70):
        copied = rng.random() < 0.3
        for turn in range(7 if copied else rng.randrange(1, 6)):
            rows.append((conv, turn if turn or copied else None, ["user", "assistant", None][turn % 2 if copied else rng.randrange(3)], said[turn % 4 if copied else rng.randrange(5)]))
    rows += [(200, t, "user", f"long {min(t, 30)}") for t in range(90)] + [(201, t, "user", f"long {min(t, 30)}") for t in range(60)]
    return rows + [(None, 0, "user", "lost")] * 3


@pytest.mark.parametrize("shard_nodes, piece_ids", [(1, 1), (7, 3), (200_000, 8192)])
def test_trie_matches_brute_force(spark, shard_nodes, piece_ids):
    rows = some_conversations(shard_nodes)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    turns = prefix_trie.ordered_turns(table)
    ids = turns.select("conv_id").distinct()
    got = prefix_trie.prefix_trie(queries._grafted(turns, ids), ids, shard_nodes, piece_ids)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie({c: t for c, t in grafted(rows).items()})


def test_odd_tables(spark):
    schema = "conv_id long, depth long, t1 long, t2 long, words long"
    none, ids = spark.createDataFrame([], schema), "conv_id long"
    assert prefix_trie.prefix_trie(none, spark.createDataFrame([], ids)).count() == 0
    alone = prefix_trie.prefix_trie(none, spark.createDataFrame([(5,), (3,)], ids)).collect()
    assert [tuple(r) for r in alone] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]
    clash = spark.createDataFrame([(1, None, "b", "x", 1, 9), (1, None, "a", "x y", 2, 9), (1, None, "b", "x", 3, 9)], "conv_id int, turn int, role string, text string, at int, t1 int")
    turns = prefix_trie.ordered_turns(clash).orderBy("at").collect()
    assert [(r["conv_id"], r["at"], r["words"]) for r in turns] == [(1, 0, 2), (1, 1, 1), (1, 2, 1)]

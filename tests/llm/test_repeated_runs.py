"""Periodic runs of words: against a search over all periods, and on odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lociary.llm import repeated_runs


def brute_runs(words):
    found = []
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at + period < len(words):
            to = at
            while to + period < len(words) and words[to] == words[to + period]:
                to += 1
            length = to - at + period
            if to > at and length >= max(6, 4 * period):
                part = words[at : at + length]
                if not any(part[p:] == part[:-p] for p in range(1, period)):
                    found.append((at, length, period))
            at = max(to, at + 1)
    return sorted(found)


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_match_a_search_over_all_periods(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 8)
        assert repeated_runs.find_runs(words) == brute_runs(words)
        assert repeated_runs.runs_of([ord(w) for w in words]) == brute_runs(words)


def test_automaton_and_paths():
    words = [0, 1, 1, 0, 1, 1, 0]
    lengths, links, prefixes = repeated_runs.automaton(words)
    ends = {tuple(words[a:b]): {e for e in range(1, 8) if tuple(words[a:b]) == tuple(words[max(0, e - b + a) : e])} for a in range(7) for b in range(a + 1, 8)}
    assert len(lengths) == 1 + len({frozenset(e) for e in ends.values()})
    forest = repeated_runs.PathForest(links)
    for end, state in enumerate(prefixes, 1):
        told = {before: lengths[deepest] for deepest, before in forest.access(state, end)}
        last = {}
        for length in range(1, end + 1):
            earlier = [e for e in ends[tuple(words[end - length : end])] if e < end]
            if earlier:
                last[max(earlier)] = length
        assert {e: n for e, n in told.items() if n} == last


def test_collapsed_words():
    words = "x a b a b a b a b y z z z z z z".split()
    runs = repeated_runs.find_runs(words)
    assert runs == [(1, 8, 2), (10, 6, 1)]
    assert repeated_runs.collapse(words, runs) == "x a b y z".split()


def test_a_long_periodic_text_and_a_long_plain_one():
    words = [str(i % 7_000) for i in range(150_000)]
    assert repeated_runs.find_runs(words) == [(0, 150_000, 7_000)]
    assert repeated_runs.find_runs([str(i) for i in range(200_000)]) == []
    assert repeated_runs.find_runs(["w"] * 300_000) == [(0, 300_000, 1)]


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a a a a a", "a a a a a a", "é  é  é  é  é  é ", "same b " * 4, "same b " * 4]
    rows = [(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    got = repeated_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(texts)
    assert [found[i]["n_words"] for i in (0, 1, 2, 3, None, 5, 6, 7)] == [0, 0, 0, 5, 6, 6, 8, 8]
    assert [len(found[i]["runs"]) for i in (0, 1, 2, 3, None, 5, 6, 7)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert found[7]["collapsed"] == "same b" and found[None]["collapsed"] == "a" and found[0]["collapsed"] == ""
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_runs.periodic_runs(none).filter(F.size("runs") > 0).count() == 0

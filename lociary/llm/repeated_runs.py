"""Periodic runs of words: suffix automaton and link-cut access.

A run is a stretch of words with smallest period q, at least ``MIN_LENGTH`` and ``MIN_EXPONENT * q`` words long, that no
neighbouring word extends. The suffix automaton of a text has one state per class of substrings with the same ends; its
suffix links form a tree, and the path from the state of a prefix to the root holds the suffixes of that prefix. A
link-cut forest keeps the tree cut into paths whose substrings ended last at the same place, its colour. Appending word
i is one access to the state of prefix i: the path to the root becomes one path of colour i, and each segment it takes
over tells the longest suffix (length L) that ended last at its colour e. With d = i - e <= L the last 2d words are a
square, and the L + d words up to i are the part seen so far of the run of period d: no word before them continues the
period, since then the segment would be longer, and d is its smallest period, since with a smaller one the suffix would
have ended later. The last report of (start, d) is the whole run. Accesses cost O(log n) each, amortised.

A run lies where every three neighbouring words occur three times or more, so the automaton is only built for such
stretches (``stretches``); ordinary prose has none. Memory is proportional to the longest of them, about 600 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociary.llm.common import column_of, ship, slices

MIN_LENGTH = 6
MIN_EXPONENT = 4
NARROWINGS = 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def automaton(word_ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of every state of the suffix automaton (state 0 is the root), and the state of every prefix."""
    lengths, links, moves, prefixes, last = [0], [-1], [{}], [], 0
    for word in word_ids:
        state = len(lengths)
        lengths.append(lengths[last] + 1)
        moves.append({})
        at = last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = state
            at = links[at]
        if at < 0:
            links.append(0)
        else:
            target = moves[at][word]
            if lengths[target] == lengths[at] + 1:
                links.append(target)
            else:
                copy = state + 1
                links.append(copy)
                lengths.append(lengths[at] + 1)
                links.append(links[target])
                moves.append(dict(moves[target]))
                links[target] = copy
                while at >= 0 and moves[at].get(word) == target:
                    moves[at][word] = copy
                    at = links[at]
        prefixes.append(state)
        last = state
    return lengths, links, prefixes


class PathForest:
    """The suffix-link tree as a link-cut forest: every path of one colour is a splay tree ordered by depth.

    The colour of a path stands at the root of its splay tree; 0 is the colour of states that no prefix has reached.
    """

    def __init__(self, links: list[int]):
        n = len(links)
        self.up = list(links)
        self.less = [-1] * n
        self.more = [-1] * n
        self.colour = [0] * n

    def _rotate(self, x: int) -> None:
        up, less, more = self.up, self.less, self.more
        p = up[x]
        g = up[p]
        if g >= 0 and less[g] == p:
            less[g] = x
        elif g >= 0 and more[g] == p:
            more[g] = x
        else:
            self.colour[x] = self.colour[p]
        if less[p] == x:
            child = less[p] = more[x]
            more[x] = p
        else:
            child = more[p] = less[x]
            less[x] = p
        if child >= 0:
            up[child] = p
        up[p], up[x] = x, g

    def splay(self, x: int) -> None:
        up, less, more = self.up, self.less, self.more
        while True:
            p = up[x]
            if p < 0 or (less[p] != x and more[p] != x):
                return
            g = up[p]
            if g >= 0 and (less[g] == p or more[g] == p):
                self._rotate(p if (less[g] == p) == (less[p] == x) else x)
            self._rotate(x)

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from a state to the root; (deepest state, old colour) of every segment it took over."""
        taken, below, x = [], -1, state
        while x >= 0:
            self.splay(x)
            old, deeper = self.colour[x], self.more[x]
            if deeper >= 0:
                self.colour[deeper] = old
            if old:
                taken.append((x, old))
            self.more[x] = below
            below, x = x, self.up[x]
        self.colour[below] = colour
        return taken


def runs_of(word_ids: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a sequence, by start, then period."""
    lengths, links, prefixes = automaton(word_ids)
    forest, found = PathForest(links), {}
    for end, state in enumerate(prefixes, 1):
        for deepest, before in forest.access(state, end):
            period, length = end - before, lengths[deepest]
            if length + period >= max(MIN_LENGTH, MIN_EXPONENT * period):
                found[end - length - period, period] = length + period
    return sorted((start, length, period) for (start, period), length in found.items())


def stretches(word_ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint parts [begin, end) that hold every run whole.

    A run of n >= 4q words has n - 2 places of three neighbouring words, q different ones, so each occurs three times or
    more. Parts where that holds everywhere are narrowed a few times, as their own counts are smaller than the text's.
    """
    todo, kept = [(0, len(word_ids), NARROWINGS)], []
    while todo:
        begin, end, left = todo.pop()
        if end - begin < MIN_LENGTH:
            continue
        part = word_ids[begin:end]
        base = int(part.max()) + 1
        pairs = part[:-1] * base + part[1:]
        if base**3 >= 1 << 62:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, counts = np.unique(pairs[:-1] * base + part[2:], return_inverse=True, return_counts=True)
        often = np.concatenate([[False], (counts >= MIN_EXPONENT - 1)[which], [False]])
        edges = np.flatnonzero(often[1:] != often[:-1])
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
            inner = (begin + first, begin + last + 2)
            if inner[1] - inner[0] < MIN_LENGTH:
                continue
            if left and inner != (begin, end):
                todo.append((*inner, left - 1))
            else:
                kept.append(inner)
    return sorted(kept)


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a list of words, by start, then period."""
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(words) - len(known) < MIN_LENGTH - MIN_LENGTH // MIN_EXPONENT:  # too few repeated words for any run
        return []
    return [(begin + s, n, q) for begin, end in stretches(ids) for s, n, q in runs_of(ids[begin:end].tolist())]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    covered = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(covered).tolist()) if not c]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs (doc_id, text)``.

    ``runs`` is an array of (start, length, period) in words, by start, then period; ``collapsed`` is the text's words
    joined by one space, without the words that a run holds after its first period.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows stay as many rows, a null id
    stays null, other columns are ignored, an empty table gives an empty table. Texts are taken whole; a task holds one
    batch of 256 texts and the automaton of one stretch.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            counts, runs, texts = [], [], []
            for text in column_of(batch, "text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # bytes are split at the space and the characters 9 to 13
                found = find_runs(words)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapse(words, found)))
            yield pa.record_batch(
                [column_of(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).view(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

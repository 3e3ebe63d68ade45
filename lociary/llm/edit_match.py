"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to ``k = floor(RATE * m)`` edits. Cut into k + 1 pieces, at least one
piece of any such occurrence is unchanged, so one Aho-Corasick pass over a document finds every place where an item can
be. Each place is verified with Myers' bit-parallel edit distance against the window around it; the
distance is exact, for insertions, deletions and replacements of characters.

Items under ``MIN_CHARS`` characters are one piece and found exactly, where they do not begin or end inside a word.

Texts are compared in lower case with every run of white space as one space. Items are read in blocks of at most
``BLOCK_CHARS`` characters (or one item), each broadcast once and held against all documents in one pass, so the
memory does not grow with the benchmark. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociary.llm.common import column_of, ship, slices

RATE = 0.08
MIN_CHARS = 24
BLOCK_CHARS = 2_000_000

#: First and last letters of scripts that write words without spaces between them.
UNSPACED = ["\u0e00\u0eff", "\u1000\u109f", "\u1780\u17ff", "\u3040\u30ff", "\u3400\u9fff", "\uf900\ufaff", "\U00020000\U0003ffff"]

_matchers: dict[int, "Matcher"] = {}


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """Begin and end of budget + 1 pieces of nearly equal length that cover an item."""
    cuts = [length * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:]))


def _of_word(c: str) -> bool:
    return c.isalnum() and not any(first <= c <= last for first, last in UNSPACED)


def whole_words(text: str, begin: int, end: int) -> bool:
    """Whether a part of a text neither begins nor ends inside a word."""
    return not (begin > 0 and _of_word(text[begin - 1]) and _of_word(text[begin])) and not (end < len(text) and _of_word(text[end - 1]) and _of_word(text[end]))


def myers(pattern_bits: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """Least distance of the pattern to any part of the text, and where the first such part ends; None above the budget."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best = None
    for end, c in enumerate(text, 1):
        eq = pattern_bits.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = (up << 1) & full
        plus = ((down << 1) | ~((eq | minus) | up)) & full
        minus = up & (eq | minus)
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, end)
    return best


class Matcher:
    """The items of one block, ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = items
        self.budgets = [int(rate * len(text)) if len(text) >= MIN_CHARS else 0 for _, text in items]
        self.bits: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            for begin, end in pieces(len(text), self.budgets[number]):
                found.setdefault(text[begin:end], []).append((number, end))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def pattern(self, number: int) -> dict[str, int]:
        if number not in self.bits:
            bits: dict[str, int] = {}
            for i, c in enumerate(self.items[number][1]):
                bits[c] = bits.get(c, 0) | 1 << i
            self.bits[number] = bits
        return self.bits[number]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """``(item id, distance, end of the best place)`` of every item that occurs in a normalised text."""
        if not len(self.automaton):
            return []
        diagonals: dict[int, set[int]] = {}
        for last, places in self.automaton.iter(text):
            for number, end in places:
                diagonals.setdefault(number, set()).add(last + 1 - end)
        out = []
        for number, places in diagonals.items():
            item_id, item = self.items[number]
            if len(item) < MIN_CHARS:
                ends = [begin + len(item) for begin in sorted(places) if whole_words(text, begin, begin + len(item))]
                out += [(item_id, 0, end) for end in ends[:1]]
                continue
            if item in text:
                out.append((item_id, 0, text.index(item) + len(item)))
                continue
            best = self._best(number, sorted(places), text)
            if best is not None:
                out.append((item_id, *best))
        return out

    def _best(self, number: int, places: list[int], text: str) -> tuple[int, int] | None:
        """Best match around the diagonals of the piece hits; neighbours within the budget share a window."""
        budget, m = self.budgets[number], len(self.items[number][1])
        if not budget:
            return None
        best, at = None, 0
        while at < len(places):
            to = at + 1
            while to < len(places) and places[to] - places[to - 1] <= budget and places[to] - places[at] <= m:
                to += 1
            begin = max(0, places[at] - budget)
            found = myers(self.pattern(number), m, text[begin : places[to - 1] + m + budget], budget)
            if found is not None and (best is None or found[0] < best[0]):
                best = (found[0], begin + found[1])
            at = to
        return best


def _matcher(block) -> Matcher:
    """One matcher per Python worker and block."""
    if block.id not in _matchers:
        _matchers.clear()
        _matchers[block.id] = Matcher(*block.value)
    return _matchers[block.id]


class _Block:
    """A broadcast block of items with a key for the worker's cache."""

    def __init__(self, broadcast, number: str):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def item_blocks(items: DataFrame, rate: float, block_chars: int = BLOCK_CHARS) -> Iterator[_Block]:
    """Normalised items that are not empty, read row by row and broadcast block by block."""
    context = items.sparkSession.sparkContext
    block, held, number = [], 0, 0

    def close() -> _Block:
        sent = context.broadcast((block, rate))
        return _Block(sent, f"{context.applicationId}-{id(sent)}-{number}")

    for row in items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null").toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if block and held + len(text) > block_chars:
            yield close()
            block, held, number = [], 0, number + 1
        block.append((row["item_id"], text))
        held += len(text)
    if block:
        yield close()


def leaks(docs: DataFrame, items: DataFrame, *, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, end``: one row per row of ``docs (doc_id, text)`` and item of ``items (item_id, text)`` found in it.

    ``distance`` is the least number of edits, at most ``floor(rate * length)``; ``end`` is where the best place ends in
    the normalised text. Items under ``MIN_CHARS`` characters are found exactly, as whole words. Null and empty items are
    not searched, nor are items without an id; null and empty texts hold nothing. Equal items are all reported, an item repeated under one id
    too. Repeated rows of ``docs`` are reported as often as they occur, with a null id if they have none. Empty
    tables give an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, distance int, end long"
    out = spark.createDataFrame([], schema)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in item_blocks(items, rate, block_chars):
        out = out.unionAll(own.mapInArrow(_report(block), schema))
    return out


def _report(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block)
        for batch in slices(batches, 1024):
            rows = []
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), column_of(batch, "text").to_pylist()):
                rows.extend((doc_id, *m) for m in matcher.matches(normalised(text)))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "distance", "end"])

    return run


def keep_clean(docs: DataFrame, items: DataFrame, *, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found (see :func:`leaks`), with all their columns.

    Null and empty texts stay, repeated rows are judged alike, without items all rows stay, an empty table stays empty.
    A very short item takes every document that holds it as a word; leave such items out of ``items`` where that is not meant.
    """
    ship(docs.sparkSession)
    for block in item_blocks(items, rate, block_chars):
        docs = docs.mapInArrow(_clean(block), docs.schema)
    return docs


def _clean(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block)
        for batch in slices(batches, 1024):
            clean = [not matcher.matches(normalised(t)) for t in column_of(batch, "text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run

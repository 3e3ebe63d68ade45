"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of what follows. A byte costs
``-log2(n(c, s) / (N(c) + D(c)))`` bits in the longest context ``c`` in which it was seen, N being the context's
total and D its number of different bytes; a context in which it was not seen costs an escape of
``-log2(D / (N + D))`` bits and hands the byte to the context one byte shorter; in no context it costs 8 bits.
Statistics are frozen after training and there are no exclusions, so the code length of a text is an exact sum
of table entries. The language with the shortest code wins; of equal ones the first by name.

Every language with a text outside the held-out documents is learned, from a bounded sample: per language ``ROWS`` whole
texts of ``BYTES`` bytes in all, chosen by a hash of the text; where there are more than ``LANGUAGES`` languages, all get a
smaller share of what so many would take, at least one text. The trees of ``GROUP`` languages at a time are laid out as
hash tables over the last bytes whose entries hold the resolved cost under each of them; they are bounded by the sample
and broadcast. Scoring is numpy over Arrow batches and reads every byte of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lociary.llm.common import column_of, held_out, ship, slices, text_bytes

ORDER = 3
ROWS = 600
BYTES = 1_000_000
LANGUAGES = 50  # with full shares
GROUP = 8
UNDETERMINED = "und"
EVIDENCE_BYTES = 32
MAX_BITS = 8.0  # what a byte costs without any model
BLOCK = 1 << 19
BEFORE = 10  # the byte that stands before a text
EMPTY = np.uint32(0xFFFFFFFF)

LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Table:
    """Open-addressing map of 32-bit keys to rows."""

    keys: np.ndarray
    rows: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray) -> "Table":
        size = 1 << max(8, int(4 * len(keys)).bit_length())
        table = cls(np.full(size, EMPTY, np.uint32), np.full(size, -1, np.int32), 32 - size.bit_length() + 1)
        left = np.arange(len(keys))
        slots = table._slot(keys)
        while len(left):
            free = table.rows[slots] < 0
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            first = first[free[first]]
            table.keys[slots[first]], table.rows[slots[first]] = keys[left[first]], left[first]
            keep = np.ones(len(left), bool)
            keep[first] = False
            left, slots = left[keep], (slots[keep] + 1) % size
        return table

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is absent."""
        slots = self._slot(keys)
        rows = self.rows[slots]
        off = np.flatnonzero((rows >= 0) & (self.keys[slots] != keys))
        rows[off] = -1
        slots = slots[off]
        while len(off):
            slots = (slots + 1) % len(self.keys)
            there = self.rows[slots]
            hit = (there >= 0) & (self.keys[slots] == keys[off])
            rows[off[hit]] = there[hit]
            on = (there >= 0) & ~hit
            off, slots = off[on], slots[on]
        return rows


@dataclass
class Trees:
    """Of one group of languages."""

    languages: list[str]
    order_0: np.ndarray  # 256 x languages
    tables: list[Table]  # per order from 1: of the context and the byte
    costs: list[np.ndarray]
    contexts: list[Table]  # per order from 1: of the context
    escapes: list[np.ndarray]


@dataclass
class Model:
    languages: list[str]
    groups: list[Trees]


def byte_keys(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text, as one number."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    key, before = buf.astype(np.uint32), buf
    for k in range(1, ORDER + 1):
        shifted = np.empty_like(buf)
        shifted[1:] = before[:-1]
        shifted[starts] = BEFORE
        key |= shifted.astype(np.uint32) << np.uint32(8 * k)
        before = shifted
    return key


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Context trees of all languages from whole texts."""
    languages = sorted(samples)
    return Model(languages, [_trees(languages[at : at + GROUP], samples) for at in range(0, len(languages), GROUP)])


def _trees(languages: list[str], samples: dict[str, list[bytes]]) -> Trees:
    counted = []
    for language in languages:
        texts = [t for t in samples[language] if t]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]) if texts else np.zeros(1, np.int64)
        counted.append(np.unique(byte_keys(buf, offsets), return_counts=True))
    model = Trees(languages, np.zeros((256, len(languages))), [], [], [], [])
    lower_keys, lower_costs = None, None
    for order in range(ORDER + 1):
        mask = np.uint32((1 << (8 * (order + 1))) - 1 if order < 3 else 0xFFFFFFFF)
        grams = []
        for keys, n in counted:
            gram, inverse = np.unique(keys & mask, return_inverse=True)
            grams.append((gram, np.bincount(inverse, n, len(gram))))
        union = np.arange(256, dtype=np.uint32) if order == 0 else np.unique(np.concatenate([g for g, _ in grams]))
        heads = np.unique(union >> np.uint32(8))
        cost, escape = np.zeros((len(union), len(languages))), np.zeros((len(heads), len(languages)))
        if order == 0:
            lower = np.full((256, len(languages)), 8.0)
        else:
            lower = lower_costs[np.searchsorted(lower_keys, union & (mask >> np.uint32(8)))]
        for g, (gram, n) in enumerate(grams):
            head = np.searchsorted(heads, gram >> np.uint32(8))
            total, different = np.bincount(head, n, len(heads)), np.bincount(head, minlength=len(heads))
            seen = total > 0
            escape[seen, g] = -np.log2(different[seen] / (total[seen] + different[seen]))
            cost[:, g] = escape[np.searchsorted(heads, union >> np.uint32(8)), g] + lower[:, g]
            cost[np.searchsorted(union, gram), g] = -np.log2(n / (total[head] + different[head]))
        if order == 0:
            model.order_0 = cost
        else:
            model.tables.append(Table.of(union))
            model.costs.append(cost)
            model.contexts.append(Table.of(heads))
            model.escapes.append(escape)
        lower_keys, lower_costs = union, cost
    return model


def byte_costs(model: Trees, keys: np.ndarray) -> np.ndarray:
    """Bits of every byte under every language of a group."""
    out = np.zeros((len(keys), len(model.languages)))
    left = np.arange(len(keys))
    for order in range(ORDER, 0, -1):
        if not len(left):
            return out
        mask = np.uint32((1 << (8 * (order + 1))) - 1 if order < 3 else 0xFFFFFFFF)
        key = keys[left] & mask
        row = model.tables[order - 1].find(key)
        hit = row >= 0
        if hit.all() and len(left) == len(keys):
            return model.costs[order - 1][row]
        out[left[hit]] += model.costs[order - 1][row[hit]]
        left, key = left[~hit], key[~hit]
        head = model.contexts[order - 1].find(key >> np.uint32(8))
        known = head >= 0
        out[left[known]] += model.escapes[order - 1][head[known]]
    out[left] += model.order_0[keys[left] & np.uint32(255)]
    return out


def code_lengths(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every whole text under every language, block by block."""
    lengths = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(buf):
        return lengths
    keys = byte_keys(buf, offsets)
    for at in range(0, len(buf), BLOCK):
        to = min(at + BLOCK, len(buf))
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, to, side="left"))
        texts = np.arange(first, last)
        texts = texts[offsets[texts + 1] > offsets[texts]]
        begins = np.maximum(offsets[texts], at) - at
        for g, trees in enumerate(model.groups):
            own = slice(g * GROUP, g * GROUP + len(trees.languages))
            lengths[texts, own] += np.add.reduceat(byte_costs(trees, keys[at:to]), begins, axis=0)
    return lengths


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


def training_sample(docs: DataFrame, rows: int = ROWS, size: int = BYTES, languages: int = LANGUAGES) -> dict[str, list[bytes]]:
    """Whole texts of every language, chosen by a hash of the text; bounded by rows and bytes, which more than ``languages`` languages share.

    Texts of more than an eighth of the bytes come after all others of their language, so that no long one takes the place of
    many; a language whose first chosen text is over the bound still learns from that one. ``und`` is no language to learn.
    """
    open_rows = docs.select("doc_id", "text", "lang").filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & (F.length("text") > 0)
    )
    counts = open_rows.groupBy("lang").count().collect()
    if not counts:
        return {}
    rows, size = (max(1, whole * languages // max(languages, len(counts))) for whole in (rows, size))
    place = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40))
    # about eight times the wanted rows pass, and never none; the rest never moves
    shares = F.create_map(*[F.lit(v) for row in counts for v in (row["lang"], int(min(1.0, (8 * rows + 100) / row["count"]) * (1 << 40)))])
    chosen = place < F.try_element_at(shares, F.col("lang"))
    order = Window.partitionBy("lang").orderBy(F.octet_length("text") > size // 8, "place", "text")
    numbered = open_rows.filter(chosen).withColumn("place", place).select(
        "lang", F.row_number().over(order).alias("number"), F.col("text").cast("binary").alias("data"), F.octet_length("text").cast("long").alias("bytes")
    ).filter(F.col("number") <= rows)
    upto = F.sum("bytes").over(Window.partitionBy("lang").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    samples: dict[str, list[bytes]] = {}
    for row in numbered.withColumn("upto", upto).filter((F.col("upto") <= size) | (F.col("number") == 1)).orderBy("lang", "number").toLocalIterator():
        samples.setdefault(row["lang"], []).append(bytes(row["data"]))
    return samples


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``, by the text alone."""
    spark = docs.sparkSession
    ship(spark)
    frozen = spark.sparkContext.broadcast(model)
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen.value
        for batch in slices(batches, 256):
            texts = column_of(batch, "__text")
            buf, offsets = text_bytes(texts)
            sizes = np.maximum(np.diff(offsets), 1)
            lettered = np.array([has_letter(t) for t in texts.to_pylist()], bool)
            if model.languages:
                bits = code_lengths(model, buf, offsets)
                best = np.argmin(bits, axis=1)
                least = bits[np.arange(len(best)), best]
                excess = (bits - least[:, None]) * np.minimum(1, EVIDENCE_BYTES / sizes)[:, None]
                score = np.where(lettered, np.round(1 / np.exp2(-excess).sum(1), 9), 0.0)
                names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
                per_byte = np.round(least / sizes, 9)
            else:
                score, names, per_byte = np.zeros(len(sizes)), [UNDETERMINED] * len(sizes), np.zeros(len(sizes))
            yield pa.record_batch(
                [*[column_of(batch, c) for c in keep], pa.array(names), pa.array(score), pa.array(per_byte)],
                names=[*keep, "lang_pred", "score", "bits_per_byte"],
            )

    own = docs.select(*keep, F.col("text").alias("__text"))
    return own.mapInArrow(run, ", ".join([*kept, "lang_pred string", "score double", "bits_per_byte double"]))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` for every row of ``docs (doc_id, text, lang)``.

    ``lang`` teaches where it is not null and the document is not held out, and is never read for a prediction. A
    text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be learned. The
    score is the share of the predicted language among all, each weighted by its code length over at most 32 bytes
    of evidence. Repeated rows stay as many rows; a null id is held out; an empty table gives an empty table.
    """
    model = fit(training_sample(docs))
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_languages(docs: DataFrame, wanted: list[str] | None = None, *, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` in one of the wanted languages (any learned one if None), with all their columns.

    Texts without a letter go, null and empty ones with them, and texts that even the best language codes in more than
    ``max_bits`` bits a byte. Repeated rows are judged alike; a null id teaches nothing but its text is judged; where
    nothing can be learned no row stays; an empty table stays empty.
    """
    names = docs.columns
    # a column of the same name as one of the results gets out of the way for the prediction
    held = [f"__c{i}" for i in range(len(names))]
    moved = docs.select(*[F.col(f"`{n}`").alias(h) for n, h in zip(names, held)], F.col("text"))
    found = predict(moved, fit(training_sample(docs)), held)
    fine = (F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") <= max_bits)
    if wanted is not None:
        fine = fine & F.col("lang_pred").isin(*wanted)
    return found.filter(fine).select(*[F.col(h).alias(n) for n, h in zip(names, held)])

"""Word and shingle hashes of whole texts, computed over a batch of texts at once."""

from __future__ import annotations

import numpy as np

from lociary.llm.common import mix, random_words

#: A word is a run of bytes that are none of these: the space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_CODES = random_words(256, 11)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 20


#: All ASCII bytes that are neither letters nor digits, for words without punctuation.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words of each text."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    solid = ~between[buf]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] = solid[inner]
    last = solid
    last[:-1] &= ~solid[1:]
    cut = ~between[buf[inner - 1]]
    last[inner - 1] = cut
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _powers(count: int) -> np.ndarray:
    powers = np.full(count, BASE, np.uint64)
    if count:
        powers[0] = 1
    return np.multiply.accumulate(powers)


def _long_word(word: np.ndarray) -> np.uint64:
    """The sum of a word longer than a block, block by block."""
    total, scale, powers = 0, 1, _powers(BLOCK)
    step = int(powers[-1]) * int(BASE) % (1 << 64)
    for at in range(0, len(word), BLOCK):
        piece = BYTE_CODES[LOWER[word[at : at + BLOCK]]]
        total = (total + int(np.sum(piece * powers[: len(piece)], dtype=np.uint64)) * scale) % (1 << 64)
        scale = scale * step % (1 << 64)
    return np.uint64(total)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word with A-Z lower-cased; the working memory is bounded by the block size."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + BLOCK, side="right")))
        span = lengths[at:to]
        if to == at + 1 and span[0] > BLOCK:
            out[at] = _long_word(buf[starts[at] : ends[at]])
        else:
            begin = np.cumsum(span) - span
            place = np.arange(int(span.sum())) - np.repeat(begin, span)
            codes = BYTE_CODES[LOWER[buf[place + np.repeat(starts[at:to], span)]]]
            out[at:to] = np.add.reduceat(codes * _powers(int(span.max()))[place], begin)
        at = to
    return mix(out ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles of ``width`` words.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    starts, ends, counts = word_spans(buf, offsets)
    hashes = word_hashes(buf, starts, ends)
    factors = random_words(width, 23) | np.uint64(1)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    sets, at = [], 0
    for count in counts.tolist():
        if count >= width:
            sets.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            short = np.sum(hashes[at : at + count] * factors[:count], dtype=np.uint64)
            sets.append(mix(np.array([short ^ np.uint64(count << 40)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += count
    return sets

"""Token counts of whole texts under a unigram tokenizer, by Viterbi over Aho-Corasick matches, without the tokens.

Vocabulary and scores are those of a sentencepiece model file. A text's spaces become ``MARK``, one more stands before
the text, and the best segmentation is the one with the largest sum of scores. An automaton over all pieces lists the
pieces that end at each character, longest first; for each place the best sum and the number of pieces on its path are
kept. Exact tie rules of the tokenizer: a path replaces another only if its sum is larger, and earlier starts are tried
first, so of equal sums the longest last piece stays. A character that begins no piece may stand alone at ``UNKNOWN``
below the lowest score; a run of such characters is spelled with one byte piece for each of its UTF-8 bytes.

No piece has ``MARK`` after another character, so no best path crosses such a place and a text falls into words that are
counted one by one, with no limit on their length. Counts of words are remembered per Python worker up to a
fixed number of words. Scores are sums of integers in double precision, so the parts add up exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lociary.llm.common import column_of, ship, slices

MARK = "▁"
UNKNOWN = 10.0
MAX_PIECES = 1_000_000
REMEMBERED = 200_000
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

_counters: dict[int, "Counting"] = {}


def read_pieces(spark: SparkSession, path: str) -> Broadcast:
    """Pieces and scores of a sentencepiece model, read on the driver; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if len(model) > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    pieces = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(len(model))
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }
    return spark.sparkContext.broadcast(pieces)


class Counting:
    """Counts pieces of words by dynamic programming."""

    def __init__(self, pieces: dict[str, float]):
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece reaches over a word boundary")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.pieces = pieces
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word."""
        size = len(word)
        best: list[float | None] = [0.0] + [None] * size
        count = [0] * (size + 1)
        ends = iter(self.automaton.iter(word)) if len(self.automaton) else iter(())
        hit = next(ends, None)
        for end in range(1, size + 1):
            start = end - 1
            single = False
            while hit is not None and hit[0] + 1 == end:
                length, score = hit[1]
                single |= length == 1
                begin = end - length
                total = best[begin] + score
                if best[end] is None or total > best[end]:
                    best[end], count[end] = total, count[begin] + 1
                hit = next(ends, None)
            if not single:
                total = best[start] + self.unknown
                if best[end] is None or total > best[end]:
                    best[end] = total
                    count[end] = count[start] + len(word[start].encode("utf-8", "surrogatepass"))
        return count[size]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for word, times in Counter(WORDS.findall(MARK + text.replace(" ", MARK))).items():
            n = self.known.get(word)
            if n is None:
                n = self.word(word)
                if len(word) <= 64:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[word] = n
            total += n * times
        return total


def _counter(pieces: Broadcast) -> Counting:
    if pieces.id not in _counters:
        _counters[pieces.id] = Counting(pieces.value)
    return _counters[pieces.id]


class _Sent:
    """A broadcast with a key for the worker's cache."""

    def __init__(self, broadcast: Broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def count_tokens(docs: DataFrame, pieces: Broadcast) -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs (doc_id, text)``; other columns are ignored.

    Null and empty texts have no tokens. Repeated rows stay as many rows, a null id stays null, an empty table gives
    an empty table.
    """
    context = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    sent = _Sent(pieces, f"{context.applicationId}-{id(pieces)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counter(sent)
        for batch in slices(batches, 256):
            counts = [counting.text(t) for t in column_of(batch, "text").to_pylist()]
            yield pa.record_batch([column_of(batch, "doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")

"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file (one ``base64 rank`` line per token) is read on the driver and broadcast: its size is checked
against ``MAX_RANK_BYTES``. Executors build one encoder per Python worker from it, so no executor needs the file.

Long texts are encoded in pieces. A place before white space (as the pattern's engine knows it) that follows anything
else is a boundary of the split pattern whatever surrounds it: no alternative of the pattern reaches over it, and the
look-ahead of ``\\s+(?!\\S)`` is only tried on white space. A long run of white space is one match, of all but its last
character where anything follows it, as two white spaces in a row begin no other alternative; it is merged without the
regular expression, whose engine gives up on a million characters of it. Encoding the pieces one by one therefore
gives the ids of the whole text, with memory bounded by the longest run without such a place.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lociary.llm.common import column_of, ship, slices

MAX_RANK_BYTES = 64 << 20
PIECE_CHARS = 1 << 16
#: The characters of the property White_Space, which the pattern's engine takes for ``\\s``.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
LONG_WHITE = re.compile(f"[{WHITE}]{{4096,}}")

_encoders: dict[str, tuple] = {}


def read_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a rank file on the driver, for all executors."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encoder(ranks: bytes, pattern: str):
    """The tiktoken encoder of a rank file; one per Python worker, rank file and pattern."""
    import tiktoken

    name = f"{hash(ranks)} {pattern}"
    if name not in _encoders:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={}), ranks
    return _encoders[name][0]


def unsplit(encoding):
    """An encoder of the same ranks that takes what it is given as one piece."""
    return encoder(_encoders[encoding.name][1], r"[\s\S]+")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at the first safe place after every ``size`` characters."""
    at = 0
    while len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        if found is None or found.start() == len(text):
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def white_runs(text: str) -> Iterator[tuple[str, str]]:
    """The text as pairs: a part to be split by the pattern, and the match of a long run of white space after it, or nothing."""
    at = 0
    for run in LONG_WHITE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()], text[run.start() : end]
        at = end
    yield text[at:] if at else text, ""


def encode(encoding, text: str) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if len(text) <= PIECE_CHARS:
        return np.array(encoding.encode_ordinary(text), "<u4")
    ids = []
    for part, white in white_runs(text):
        ids += [np.array(encoding.encode_ordinary(p), "<u4") for p in pieces(part)]
        if white:
            ids.append(np.array(unsplit(encoding).encode_ordinary(white), "<u4"))
    return np.concatenate(ids)


def decode(encoding, ids: np.ndarray) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8 for a part of a text."""
    return encoding.decode_bytes(ids.tolist())


def _over_texts(docs: DataFrame, ranks: Broadcast, pattern: str, schema: str, make) -> DataFrame:
    """``make(ids, encoding)`` of every text as further columns beside doc_id."""
    ship(docs.sparkSession)
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value, pattern)
        for batch in slices(batches, 256):
            made = [make(encode(encoding, t or ""), encoding) for t in column_of(batch, "text").to_pylist()]
            columns = [pa.array([m[k] for m in made]) for k in range(len(fields) - 1)]
            yield pa.record_batch([column_of(batch, "doc_id"), *columns], names=fields)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encode_texts(docs: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array<long>) for every row of ``docs (doc_id, text)``; null and empty texts have no ids."""
    return _over_texts(docs, ranks, pattern, "doc_id long, ids array<long>", lambda ids, _: (ids.astype(np.int64).tolist(),))


def decode_ids(encoded: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """``doc_id, bytes`` for every row of ``encoded (doc_id, ids)``; null ids are empty."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value, pattern)
        for batch in slices(batches, 256):
            data = [encoding.decode_bytes(ids or []) for ids in column_of(batch, "ids").to_pylist()]
            yield pa.record_batch([column_of(batch, "doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def token_digests(docs: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """Encode every whole text, decode its ids, and return the digests of both.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs (doc_id, text)``, other columns
    ignored: null and empty texts have no tokens and the digests of nothing, repeated rows stay as many rows,
    a null id stays null, an empty table gives an empty table.
    """

    def digest(ids: np.ndarray, encoding) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(encoding, ids)).hexdigest()

    return _over_texts(docs, ranks, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)

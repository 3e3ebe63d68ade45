"""Block-gzipped text read and written by many tasks.

A block gzip file is a row of small gzip members, each of whose headers tells its own length. The usual header is
always the same 16 bytes, so Spark's text source with these bytes as the line separator cuts a file of any size into
ranges and gives each task the blocks that begin in its range, on any file system. Blocks end anywhere in a line:
every range gives its whole lines, and its first and last piece, of which there are two a range, are put together by
file in a second, small pass.

A member with another header (more fields, a time stamp) stays behind the block before it and is read from its own
length; a file without a single usual header is one range. Lengths and checksums of all blocks are checked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the format: the usual header up to the block's length, and the empty block that ends a file.
HEADER = bytes.fromhex("1f8b08040000000000ff0600424302 00")
END = HEADER + bytes.fromhex("1b0003000000000000000000")
BLOCK_TEXT = 65_280
PENDING = 256


def members(data: bytes) -> Iterator[bytes]:
    """The texts of the gzip members that ``data`` is made of; each must tell its length in a ``BC`` field."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != HEADER[:4]:
            raise ValueError("not block gzip: no member header with extra fields")
        fields_end, field, size = at + 12 + int.from_bytes(data[at + 10 : at + 12], "little"), at + 12, None
        while field + 4 <= fields_end:
            length = int.from_bytes(data[field + 2 : field + 4], "little")
            if data[field : field + 2] == b"BC":
                size = int.from_bytes(data[field + 4 : field + 6], "little") + 1
            field += 4 + length
        if size is None or at + size > len(data):
            raise ValueError("block gzip: a block without length, or cut short")
        text = zlib.decompress(data[fields_end : at + size - 8], -15)
        check, length = int.from_bytes(data[at + size - 8 : at + size - 4], "little"), int.from_bytes(data[at + size - 4 : at + size], "little")
        if zlib.crc32(text) != check or len(text) != length:
            raise ValueError("block gzip: checksum or length of a block differs")
        yield text
        at += size


def block(text: bytes, level: int = 6) -> bytes:
    """One block of at most ``BLOCK_TEXT`` bytes of text."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(text) + packer.flush()
    if len(packed) > 65_000:  # text that does not compress is stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        packed = packer.compress(text) + packer.flush()
    size = len(HEADER) + 2 + len(packed) + 8
    return HEADER + (size - 1).to_bytes(2, "little") + packed + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def _ranges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, start, raw``: the blocks of every range of every file, in order within a range, without their usual header."""
    raw = spark.read.option("lineSep", HEADER.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """``file, start, members``: what follows a usual header has it back; the first record of a file stands before any."""
    at = None
    for batch in batches:
        for file, start, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
            first = start == 0 and at != (file, start)
            at = file, start
            if raw:
                yield file, start, raw if first else HEADER + raw


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that begin and end in a range, but for the first piece, which may have begun before it."""
    at, rest, begun, seen = None, b"", False, False
    for file, start, raw in _blocks(batches):
        if at != (file, start):
            at, rest, begun, seen = (file, start), b"", start == 0, False
        text = b"".join(members(raw))
        if b"\n" not in text:
            rest = rest + text if begun else b""
            continue
        *lines, rest = (rest + text).split(b"\n")
        first = [start == 0 and not seen] + [False] * (len(lines) - 1)
        if not begun:
            lines, first = lines[1:], first[1:]
        begun = seen = True
        if lines:
            yield pa.record_batch([pa.array([file] * len(lines)), pa.array(lines, pa.binary()), pa.array(first)], names=["file", "line", "first"])


def _end_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, start, whole, head, tail`` per range: what stands before its first and after its last line feed.

    Without a line feed all of it is ``head`` and ``whole``. Only blocks at both ends are unpacked: of those between,
    ``PENDING`` wait at most, as soon as one in their middle is known to hold a line feed.
    """

    def made(at: tuple[str, int], whole: bool, head: bytes, tail: list[bytes]) -> pa.RecordBatch:
        text = b"".join(t for raw in tail for t in members(raw))
        columns = [[at[0]], [at[1]], [whole], [head if not whole else head + text], [text[text.rfind(b"\n") + 1 :] if not whole else b""]]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "whole", "head", "tail"])

    at, whole, head, waiting = None, True, b"", []
    for file, start, raw in _blocks(batches):
        if at != (file, start):
            if at is not None:
                yield made(at, whole, head, waiting)
            at, whole, head, waiting = (file, start), True, b"", []
        if whole:
            text = b"".join(members(raw))
            before, feed, _ = text.partition(b"\n")
            head += before
            if feed:
                whole, waiting = False, [raw]
        else:
            waiting.append(raw)
            if len(waiting) > PENDING and any(b"\n" in t for t in members(waiting[PENDING // 2])):
                waiting = waiting[PENDING // 2 :]
    if at is not None:
        yield made(at, whole, head, waiting)


def _pieced(keys: tuple, pieces: pa.Table) -> pa.Table:
    """The lines of one file that reach over ranges, in order."""
    lines, rest, rows = [], b"", sorted(pieces.to_pylist(), key=lambda r: r["start"])
    for row in rows:
        if row["whole"]:
            rest += row["head"]
            continue
        if row["start"] > 0:  # a first range gives its first line itself
            lines.append(rest + row["head"])
        rest = row["tail"]
    if rest:  # a last line without a line feed
        lines.append(rest)
    first = [k == 0 and rows[0]["whole"] for k in range(len(lines))]
    return pa.table({"file": pa.array([keys[0].as_py()] * len(lines), pa.string()), "line": pa.array(lines, pa.binary()), "first": pa.array(first, pa.bool_())})


def read_block_gzip(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line, first`` of block-gzipped text files, in no order; ``first`` marks the first line of a file.

    ``spark.sql.files.maxPartitionBytes`` sizes the ranges. Lines are those of the text source: cut at line feeds, a
    carriage return before one removed, a last line without line feed kept. Empty files give no line.
    """
    schema = "file string, line binary, first boolean"
    blocks = _ranges(spark, paths)
    pieces = blocks.mapInArrow(_end_pieces, "file string, start long, whole boolean, head binary, tail binary")
    whole = blocks.mapInArrow(_whole_lines, schema)
    joined = pieces.groupBy("file").applyInArrow(_pieced, schema)
    return whole.unionAll(joined).select("file", F.regexp_replace(F.col("line").cast("string"), "\r$", "").alias("line"), "first")


def first_line(spark: SparkSession, paths: str | list[str]) -> str:
    """The first line of one of the files, from its first blocks; it must end within eight of them."""
    begins = _ranges(spark, paths).filter("start = 0").limit(9).toArrow()
    file, text = None, b""
    for at, start, raw in _blocks(begins.to_batches()):
        if file not in (None, at):
            break
        file, text = at, text + b"".join(members(raw))
        if b"\n" in text:
            break
    return text.partition(b"\n")[0].removesuffix(b"\r").decode()


def write_block_gzip(lines: DataFrame, path: str, *, header: str | None = None, overwrite: bool = False) -> None:
    """Text lines (the only column of ``lines``) as block-gzipped files, each beginning with ``header`` where one is given.

    One file per task. Every block is followed by an empty one, which readers skip and which is also what ends a file.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([header.encode()], len(header)) if header is not None else ([], 0)

        def cut(last: bool) -> tuple[list[bytes], list[bytes]]:
            text = b"\n".join(held) + b"\n" if last and held else b"\n".join(held)
            full = len(text) if last else len(text) // BLOCK_TEXT * BLOCK_TEXT
            return [block(text[k : min(k + BLOCK_TEXT, full)]) for k in range(0, full, BLOCK_TEXT)], [text[full:]]

        for batch in batches:
            for line in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(line or b"")
                size += len(held[-1]) + 1
                if size >= 16 * BLOCK_TEXT:
                    blocks, held = cut(False)
                    size = len(held[0])
                    yield pa.record_batch([pa.array(blocks, pa.binary())], names=["value"])
        if held:
            yield pa.record_batch([pa.array(cut(True)[0], pa.binary())], names=["value"])

    blocks = lines.mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = blocks.write.mode("overwrite" if overwrite else "error")
    writer.option("lineSep", END.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)

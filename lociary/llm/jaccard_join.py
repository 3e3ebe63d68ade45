"""N-gram Jaccard join by multiple-global-order filtering.

Two texts link when their sets of word shingles satisfy ``100 * |intersection| >= percent * |union|``.
For such a pair, the first ``n - ceil(percent * n / 100) + 1`` tokens of each set under ANY total order of
all tokens must share a token. Three orders are used, all of them rare tokens first, with different
tie-breaks and granularity. A text whose prefix holds only tokens found nowhere else has no partner and
leaves at once; the rest are candidates of each other only if they share a prefix token under every order.

Work flow, in which only hashes and integers move, never texts:

1. Each text becomes its sorted set of 64-bit shingle hashes (numpy, over batches of texts). Texts are packed
   into chunks; a chunk sends each range of hashes as one binary value, so that the document frequencies of
   all tokens of all texts are counted exactly with about nine bytes per token.
2. The frequencies of the tokens that are found more than once return to their chunk. A text that still has
   a repeated token in its prefix is written with its tokens and its prefixes.
3. Texts with equal sets are one class. Links are sought between classes: first to one leader per prefix
   token, then, in the tokens whose classes are not yet all in one component, between every two classes of
   different components whose sizes still allow a link at the token's place. That finds all components exactly
   without forming the pairs inside a group. Every link is verified on the whole sets.

Sizes: a token that is found in more than ``WIDE`` texts of a chunk is sent once for the whole chunk, so a
token of a third of all texts costs one entry per chunk. Chunks hold at most ``CHUNK_TOKENS`` tokens unless a
single text is larger. The number of ranges follows ``spark.sql.shuffle.partitions``.

Sets are compared by 64-bit hash: among 10^10 different shingles two or three pairs are expected to share one,
which moves a similarity by one shingle of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lociary.llm.common import column_of, mix, ship, slices, store, text_bytes
from lociary.llm.components import connected_components
from lociary.llm.words import shingle_sets
from lociary.operators.keyed import attach

WIDTH = 5
PERCENT = 75
CHUNK_TOKENS = 1 << 18
CHUNK_TEXTS = 8192
WIDE = 8
WIDE_MARK = 65535
COMMON = 65535  # the orders do not tell apart tokens found more often

TOKENS, HEADER = 0, 1
ORDER_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))

PACKED = "slot long, chunk long, kind int, data binary"
PROFILE = "doc_id long, place long, n long, set_key long, single long, rarity double, tokens array<long>, prefix array<long>, prefix_2 array<long>, prefix_3 array<long>"


def _bits(ranges: int) -> int:
    return ranges.bit_length() - 1


def _set_key(tokens: np.ndarray) -> np.uint64:
    """One 64-bit hash of a whole set."""
    spread = mix(tokens + np.uint64(0x9E3779B97F4A7C15))
    return mix(np.array([np.sum(spread, dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64))[0]


def _pack(header: dict[str, np.ndarray]) -> bytes:
    """Arrays one after another, each with its type and length."""
    sink = pa.BufferOutputStream()
    names = list(header)
    batch = pa.record_batch([pa.array([header[k].tobytes()], pa.large_binary()) for k in names], names=names)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> dict[str, bytes]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {k: batch.column(k)[0].as_py() for k in batch.schema.names}


def _close_chunk(chunk: int, ranges: int, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
    """One row per range of hashes, and one header with what stays in the chunk."""
    sizes = np.array([len(s) for s in sets], np.int64)
    keys = np.array([_set_key(s) for s in sets], np.uint64)
    _, kept = np.unique(keys, return_index=True)
    kept = kept[sizes[kept] > 0]
    tokens = np.concatenate([sets[i] for i in kept]) if len(kept) else np.zeros(0, np.uint64)
    owner = np.repeat(kept, sizes[kept]).astype(np.uint16)
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    runs = np.diff(np.append(fresh, len(tokens)))
    wide = np.repeat(runs > WIDE, runs)
    header = _pack({
        "null": np.array([i is None for i in ids], bool),
        "ids": np.array([0 if i is None else i for i in ids], np.int64),
        "sizes": sizes, "keys": keys, "wide_tokens": tokens[wide], "wide_owner": owner[wide],
    })
    owner = np.where(wide, np.uint16(WIDE_MARK), owner)
    keep = ~wide
    keep[fresh] = True
    tokens, owner = tokens[keep], owner[keep]
    bucket = (tokens >> np.uint64(64 - _bits(ranges))).astype(np.int64)
    bounds = np.searchsorted(bucket, np.arange(ranges + 1))
    slots, blobs = [], []
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[b], bounds[b + 1])
        slots.append(b)
        low = np.ascontiguousarray(tokens[part]).view(np.uint8).reshape(-1, 8)[:, :7]  # the range tells the highest byte
        blobs.append(low.tobytes() + owner[part].tobytes())
    kinds = [TOKENS] * len(slots) + [HEADER]
    slots.append(ranges + chunk)
    blobs.append(header)
    return pa.record_batch(
        [pa.array(slots, pa.int64()), pa.array([chunk] * len(slots), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())],
        names=["slot", "chunk", "kind", "data"],
    )


def _chunks(width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        number, ids, sets, held = 0, [], [], 0
        for batch in slices(batches, 1024):
            found = shingle_sets(*text_bytes(column_of(batch, "text")), width)
            for doc_id, tokens in zip(column_of(batch, "doc_id").to_pylist(), found):
                ids.append(doc_id)
                sets.append(tokens)
                held += len(tokens)
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_TEXTS:
                    yield _close_chunk(task + number, ranges, ids, sets)
                    number, ids, sets, held = number + 1, [], [], 0
        if ids:
            yield _close_chunk(task + number, ranges, ids, sets)

    return run


def _counts(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        if column_of(table, "kind")[0].as_py() == HEADER:
            return table.select(["chunk", "kind", "data"])
        return _count(table, column_of(table, "slot")[0].as_py() >> _bits(ranges) - 8)

    return run


def _count(table: pa.Table, highest: int) -> pa.Table:
    """Frequencies of the tokens of one range; the entries of repeated tokens go back to their chunks."""
    blobs = [b.as_py() for b in column_of(table, "data")]
    lengths = np.array([len(b) // 9 for b in blobs])
    parts = np.full((int(lengths.sum()), 8), highest, np.uint8)
    parts[:, :7] = np.concatenate([np.frombuffer(b, np.uint8, 7 * n) for b, n in zip(blobs, lengths)]).reshape(-1, 7)
    tokens = parts.view(np.uint64).ravel()
    owner = np.concatenate([np.frombuffer(b[7 * n :], np.uint16) for b, n in zip(blobs, lengths)])
    del blobs
    weight = np.where(owner == WIDE_MARK, WIDE + 1, 1)
    order = np.argsort(tokens)
    ordered = tokens[order]
    fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(weight[order], fresh)
    frequency = np.empty(len(tokens), np.uint16)
    frequency[order] = np.repeat(np.minimum(total, COMMON), np.diff(np.append(fresh, len(tokens))))
    chunks, out, at = [], [], 0
    for chunk, n in zip(column_of(table, "chunk").to_pylist(), lengths.tolist()):
        part = slice(at, at + n)
        again = frequency[part] > 1
        if again.any():
            chunks.append(chunk)
            out.append(tokens[part][again].tobytes() + owner[part][again].tobytes() + frequency[part][again].tobytes())
        at += n
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "kind": pa.array([TOKENS] * len(chunks), pa.int32()), "data": pa.array(out, pa.binary()),
    })


def _expand(tokens: np.ndarray, owner: np.ndarray, frequency: np.ndarray, wide_tokens: np.ndarray, wide_owner: np.ndarray):
    """Entries sent once for a whole chunk become one entry for each text that has the token."""
    wide = owner == WIDE_MARK
    if not wide.any():
        return tokens, owner, frequency
    order = np.argsort(tokens[wide])
    known, their = tokens[wide][order], frequency[wide][order]
    at = np.searchsorted(known, wide_tokens)
    return (
        np.concatenate([tokens[~wide], wide_tokens]),
        np.concatenate([owner[~wide], wide_owner]),
        np.concatenate([frequency[~wide], their[at]]),
    )


def _prefixes(tokens: np.ndarray, frequency: np.ndarray, single: int, percent: int, n: int) -> list[np.ndarray] | None:
    """Repeated tokens of the prefix under each order; None if the prefix holds only tokens of this text."""
    length = n - (percent * n + 99) // 100 + 1
    if single >= length:
        return None
    coarse = np.floor(np.log2(frequency))
    majors = (frequency, coarse, frequency)
    return [tokens[np.lexsort((mix(tokens ^ s), m))[: length - single]] for m, s in zip(majors, ORDER_SEEDS)]


def _assemble(percent: int):
    def run(table: pa.Table) -> pa.Table:
        header, blobs, chunk = None, [], column_of(table, "chunk")[0].as_py()
        for kind, data in zip(column_of(table, "kind").to_pylist(), column_of(table, "data")):
            if kind == HEADER:
                header = _unpack(data.as_py())
            else:
                blobs.append(data.as_py())
        ids = np.frombuffer(header["ids"], np.int64)
        null = np.frombuffer(header["null"], bool)
        sizes = np.frombuffer(header["sizes"], np.int64)
        keys = np.frombuffer(header["keys"], np.uint64)
        lengths = [len(b) // 12 for b in blobs]
        tokens = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, lengths)]) if blobs else np.zeros(0, np.uint64)
        owner = np.concatenate([np.frombuffer(b, np.uint16, n, 8 * n) for b, n in zip(blobs, lengths)]) if blobs else np.zeros(0, np.uint16)
        frequency = np.concatenate([np.frombuffer(b, np.uint16, n, 10 * n) for b, n in zip(blobs, lengths)]) if blobs else np.zeros(0, np.uint16)
        wide_tokens, wide_owner = np.frombuffer(header["wide_tokens"], np.uint64), np.frombuffer(header["wide_owner"], np.uint16)
        tokens, owner, frequency = _expand(tokens, owner, frequency, wide_tokens, wide_owner)
        order = np.argsort(owner, kind="stable")
        tokens, owner, frequency = tokens[order], owner[order], frequency[order]
        bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        first = np.zeros(len(ids), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        single, rarity = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        arrays: list[list] = [[], [], [], []]
        for i, n in enumerate(sizes.tolist()):
            part = slice(bounds[i], bounds[i + 1])
            own = tokens[part]
            single[i] = n - len(own)
            rarity[i] = (single[i] + np.sum(1 / np.sort(frequency[part]))) / max(n, 1)
            found = _prefixes(own, frequency[part], int(single[i]), percent, n) if first[i] and n else None
            for column, value in zip(arrays, [None] * 4 if found is None else [own, *found]):
                column.append(None if value is None else value.view(np.int64))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null), "place": pa.array((chunk << 16) + np.arange(len(ids))), "n": pa.array(sizes), "set_key": pa.array(keys.view(np.int64)),
            "single": pa.array(single), "rarity": pa.array(rarity),
            **{name: pa.array(column, pa.list_(pa.int64())) for name, column in zip(["tokens", "prefix", "prefix_2", "prefix_3"], arrays)},
        })

    return run


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document its set size and set key and, where a partner is possible, its repeated tokens and prefixes."""
    spark = docs.sparkSession
    ship(spark)
    ranges = max(256, 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunks(width, ranges), PACKED)
    counted = packed.groupBy("slot").applyInArrow(_counts(ranges), "chunk long, kind int, data binary")
    return store(counted.groupBy("chunk").applyInArrow(_assemble(percent), PROFILE), "profiles")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of classes that pass the filters of the other orders and the exact test."""
    pairs = store(pairs, "pairs")
    ends = pairs.select(F.col("u").alias("set_key")).unionAll(pairs.select("v")).distinct()
    used = attach(sets, ends, ["set_key"], "left_semi").select("set_key", "n", "tokens", "prefix_2", "prefix_3")
    left = used.select(*[F.col(c).alias(f"{c}_u") for c in used.columns]).withColumnRenamed("set_key_u", "u")
    right = used.select(*[F.col(c).alias(f"{c}_v") for c in used.columns]).withColumnRenamed("set_key_v", "v")
    both = pairs.join(left, "u").join(right, "v")
    both = both.filter(F.arrays_overlap("prefix_2_u", "prefix_2_v") & F.arrays_overlap("prefix_3_u", "prefix_3_v"))
    shared = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return both.filter(shared * 100 >= (F.col("n_u") + F.col("n_v") - shared) * percent).select("u", "v")


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """One row per prefix token of a class, with the largest partner for which the token is still in the prefix.

    Two sets of sizes a and b that link share at least ``percent * (a + b) / (100 + percent)`` tokens, so their first
    common token leaves at least so many tokens in each: of a token at place p, ``a - p``.
    """
    placed = sets.select("set_key", "n", "rarity", "single", F.posexplode("prefix").alias("place", "token"))
    left = F.col("n") - F.col("single") - F.col("place")
    return placed.select("token", "set_key", "n", "rarity", (F.floor(left * (100 + percent) / percent) - F.col("n")).alias("reach"))


def _open_tokens(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the tokens whose classes are in several components, with their component and the token's leader.

    The leader is the class whose tokens are the most common ones: in a group of near copies the one that the
    others were made from. Rows that reach no class of their token are left out.
    """
    component = F.col("set_key")
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
        component = F.coalesce("component", "set_key")
    rows = rows.withColumn("component", component)
    per_token = rows.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"),
        F.min(F.struct("rarity", "set_key", "n", "reach", "component")).alias("lead"),
    )
    spread = per_token.filter("low < high").select("token", "least", "lead")
    return store(rows.join(spread, "token").filter("reach >= least"), "open-tokens")


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Enough verified links ``(u, v)`` between classes to hold every component together; none that fails the test."""
    rows = prefix_rows(sets, percent)
    opened = _open_tokens(rows, None)
    # to the leader of each prefix token
    reached = (F.col("set_key") != F.col("lead.set_key")) & (F.col("n") <= F.col("lead.reach")) & (F.col("lead.n") <= F.col("reach"))
    met = opened.filter(reached).select(F.col("set_key").alias("u"), F.col("lead.set_key").alias("v")).distinct()
    edges = store(verified(met, sets, percent), "links")
    # what is left: every two classes of different components that reach each other by a prefix token
    labels = store(connected_components(edges), "labels")
    opened = _open_tokens(opened.select("token", "set_key", "n", "rarity", "reach"), labels)
    a = opened.select("token", F.col("set_key").alias("u"), F.col("n").alias("n_a"), F.col("reach").alias("r_a"), F.col("component").alias("c_a"))
    b = opened.select("token", F.col("set_key").alias("v"), F.col("n").alias("n_b"), F.col("reach").alias("r_b"), F.col("component").alias("c_b"))
    rest = a.join(b, "token").filter("c_a < c_b and n_a <= r_b and n_b <= r_a").select("u", "v").distinct()
    return store(edges.unionAll(verified(rest, sets, percent)), "links")


def jaccard_components(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text)``; other columns are ignored.

    Words are runs of characters other than the space and the control characters 9 to 13; A-Z count as a-z.
    A null or wordless text has no shingles and links with nothing; a text of fewer than ``width`` words has
    one. ``component_id`` is the smallest id reachable over links. Repeated rows are copies and stay as many
    rows. A null id is returned as it is, takes part in links, and never names a component; the component is
    null where no member has an id. An empty table gives an empty table.
    """
    profile = profiles(docs, width, percent)
    # of the copies of a set in different chunks the first stands for all; only places move to tell which
    partnered = profile.filter(F.col("tokens").isNotNull())
    first = partnered.groupBy("set_key").agg(F.min("place").alias("place"))
    sets = attach(partnered.drop("doc_id"), first, ["set_key", "place"], "left_semi")
    labels = connected_components(class_links(sets, percent))
    plain = profile.select("doc_id", "n", "set_key")
    classes = plain.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    labelled = classes.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn(
        "component", F.coalesce("component", "set_key")
    )
    named = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = store(labelled.select("set_key", "component").join(named, "component").select("set_key", "component_id"), "named")
    return (
        plain.join(named, "set_key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one_of_each(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept: the one with the smallest id.

    Of several rows with one id any one stays. Rows without an id are judged by their text alone:
    they stay, since nothing can name them as the copy to drop. All columns of ``docs`` are returned.
    """
    found = store(jaccard_components(docs, width=width, percent=percent), "components").filter(F.col("doc_id").isNotNull())
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    again = store(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    kept = attach(docs, gone, ["doc_id"], "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = attach(kept, again, ["doc_id"], "left_anti", stored=True)
    several = attach(kept, again, ["doc_id"], "left_semi", stored=True).dropDuplicates(["doc_id"])
    return once.select(*docs.columns).unionAll(several.select(*docs.columns))

"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Two vectors at the cosine ``c`` lie on the same side of a random hyperplane with probability ``1 - acos(c) / pi``. In
each of L tables a vector's bucket is its signs for b hyperplanes; a pair at the cosine of the threshold meets in at
least one table with probability ``RECALL``, closer ones oftener. b follows the number of different vectors so that
a bucket of unrelated vectors holds about ``BUCKET`` of them, and L follows b.

Equal vectors are one class and move once. In a bucket the cosines of all its classes are computed in double precision
as a matrix product; a pair counts in the first table where it meets, which both sides tell from their signs, so no
pair is ever written out: a bucket yields, per class, the number of its new links and one edge towards the
smallest member of its component. A bucket of more than ``BLOCK`` classes is cut into blocks, and its pairs of blocks are
spread over as many tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociary.llm.common import column_of, ship, slices, store
from lociary.llm.components import connected_components

THRESHOLD = 0.95
RECALL = 0.999
BUCKET = 8
GROUP = 4096
BLOCK = 1024


def plan_tables(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Number of hyperplanes of a table (1 to 31) and of tables."""
    bits = min(31, max(1, math.ceil(math.log2(max(classes, 2) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def unit(data: bytes, wide: bool) -> np.ndarray:
    vector = np.frombuffer(data, np.float64 if wide else np.float32).astype(np.float64)
    vector = vector / np.max(np.abs(vector))  # so that squares neither overflow nor vanish
    return vector / np.sqrt(vector @ vector)


def planes(dimension: int, count: int) -> np.ndarray:
    """The same hyperplanes for one dimension whenever they are asked for."""
    return np.random.default_rng([71, dimension, count]).standard_normal((dimension, count))


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and key of every usable vector; both null for the others."""
    for batch in slices(batches, 4096):
        data, keys, wides = [], [], []
        column = column_of(batch, "embedding")
        for value in column:
            values = value.values if value.is_valid else None
            fine = values is not None and len(values) > 0 and values.null_count == 0
            if fine:
                vector = values.to_numpy(zero_copy_only=False) + 0.0  # one zero
                fine = bool(np.isfinite(vector).all() and vector.any())
            if fine:
                narrow = vector.astype(np.float32)
                wide = bool((narrow.astype(np.float64) != vector).any())
                data.append((vector.astype(np.float64) if wide else narrow).tobytes())
                keys.append(int.from_bytes(hashlib.blake2b(data[-1], digest_size=8).digest(), "little", signed=True))
                wides.append(wide)
            else:
                for column_out in (data, keys, wides):
                    column_out.append(None)
        yield pa.record_batch(
            [column_of(batch, "vec_id"), pa.array(keys, pa.int64()), pa.array(wides, pa.bool_()), pa.array(data, pa.binary())],
            names=["vec_id", "key", "wide", "data"],
        )


def _signs(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in slices(batches, 1024):
            units = [unit(d, w) for d, w in zip(column_of(batch, "data").to_pylist(), column_of(batch, "wide").to_pylist())]
            signs = np.empty((len(units), tables), np.int32)
            sizes = np.array([len(u) for u in units])
            for dimension in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dimension)
                side = np.array([units[i] for i in own]) @ planes(dimension, bits * tables) >= 0
                signs[own] = (side.reshape(len(own), tables, bits) @ weights).astype(np.int32)
            yield pa.record_batch(
                [*[column_of(batch, c) for c in ("key", "copies", "wide", "data")], pa.array(sizes, pa.int32()), pa.array([s.tobytes() for s in signs], pa.binary()), pa.array(list(signs), pa.list_(pa.int32()))],
                names=["key", "copies", "wide", "data", "dimension", "signs", "buckets"],
            )

    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric matrix of links, by repeated minima over the neighbours."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _pairs_of(first: np.ndarray, second: np.ndarray | None, rows: dict, table: int, threshold: float):
    """Links of one bucket, or of two blocks of one: counts of new links per row and (row, smaller row) edges."""
    counts = {}
    members = first if second is None else np.concatenate([first, second])
    vectors = rows["units"][members]
    split = len(first)
    linked = vectors @ vectors.T >= threshold if second is None else np.zeros((len(members),) * 2, bool)
    if second is not None:
        cross = vectors[:split] @ vectors[split:].T >= threshold
        linked[:split, split:], linked[split:, :split] = cross, cross.T
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(linked)
    if not len(a):
        return counts, []
    label = _labels(linked)
    edges = [(members[i], members[label[i]]) for i in np.flatnonzero(label != np.arange(len(label)))]
    fresh = np.ones(len(a), bool)
    signs = rows["signs"]
    for earlier in range(table):
        own = signs[members, earlier]
        fresh &= own[a] != own[b]
    links = np.bincount(a[fresh], rows["copies"][members[b[fresh]]], len(members)).astype(np.int64)
    return {int(m): int(n) for m, n in zip(members, links) if n}, edges


def _bucket(threshold: float, tables: int):
    def run(group: pa.Table) -> pa.Table:
        keys = column_of(group, "key").to_numpy()
        table = column_of(group, "table")[0].as_py()
        rows = {
            "units": np.array([unit(d, w) for d, w in zip(column_of(group, "data").to_pylist(), column_of(group, "wide").to_pylist())]),
            "copies": column_of(group, "copies").to_numpy(),
            "signs": np.array([np.frombuffer(s, np.int32) for s in column_of(group, "signs").to_pylist()]),
        }
        block = column_of(group, "block").to_numpy(zero_copy_only=False)
        left, right = column_of(group, "left")[0].as_py(), column_of(group, "right")[0].as_py()
        out: dict[tuple[int, int], int] = {}
        if left != right:
            parts = [(np.flatnonzero(block == left), np.flatnonzero(block == right))]
        else:
            order = np.lexsort((keys, rows["signs"][:, table]))
            cut = np.flatnonzero(np.diff(rows["signs"][order, table])) + 1
            parts = [(p, None) for p in np.split(order, cut) if len(p) > 1]
        for first, second in parts:
            if not len(first) or (second is not None and not len(second)):
                continue
            counts, edges = _pairs_of(first, second, rows, table, threshold)
            for row, n in counts.items():
                at = (int(keys[row]), int(keys[row]))
                out[at] = out.get(at, 0) + n
            for row, to in edges:
                out.setdefault((int(keys[row]), int(keys[to])), 0)
        found = list(out)
        return pa.table({
            "key": pa.array([k for k, _ in found], pa.int64()), "to": pa.array([t for _, t in found], pa.int64()),
            "links": pa.array(list(out.values()), pa.int64()),
        })

    return run


def near_links(classes: DataFrame, count: int, threshold: float, recall: float) -> DataFrame:
    """``key, to, links`` per class and bucket: new links of the class, and an edge to another class where to <> key."""
    bits, tables = plan_tables(count, threshold, recall)
    signed = store(classes.select("key", "copies", "wide", "data").mapInArrow(
        _signs(bits, tables), "key long, copies long, wide boolean, data binary, dimension int, signs binary, buckets array<int>"
    ), "signs")
    placed = signed.select("key", "copies", "wide", "data", "signs", "dimension", F.posexplode("buckets").alias("table", "bucket"))
    crowds = placed.groupBy("dimension", "table", "bucket").agg(F.count(F.lit(1)).alias("n"))
    crowded = store(crowds.filter(F.col("n") > BLOCK).select("dimension", "table", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowds")
    sized = placed.join(crowded, ["dimension", "table", "bucket"], "left")
    # buckets that lie next to each other share a task; a crowded one has one task for every two of its blocks
    together = max(1, GROUP // BUCKET)
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("left"), F.greatest(i, F.col("block")).alias("right")))
    alone = F.array(F.struct(F.lit(-1).alias("left"), F.lit(-1).alias("right")))
    sized = sized.withColumn("block", F.coalesce(block, F.lit(-1)))
    spread = sized.withColumn("meet", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meets)))
    spread = spread.select(
        "key", "copies", "wide", "data", "signs", "dimension", "table", "block", F.col("meet.left").alias("left"), F.col("meet.right").alias("right"),
        F.when(F.col("blocks").isNull(), F.floor(F.col("bucket") / together)).otherwise(-1 - F.col("bucket").cast("long")).alias("range"),
    )
    return spread.groupBy("dimension", "table", "range", "left", "right").applyInArrow(_bucket(threshold, tables), "key long, to long, links long")


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding)``; other columns are ignored.

    ``n_links`` counts the other rows at a cosine of at least the threshold, copies included; vectors of different
    length never link. Null, empty and zero vectors and vectors with a null or non-finite component link with nothing
    and are their own component. ``component_id`` is the smallest id reachable, ``kept`` is true for the row whose own id it
    is. A null id never names a component and is never kept. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    typed = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = store(typed.mapInArrow(_classify, "vec_id long, key long, wide boolean, data binary"), "vectors")
    classes = store(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("wide").alias("wide"), F.first("data").alias("data")
    ), "classes")
    found = store(near_links(classes, classes.count(), threshold, recall), "bucket-links")
    labels = connected_components(found.filter("key <> to").select(F.col("key").alias("u"), F.col("to").alias("v")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    labelled = classes.select("key", "copies", "first_id").join(labels.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    labelled = store(labelled.select(
        "key", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")
    ), "labelled")
    named = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = store(labelled.join(named, "component").select("key", "n_links", "component_id"), "named")
    out = rows.select("vec_id", "key").join(per_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )

"""Keyed joins that stay balanced when one key owns a large part of the rows.

``attach`` is the join every plan uses to bring a per-key table back onto rows. The per-key side is
measured first: if its real size is under the bound it is broadcast and the rows do not move at all.
Otherwise both sides are shuffled, and only the keys that would overfill a partition are split.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

BROADCAST_BYTES_CONF = "spark.lociary.broadcastMaxBytes"
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SAMPLE_CONF = "spark.lociary.hotKeySample"
DEFAULT_HOT_SAMPLE = 0.01


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which all executors must share.

    Only a session whose master is ``local`` may leave it unset: driver and executors are then one
    process, and the tables go below the system's temporary folder. Elsewhere an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="lociary-")
        atexit.register(shutil.rmtree, _local_folders[application], ignore_errors=True)
    return _local_folders[application]


_written: dict[str, list[str]] = {}


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, remembered for :func:`discard_stored`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_stored(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has stored so far; their number.

    For the end of an application, or between steps whose results are written elsewhere: DataFrames that still read
    such a table fail afterwards. Works on any file system that Spark can write.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    configuration = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    return len(paths)


def _size_columns(df: DataFrame) -> list[Column]:
    """Row count and true length of the text columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    lengths = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("bigint") for c in texts], F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(lengths), F.lit(0)).alias("text")]


def _bytes(df: DataFrame, rows: int, text: int) -> int:
    fixed = sum(8 for f in df.schema.fields if not isinstance(f.dataType, T.StringType))
    return rows * (fixed + 16) + text


def settle(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder, so later uses neither repeat nor change it."""
    return _settle_measured(df)[0]


def _settle_measured(df: DataFrame) -> tuple[DataFrame, int]:
    """The stored table and its size, both from the one job that writes it."""
    spark = df.sparkSession
    path = new_table_path(spark, "settled")
    seen = Observation()
    df.observe(seen, *_size_columns(df)).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored, _bytes(df, seen.get["rows"], seen.get["text"])


def measured_bytes(df: DataFrame, bound: int | None = None) -> int:
    """Size of a stored table. With a bound, the text is read only if the row count alone is within it."""
    if bound is not None:
        by_rows = _bytes(df, df.count(), 0)  # answered from file footers for a stored table
        if by_rows > bound:
            return by_rows
    row = df.agg(*_size_columns(df)).first()
    return _bytes(df, row["rows"], row["text"])


def broadcast_bound(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(DEFAULT_BROADCAST_BYTES)))


def hot_keys(rows: DataFrame, keys: list[str], partitions: int, nulls_match: bool = False) -> DataFrame:
    """Keys holding more than one fair partition of the rows, with the number of slices each needs.

    Counted on a sample of the key columns: a miss costs balance, never a result. At most ``partitions``
    keys can exceed ``total / partitions``, and their slices add up to at most ``2 * partitions``, so the
    table is bounded whatever the data looks like.
    """
    fraction = float(rows.sparkSession.conf.get(HOT_SAMPLE_CONF, str(DEFAULT_HOT_SAMPLE)))
    keyed = rows.select(*keys) if nulls_match else rows.select(*keys).dropna()
    sampled = keyed if fraction >= 1 else keyed.sample(fraction, seed=7)
    counts = settle(sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    slices = F.least(F.lit(partitions), F.ceil(F.col("__n") * partitions / F.lit(max(total, 1)))).cast("int")
    return settle(counts.filter(F.col("__n") * partitions > total).select(*keys, slices.alias("__slices")))


def shuffle_partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str, residual=None, nulls_match: bool = False, like: DataFrame | None = None
) -> DataFrame:
    """Shuffle join in which the hot keys of ``rows`` are cut into slices and their table rows repeated.

    Without hot keys it is a plain join by the keys, which later steps by the same keys need not shuffle again. Keys of NULL that
    match nothing but stay are spread if there are many. ``like`` has keys distributed as those of ``rows``, for rows that
    come from joins: the hot keys are counted there, so that these joins do not run twice.
    """
    partitions = shuffle_partitions(rows)
    stay = not nulls_match and how not in ("inner", "left_semi")
    found = hot_keys(rows if like is None else like, keys, partitions, nulls_match or stay)
    if found.isEmpty():
        return _join(rows, table, keys, how, residual, nulls_match)
    hot = F.broadcast(found)
    # the task number keeps exact copies of a row apart; both parts repeat identically on a retry
    spread = F.xxhash64(*[F.col(c) for c in rows.columns]) + F.spark_partition_id()
    any_null = F.lit(False) if nulls_match else reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    left = (
        _join(rows, hot, keys, "left", None, nulls_match)
        .withColumn(
            "__salt",
            F.when(any_null, F.pmod(spread, F.lit(partitions)))  # matches nothing, so spread it freely
            .when(F.col("__slices").isNull(), F.lit(0))
            .otherwise(F.pmod(spread, F.col("__slices"))),
        )
        .drop("__slices")
    )
    right = (
        _join(table, hot, keys, "left", None, nulls_match)
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__slices"), F.lit(1)) - 1)))
        .withColumn("__salt", F.col("__salt").cast("bigint"))
        .drop("__slices")
    )
    return _join(left, right, keys + ["__salt"], how, residual, nulls_match).drop("__salt")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str, residual, nulls_match: bool = False) -> DataFrame:
    if residual is None and not nulls_match:
        return left.join(right, keys, how)
    l, r = left.alias("l"), right.alias("r")
    equal = (lambda k: F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))) if nulls_match else (lambda k: F.col(f"l.{k}") == F.col(f"r.{k}"))
    condition = reduce(lambda a, b: a & b, [equal(k) for k in keys])
    if residual is not None:
        condition = condition & residual
    joined = l.join(r, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *extra)


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    *,
    stored: bool = False,
    residual=None,
    nulls_match: bool = False,
    like: DataFrame | None = None,
) -> DataFrame:
    """Join ``table`` onto ``rows`` by ``keys`` (inner, left, left_semi or left_anti).

    ``stored`` says the table is already a file or a settled result, so measuring it repeats no work.
    ``residual`` is a further condition over columns named ``l.x`` and ``r.y``. ``nulls_match`` makes a NULL
    key a key like any other, as in a grouping. ``like``: see :func:`salted_join`.
    """
    bound = broadcast_bound(rows.sparkSession)
    if stored:
        size = measured_bytes(table, bound)
    else:
        table, size = _settle_measured(table)
    if bound > 0 and size <= bound:
        return _join(rows, F.broadcast(table), keys, how, residual, nulls_match)
    return salted_join(rows, table, keys, how, residual, nulls_match, like)


HASH_WORD_BYTES = 32  # of one 64-bit word in a broadcast hash table


def with_possible_partner(rows: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: false where no row of ``table`` has the same keys, true wherever one has, and for some others.

    The hashes of the table's keys are kept as bits of as many words as half the broadcast bound holds, whatever the size of the
    table, and broadcast: rows without a partner are known without being moved. The keys must have the same types on both sides.
    """
    words = max(1024, broadcast_bound(rows.sparkSession) // (2 * HASH_WORD_BYTES))
    place = F.pmod(F.xxhash64(*keys), F.lit(64 * words))
    word, bit = F.floor(place / 64), F.expr("shiftleft(1L, CAST(__place % 64 AS INT))")
    own = table.select(*keys).dropna().select(place.alias("__place"))
    bits = own.groupBy(F.floor(F.col("__place") / 64).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    marked = rows.withColumn("__place", place).withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    return marked.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns, name)


def near_partners(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with a partner in a stored table, and beyond the broadcast bound a few others: for a join that decides."""
    bound = broadcast_bound(rows.sparkSession)
    if 0 < bound and measured_bytes(table, bound) <= bound:
        return _join(rows, F.broadcast(table), keys, "left_semi", None)
    return with_possible_partner(rows, table, keys, "__maybe").filter("__maybe").drop("__maybe")


HASH_WORDS = 16  # 64-bit words in one row of a broadcast hash table
HASH_ROW_BYTES = 8 + 8 * HASH_WORDS + 40  # with the header of the array
FLOOR_BYTES = 32  # of one row of a broadcast table of least values


def _hash_place(rows: DataFrame, keys: list[str]) -> tuple[Column, Column, Column]:
    """Row, word and bit of a row's keys in a hash table of half the broadcast bound."""
    size = 64 * HASH_WORDS
    place = F.pmod(F.xxhash64(*keys), F.lit(size * max(64, broadcast_bound(rows.sparkSession) // (2 * HASH_ROW_BYTES))))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    return F.floor(place / size), F.floor(place % size / 64).cast("int"), bit


def _hash_bits(table: DataFrame, keys: list[str]) -> DataFrame:
    row, word, bit = _hash_place(table, keys)
    words = [F.bit_or(F.when(F.col("__word") == i, F.col("__bit"))) for i in range(HASH_WORDS)]
    placed = table.select(*keys).dropna().select(row.alias("__row"), word.alias("__word"), bit.alias("__bit"))
    return placed.groupBy("__row").agg(F.array(*words).alias("__bits"))


def _has_bit(word: Column, bit: Column) -> Column:
    return F.coalesce(F.get(F.col("__bits"), word).bitwiseAND(bit) != 0, F.lit(False))


def near_keys(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`near_partners` for rows not stored yet, by a hash table of half the broadcast bound: a few others pass as well.

    It is a broadcast semi-join, which Spark moves below a grouping by the keys: what has no partner is not grouped either.
    """
    bound = broadcast_bound(rows.sparkSession)
    table = table.select(*keys)
    if 0 < bound and measured_bytes(table, bound) <= bound:
        return _join(rows, F.broadcast(table), keys, "left_semi", None)
    row, word, bit = _hash_place(rows, keys)
    bits = F.broadcast(_hash_bits(table, keys))
    return rows.join(bits, (row == F.col("__row")) & _has_bit(word, bit), "left_semi")


def above_floor(rows: DataFrame, table: DataFrame, keys: list[str], value: Column, floor: Column) -> DataFrame:
    """The rows whose ``value`` reaches the ``floor`` of their keys in a stored table, and beyond the broadcast bound a few others.

    Beyond the bound the least floor of all keys of one hash is broadcast, for as many hashes as the bound holds. NULL is a
    key like any other; where value or floor is NULL the row is left out. For a comparison that a later join repeats.
    """
    bound = broadcast_bound(rows.sparkSession)
    hashes = F.lit(max(1024, bound // FLOOR_BYTES))
    place = F.pmod(F.xxhash64(*keys), hashes)
    floors = table.select(*keys, floor.alias("__floor"))
    if 0 < bound and measured_bytes(floors, bound) <= bound:
        exact = _join(rows.withColumn("__value", value), F.broadcast(floors), keys, "inner", None, nulls_match=True)
        return exact.filter(F.col("__value") >= F.col("__floor")).select(*rows.columns)
    least = floors.groupBy(place.alias("__place")).agg(F.min("__floor").alias("__floor"))
    marked = rows.withColumns({"__place": place, "__value": value}).join(F.broadcast(least), "__place")
    return marked.filter(F.col("__value") >= F.col("__floor")).select(*rows.columns)


def attach_few(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`attach` (left) of a stored table that few rows meet: beyond the bound only rows that may have a partner are
    shuffled."""
    bound = broadcast_bound(rows.sparkSession)
    if 0 < bound and measured_bytes(table, bound) <= bound:
        return _join(rows, F.broadcast(table), keys, "left", None)
    marked = with_possible_partner(rows, table, keys, "__maybe")
    met = salted_join(marked.filter("__maybe").drop("__maybe"), table, keys, "left")
    return met.unionByName(marked.filter("NOT __maybe").drop("__maybe"), allowMissingColumns=True)


def complete_few(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with a stored table that few rows meet: beyond the bound only rows that may have a partner are shuffled,
    once, and the rows are read twice."""
    bound = broadcast_bound(rows.sparkSession)
    if 0 < bound and measured_bytes(table, bound) <= bound:
        met, rest = _join(rows, F.broadcast(table), keys, "left", None), None
        near = _join(rows.select(*keys), F.broadcast(table.select(*keys)), keys, "left_semi", None)
    else:
        marked = with_possible_partner(rows, table, keys, "__maybe")
        near, rest = marked.filter("__maybe").drop("__maybe"), marked.filter("NOT __maybe").drop("__maybe")
        if hot_keys(rows, keys, shuffle_partitions(rows), nulls_match=True).isEmpty():
            return near.join(table, keys, "full_outer").unionByName(rest, allowMissingColumns=True)
        met = salted_join(near, table, keys, "left")
    alone = table.join(near.select(*keys).distinct(), keys, "left_anti")
    both = met.unionByName(alone, allowMissingColumns=True)
    return both if rest is None else both.unionByName(rest, allowMissingColumns=True)

"""Readers. Every reader takes a path, a glob or a list of them and plans one scan; none loops over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lociary.functions.text import file_name
from lociary.operators.keyed import attach
from lociary.sources.blockgzip import first_line, read_block_gzip


def read_tsv(
    spark: SparkSession,
    paths: str | list[str],
    schema: str,
    *,
    header: bool = True,
    source: str | None = None,
    null_value: str | None = "NA",
    block_gzip: bool | None = None,
) -> DataFrame:
    """Tab-separated text by explicit schema; ``source`` keeps the file path as a column.

    In a file with a header the columns are found by name, in any order; a missing one is an error, and so is
    a further file whose header differs. Without a header they are matched by position. Pass ``null_value=None`` for files in which the text "NA" is a
    value (locus classes).

    Block-gzipped files are read by ranges of blocks, so a large one by many tasks: those named ``.bgz``, and others with
    ``block_gzip=True``. Spark unpacks the other kinds by extension; a plain ``.gz`` cannot be split.
    """
    if block_gzip is None:
        block_gzip = all(p.endswith(".bgz") for p in ([paths] if isinstance(paths, str) else paths))
    if block_gzip:
        return _block_gzip_tsv(spark, paths, schema, header, source, null_value)
    options = {"sep": "\t", "header": str(header).lower(), "enforceSchema": str(not header).lower()}
    if null_value is not None:
        options["nullValue"] = null_value
    if header:
        found = spark.read.options(**options).csv(paths)
        wanted = T.StructType.fromDDL(schema)
        missing = [f.name for f in wanted if f.name not in found.columns]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {paths}")
        df = found.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted], *(["_metadata"] if source else []))
        return df.withColumn(source, F.col("_metadata.file_path")).drop("_metadata") if source else df
    df = spark.read.options(**options).schema(schema).csv(paths)
    return df.withColumn(source, F.col("_metadata.file_path")) if source else df


def _block_gzip_tsv(spark: SparkSession, paths, schema: str, header: bool, source: str | None, null_value: str | None) -> DataFrame:
    wanted, lines = T.StructType.fromDDL(schema), read_block_gzip(spark, paths)
    names = [f.name for f in wanted]
    if header:
        head = first_line(spark, paths)
        names = head.split("\t")
        missing = [f.name for f in wanted if f.name not in names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {paths}")
        other = F.raise_error(F.concat(F.lit("another header in "), F.col("file")))
        lines = lines.filter(F.when(~F.col("first"), True).when(F.col("line") == head, False).otherwise(other))
    options = {"sep": "\t"} | ({} if null_value is None else {"nullValue": null_value})
    # text as it stands, then the same casts as for other files; lines of blanks are no rows there either
    texts = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))]).toDDL()
    rows = lines.filter(F.col("line").rlike(r"[^\x00-\x20]")).select("file", F.from_csv("line", texts, options).alias("r"))
    columns = [F.col(f"r.c{names.index(f.name)}").try_cast(f.dataType).alias(f.name) for f in wanted]
    return rows.select(*columns, *([F.col("file").alias(source)] if source else []))


def read_tsv_columns(spark: SparkSession, paths: str | list[str], columns: dict[str, str], sep: str = "\t") -> DataFrame:
    """Some columns of a headed file, renamed and typed: ``{name in file: "new_name type"}``."""
    raw = spark.read.options(sep=sep, header="true", nullValue="NA").csv(paths)
    typed = {old: spec.split(" ", 1) for old, spec in columns.items()}
    return raw.select(*[F.col(f"`{old}`").try_cast(kind).alias(new) for old, (new, kind) in typed.items()])


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Interval files as ``file, contig, start, end`` (0-based half-open), the file named by its stem."""
    df = read_tsv(spark, paths, "contig string, start bigint, end bigint", header=False, source="__path")
    stem = F.regexp_replace(file_name(F.col("__path")), "\\.bed(\\.gz)?$", "")
    return df.select(stem.alias("file"), "contig", "start", "end")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_tsv_layouts(
    spark: SparkSession, paths: str | list[str], schema: str, *, required: list[str] | None = None, source: str | None = None, null_value: str = "NA"
) -> DataFrame:
    """Headed, unquoted tab-separated files of several layouts as one table: columns are found by name in each file's own header.

    A column a file lacks is NULL, of its type; one of ``required`` that it lacks is an error. Cells that are empty or
    ``null_value`` are NULL. Lines of blanks are no rows. Two scans, one of which keeps a header a file.
    """
    wanted = T.StructType.fromDDL(schema)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), "value")
    lines = lines.withColumn("__row", F.monotonically_increasing_id())
    heads = lines.filter("__start = 0").groupBy("__file").agg(F.min(F.struct("__row", "value"))["value"].alias("__head"))
    heads = heads.withColumn("__names", F.split("__head", "\t"))
    for name in required or []:
        told = F.concat(F.lit(f"no column {name} in "), F.col("__file"))
        heads = heads.withColumn("__names", F.when(F.array_contains("__names", name), F.col("__names")).otherwise(F.raise_error(told)))
    rows = attach(lines.filter(F.col("value").rlike(r"[^\x00-\x20]")), heads, ["__file"], "inner")
    # a header is the first line of its file; a data line with the same text is none
    first = rows.filter((F.col("__start") > 0) | (F.col("value") != F.col("__head")))
    cells = first.select("__file", "__names", F.split("value", "\t").alias("__cells"))

    def cell(name: str) -> Column:
        at = F.array_position("__names", F.lit(name)).cast("int")
        text = F.when(at > 0, F.get("__cells", at - 1))
        return F.when((text != "") & (text != null_value), text)

    columns = [cell(f.name).try_cast(f.dataType).alias(f.name) for f in wanted]
    return cells.select(*columns, *([F.col("__file").alias(source)] if source else []))


def region_index(spark: SparkSession, path: str) -> DataFrame:
    """``file, trait, contig, first, last, n``: what each file of a table written by
    :func:`lociary.sources.writers.write_by_locus` holds; a small table to be stored beside it."""
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("file"), "trait", "contig").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n")
    )


def read_positions(spark: SparkSession, path: str, index: DataFrame, trait: str, contig: str, first: int, last: int) -> DataFrame:
    """The rows of one stretch of the genome (both ends included): the index says which files can hold any, and only those are planned."""
    hit = index.filter((F.col("trait") == trait) & (F.col("contig") == contig) & (F.col("first") <= last) & (F.col("last") >= first))
    files = [r["file"] for r in hit.select("file").distinct().collect()]
    rows = spark.read.option("basePath", path).parquet(*files) if files else spark.read.parquet(path).limit(0)
    return rows.filter((F.col("trait") == trait) & (F.col("contig") == contig) & F.col("position").between(first, last))


def read_grid(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """A table written by :func:`lociary.sources.writers.write_grid`; ``keys`` is the DDL of its key columns, which stand last."""
    rows = spark.read.parquet(path)
    typed = {f.name: f.dataType for f in T.StructType.fromDDL(keys)}
    return rows.select(*[F.col(c).cast(typed[c]).alias(c) if c in typed else F.col(c) for c in rows.columns])


def read_sorted(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """A Parquet table written by :func:`lociary.sources.writers.write_sorted` with each row's place in the order, from 0.

    The order of the files is that of their part numbers, and of the file numbers within one task's parts.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    number = lambda pattern: F.regexp_extract("__file", pattern, 1).cast("bigint")
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\.")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    starts = files.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    return attach(rows, starts, ["__file"], "inner").withColumn(place, F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def read_region(spark: SparkSession, path: str, trait: str, region: str) -> DataFrame:
    """One locus out of a table written by :func:`lociary.sources.writers.write_by_locus`: the trait
    prunes directories, the region is pushed to the row-group statistics."""
    return spark.read.parquet(path).filter((F.col("trait") == trait) & (F.col("region") == region))


def read_sites(spark: SparkSession, build: str, path_of: dict[str, str]) -> DataFrame:
    """Site table of a genome build."""
    if build not in path_of:
        raise ValueError(f"unknown genome build {build!r}")
    return spark.read.parquet(path_of[build])

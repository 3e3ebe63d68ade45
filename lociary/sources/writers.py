"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociary.sources.blockgzip import write_block_gzip
from lociary.sources.readers import read_json, read_table


def write_tsv(
    df: DataFrame, path: str, *, compress: bool = True, block_gzip: bool = False, null_value: str = "NA", overwrite: bool = False
) -> None:
    """Tab-separated export, unquoted, with a literal for missing values. Columns must be atomic.

    With ``block_gzip`` the files are made of blocks, so that each can be read by many tasks.
    """
    if block_gzip:
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_value)) for c in df.columns]
        write_block_gzip(df.select(F.concat_ws("\t", *cells)), path, header="\t".join(df.columns), overwrite=overwrite)
        return
    (
        df.write.mode("overwrite" if overwrite else "error")
        .options(sep="\t", header="true", nullValue=null_value, emptyValue="", quote="\u0000")
        .csv(path, compression="gzip" if compress else "none")
    )


def write_table(df: DataFrame, path: str, *, overwrite: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """Durable table; returns it read back, so what follows starts from the file."""
    writer = df.write.mode("overwrite" if overwrite else "error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return read_table(df.sparkSession, path)


def write_by_locus(df: DataFrame, path: str, *, overwrite: bool = False) -> DataFrame:
    """Variants in one directory per trait, range-clustered by region and position inside it, so that one
    region is read from few row groups. The range split also cuts a region too large for one file."""
    clustered = df.repartitionByRange("trait", "region", "position").sortWithinPartitions("trait", "region", "position")
    return write_table(clustered, path, overwrite=overwrite, partition_by=["trait"])


def write_grid(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per combination of ``keys``, all in one job; only the combinations in ``df`` are written anew.

    Rows are rebalanced by the keys, so that a folder has few files and a large combination is cut over several tasks.
    """
    rows = df.hint("rebalance", *keys)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_sorted(df: DataFrame, path: str, order: list[Column | str], *, text: bool = False, overwrite: bool = False) -> None:
    """Export in one order over all files: each holds a range, in order, and so do the files by their part number.

    Rows equal in ``order`` follow the remaining columns, so the export is the same on every run but for identical rows.
    """
    named = [c for c in order if isinstance(c, str)]
    rows = df.orderBy(*order, *[F.col(f"`{c}`") for c in df.columns if c not in named])
    if text:
        write_tsv(rows, path, overwrite=overwrite)
    else:
        rows.write.mode("overwrite" if overwrite else "error").parquet(path)


def ingest(
    spark: SparkSession, sources: dict[str, tuple[str, str]], target: str, *, partitions: int | None = None, overwrite: bool = False
) -> dict[str, DataFrame]:
    """Datasets ``name -> (format, path)``, format "json" or "parquet", each stored under ``target``."""
    readers = {"json": read_json, "parquet": read_table}
    out = {}
    for name, (kind, path) in sources.items():
        df = readers[kind](spark, path)
        df = df.repartition(partitions) if partitions else df
        out[name] = write_table(df, f"{target.rstrip('/')}/{name}", overwrite=overwrite)
    return out


def write_json(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "error").json(path)

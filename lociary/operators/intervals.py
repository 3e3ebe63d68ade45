"""Joins of positions with intervals: equal keys plus a coarse bin, then the exact range test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociary.operators.keyed import attach, settle
from lociary.operators.ordered import running_totals


def explode_bins(intervals: DataFrame, start: str, end: str, width: int | Column) -> DataFrame:
    """One row per bin a half-open interval touches; a genome has at most length / width bins."""
    first = F.floor(F.col(start) / width)
    last = F.floor((F.col(end) - 1) / width)
    return intervals.withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))


LEVEL = 4  # ratio of the widths of two levels of bins


def _level_width(width: int) -> Column:
    return width * F.pow(F.lit(float(LEVEL)), F.col("__level"))


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: list[str], width: int = 1_000_000
) -> DataFrame:
    """Inner join: start <= position < end, for every interval with equal ``keys``.

    Points carry ``position``; intervals carry ``start`` and ``end`` (end excluded). An interval wider than ``width`` is
    listed by the narrowest bins, ``width`` times a power of ``LEVEL``, that are as wide as it: in two of them at most. A
    point is listed once per width in use, so neither side grows with the length of the intervals.
    """
    wide = F.log(float(LEVEL), (F.col("end") - F.col("start")) / width)
    levelled = intervals.withColumn("__level", F.greatest(F.lit(0), F.ceil(wide)).cast("int"))
    binned = settle(explode_bins(levelled, "start", "end", _level_width(width)))
    levels = sorted(r["__level"] for r in binned.select("__level").distinct().collect())  # about thirty at most
    rows = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels or [0]])))
    rows = rows.withColumn("__bin", F.floor(F.col("position") / _level_width(width)))
    inside = (F.col("r.start") <= F.col("l.position")) & (F.col("l.position") < F.col("r.end"))
    return attach(rows, binned, [*keys, "__level", "__bin"], "inner", stored=True, residual=inside).drop("__bin", "__level")


def coverage_segments(intervals: DataFrame, files: list[str]) -> DataFrame:
    """Disjoint half-open segments per contig with one 0/1 column per file: is it covered there?

    Coverage changes are summed per position first, so many equal or nested intervals cost one row; a
    running sum over all changes of a contig then gives each file's depth between two change points.
    """
    edges = F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).cast("bigint").alias("change")),
        F.struct(F.col("end").alias("at"), F.lit(-1).cast("bigint").alias("change")),
    )
    changes = (
        intervals.filter(F.col("end") > F.col("start"))
        .select("contig", "file", F.explode(edges).alias("e"))
        .groupBy("contig", F.col("e.at").alias("at"))
        .agg(
            F.lit(1).cast("bigint").alias("one"),
            *[F.sum(F.when(F.col("file") == f, F.col("e.change")).otherwise(0)).alias(f"d_{f}") for f in files],
        )
    )
    depth = settle(
        running_totals(changes, ["contig"], [F.col("at")], {"nth": "one", **{f"depth_{f}": f"d_{f}" for f in files}})
    )
    following = depth.select("contig", (F.col("nth") - 1).alias("nth"), F.col("at").alias("end"))
    covered = [(F.col(f"depth_{f}") > 0).cast("int").alias(f) for f in files]
    segments = depth.join(following, ["contig", "nth"]).select("contig", F.col("at").alias("start"), "end", *covered)
    return segments.filter(F.greatest(*[F.col(f) for f in files]) > 0) if len(files) > 1 else segments.filter(F.col(files[0]) > 0)


def interval_flags(points: DataFrame, intervals: DataFrame, files: list[str], width: int = 10_000) -> DataFrame:
    """One 0/1 column per interval file: does ``start < position <= end`` hold for any of its rows?

    Intervals carry ``file, contig, start, end`` (0-based half-open), points ``contig, position`` (1-based).
    All files are cut into one list of disjoint segments first: a point meets at most one, so a single
    join multiplies nothing, and its bins number at most genome / width plus the segment count.
    """
    binned = explode_bins(coverage_segments(intervals, files), "start", "end", width)
    rows = points.withColumn("__bin", F.floor((F.col("position") - 1) / width))
    inside = (F.col("r.start") < F.col("l.position")) & (F.col("l.position") <= F.col("r.end"))
    hits = attach(rows, binned, ["contig", "__bin"], "left", residual=inside)
    return hits.withColumns({f: F.coalesce(f, F.lit(0)) for f in files}).drop("start", "end", "__bin")

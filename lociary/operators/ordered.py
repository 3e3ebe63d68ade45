"""Ranks and running totals over orders too large for one task.

A window over a whole group would pull the group into a single task. Instead the rows are range-sorted
across all tasks, numbered in place, and each (group, sorted block) receives the totals of the blocks
before it. The block table has at most one row per group plus one per sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociary.operators.keyed import attach, settle


def _sorted_blocks(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    # monotonically_increasing_id = task number in the upper 31 bits, row number within the task below
    numbered = df.orderBy(*[F.col(g) for g in group], *order).withColumn("__pos", F.monotonically_increasing_id())
    return settle(numbered).withColumn("__block", F.shiftright("__pos", 33))


def _before(group: list[str]):
    return Window.partitionBy(*(group or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """0-based position of every row in its group under a total order."""
    rows = _sorted_blocks(df, group, order)
    blocks = rows.groupBy(*group, "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first")
    )
    blocks = blocks.withColumn("__offset", F.coalesce(F.sum("__n").over(_before(group)), F.lit(0))).drop("__n")
    return (
        attach(rows, blocks, group + ["__block"], "inner", nulls_match=True)
        .withColumn(name, F.col("__offset") + F.col("__pos") - F.col("__first"))
        .drop("__offset", "__first", "__pos", "__block")
    )


def running_totals(df: DataFrame, group: list[str], order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Add inclusive running sums; ``totals`` maps new column -> summed column (which must not be null)."""
    rows = _sorted_blocks(df, group, order)
    blocks = rows.groupBy(*group, "__block").agg(*[F.sum(v).alias(f"__{k}") for k, v in totals.items()])
    for k in totals:
        blocks = blocks.withColumn(f"__{k}_before", F.coalesce(F.sum(f"__{k}").over(_before(group)), F.lit(0)))
    blocks = blocks.drop(*[f"__{k}" for k in totals])
    within = Window.partitionBy(*group, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    out = attach(rows, blocks, group + ["__block"], "inner", nulls_match=True)
    for k, v in totals.items():
        out = out.withColumn(k, F.col(f"__{k}_before") + F.sum(v).over(within))
    return out.drop("__pos", "__block", *[f"__{k}_before" for k in totals])


def asof_join(rows: DataFrame, table: DataFrame, keys: list[str], on: str, columns: list[str], *, strict: bool = False) -> DataFrame:
    """``rows`` with ``columns`` of the last row of ``table`` that has the same keys and stands at or before them.

    "Before" is by ``on``; with ``strict`` an equal place does not count. Of table rows at one place the one with the
    greatest ``columns`` counts. A row without such a table row, or with a NULL place, gets NULLs; NULL keys are keys.

    Both tables are laid out in one order and each row reads off the last table row before it, so no pair of a row and
    a table row is formed, whatever the keys hold; what crosses sorted blocks is one table row per block and key.
    """
    marked = table.filter(F.col(on).isNotNull()).select(*keys, on, F.lit(2 if strict else 0).alias("__kind"), F.struct(*columns).alias("__last"))
    placed = _sorted_blocks(rows.withColumn("__kind", F.lit(1)).unionByName(marked, allowMissingColumns=True), keys, [F.col(on), F.col("__kind"), F.col("__last")])
    blocks = placed.groupBy(*keys, "__block").agg(F.max(F.when(F.col("__kind") != 1, F.struct("__pos", "__last"))).alias("__end"))
    carried = blocks.select(*keys, "__block", F.last("__end", ignorenulls=True).over(_before(keys))["__last"].alias("__carried"))
    out = attach(placed, carried.filter("__carried IS NOT NULL"), [*keys, "__block"], "left", nulls_match=True)
    inside = Window.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col(on).isNotNull(), F.coalesce(F.last("__last", ignorenulls=True).over(inside), F.col("__carried")))
    out = out.withColumn("__found", found).filter("__kind = 1")
    return out.select(*rows.columns, *[F.col(f"__found.{c}").alias(c) for c in columns])


def level_ranks(df: DataFrame, column: str, first: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> DataFrame:
    """``column, level``: the levels of a column as they occur, ranked from 1: ``first``, the others sorted, then ``last``.

    Pinned levels that do not occur have no rank. NULL is no level.
    """
    def place(levels: tuple[str, ...]) -> Column:
        at = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column)) if levels else F.lit(0)
        return F.when(at > 0, at.cast("int"))

    levels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    block = F.when(place(first).isNotNull(), 0).when(place(last).isNotNull(), 2).otherwise(1)
    ranked = rank_within(levels, [], [block, F.coalesce(place(first), place(last), F.lit(0)), F.col(column)], "level")
    return ranked.select(column, (F.col("level") + 1).cast("bigint").alias("level"))


def top_fractions(
    df: DataFrame, group: list[str], score: str, tie: list[Column], fractions: list[float]
) -> DataFrame:
    """Rows whose ascending position / group size exceeds each fraction, one copy per fraction kept.

    ``score`` lies in [0, 1]. A histogram on a fixed grid (at most 10,001 cells a group) says above
    which cell every wanted row lies, so only that top part is sorted. Adds ``fraction``.
    """
    cell = F.floor(F.col(score) * 10000)
    cells = settle(df.groupBy(*group, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n")))
    above = Window.partitionBy(*group).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        cells.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0)))
        .withColumn("__size", F.sum("__n").over(Window.partitionBy(*group)))
        # rows needed at the lowest fraction: n - floor(f * n), plus one for rounding in the test below
        .filter(F.col("__above") <= F.col("__size") * (1 - min(fractions)) + 1)
        .groupBy(*group)
        .agg(F.min("__cell").alias("__cut"), F.first("__size").alias("__size"))
    )
    top = attach(df, cut, group, "inner", nulls_match=True).filter(cell >= F.col("__cut")).drop("__cut")
    ranked = rank_within(top, group, [F.desc(score), *tie], "__down")
    quantile = (F.col("__size") - F.col("__down")) / F.col("__size")
    kept = F.filter(F.array(*[F.lit(f) for f in fractions]), lambda f: quantile > f)
    return ranked.withColumn("fraction", F.explode(kept)).drop("__down", "__size")


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group by position in a distributed sort, not by gathering
    the values. ``probabilities`` maps output column -> probability; NULL values are left out."""
    key = group or ["__all"]
    values = df.select(*group, value).filter(F.col(value).isNotNull())
    if not group:
        values = values.withColumn("__all", F.lit(0))
    # one row per different value, so neither copies of a value nor most rows take part in the sort
    counted = values.groupBy(*key, value).agg(F.count(F.lit(1)).alias("__copies"))
    ranked = running_totals(counted, key, [F.col(value)], {"__upto": "__copies"})
    sizes = ranked.groupBy(*key).agg(F.max("__upto").alias("__n"))
    rows = attach(ranked, sizes, key, "inner", nulls_match=True)
    at = {name: F.lit(p) * (F.col("__n") - 1) for name, p in probabilities.items()}
    holds = lambda place: (place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__copies"))
    wanted = F.lit(False)
    for position in at.values():
        wanted = wanted | holds(F.floor(position)) | holds(F.ceil(position))
    picked = lambda place: F.max(F.when(holds(place), F.col(value)))
    share = lambda position: F.max(position - F.floor(position))
    out = rows.filter(wanted).groupBy(*key).agg(
        *[
            (picked(F.floor(p)) + (picked(F.ceil(p)) - picked(F.floor(p))) * share(p)).alias(name)
            for name, p in at.items()
        ]
    )
    return out if group else out.drop("__all")

"""2x2 tables: risk ratio with Wald or bootstrap interval and Fisher's exact test.

Every function takes a table with one row per comparison and the columns ``hits1, total1`` (reference
row) and ``hits2, total2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociary.functions.stats import Z_975, log_factorial
from lociary.operators.keyed import attach, settle
from lociary.operators.ordered import asof_join, running_totals

FISHER_BLOCK = 4096
DRAW_BLOCK = 256
ZERO_LOG = 750.0  # exp(-750) is zero in double precision


def risk_ratio_columns() -> dict[str, Column]:
    """Ratio of the hit fractions and its 95 % Wald interval."""
    h1, n1, h2, n2 = [F.col(c).cast("double") for c in ("hits1", "total1", "hits2", "total2")]
    inverse = lambda c: F.try_divide(F.lit(1.0), c)
    rr = F.try_divide(F.try_divide(h2, n2), F.try_divide(h1, n1))
    se = F.sqrt(inverse(h2) - inverse(n2) + inverse(h1) - inverse(n1))
    log_rr = F.ln(rr)
    return {"rr": rr, "rr_lower": F.exp(log_rr - Z_975 * se), "rr_upper": F.exp(log_rr + Z_975 * se)}


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of the md5 of the parts joined by ``|``."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _support(n: Column, p: Column) -> tuple[Column, Column]:
    """First and last k whose binomial probability may differ from zero in double precision.

    Bernstein's inequality bounds the probability at distance t from the mean by exp(-t^2 / (2 (variance + t / 3))), so
    the width grows with the square root of n and what lies outside adds exactly nothing.
    """
    reach = ZERO_LOG / 3 + F.sqrt(ZERO_LOG**2 / 9 + 2 * ZERO_LOG * n * p * (1 - p))
    return F.greatest(F.lit(0), F.floor(n * p - reach)).cast("bigint"), F.least(n, F.ceil(n * p + reach)).cast("bigint")


def _binomial_draws(sides: DataFrame, keys: list[str], uniforms: DataFrame) -> DataFrame:
    """The smallest k whose cumulative probability reaches each draw's ``u``, for any ``n`` and ``p``.

    ``sides (keys, side, n, p)``, ``uniforms (keys, side, b, u)``. Every k of a probability above zero
    (:func:`_support`) is laid out in blocks of ``DRAW_BLOCK`` probabilities, so no array grows with n and the number
    of blocks grows with its square root; a draw reads its block off the sorted sums of the blocks, as the last that
    begins below it, and its place off those inside.
    """
    n, p = F.col("n"), F.col("p")
    first, last = [F.floor(k / DRAW_BLOCK) for k in _support(n, p)]
    blocks = sides.withColumn("block", F.explode(F.sequence(first, last))).repartition(*keys, "side", "block")
    places = F.sequence(F.col("block") * DRAW_BLOCK, F.least(n, (F.col("block") + 1) * DRAW_BLOCK - 1))
    i = F.col("__count")
    pmf = F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.ln(p) + (n - i) * F.ln(1 - p))
    on = keys + ["side"]
    # one row per k, summed and packed again where its block lies
    inside = Window.partitionBy(*on, "block").orderBy("__count").rowsBetween(Window.unboundedPreceding, 0)
    sums_inside = blocks.withColumn("__count", F.explode(places)).withColumn("upto", F.sum(pmf).over(inside))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("__count", "upto"))), lambda x: x["upto"])
    blocks = settle(sums_inside.groupBy(*on, "block").agg(packed.alias("cdf"), F.max("upto").alias("mass")))
    sums = running_totals(blocks.select(*on, "block", "mass"), on, [F.col("block")], {"upto": "mass"})
    totals = blocks.groupBy(*on).agg(F.sum("mass").alias("total"))
    before = F.col("upto") - F.col("mass")
    bounds = attach(sums, totals, on, "inner").select(*on, "block", before.alias("before"), "total", (before / F.col("total")).alias("u"))
    placed = asof_join(uniforms, bounds, on, "u", ["block", "before", "total"], strict=True)
    found = attach(placed, blocks.select(*on, "block", "cdf"), on + ["block"], "inner")
    inside = F.size(F.filter("cdf", lambda c: F.col("before") + c < F.col("u") * F.col("total")))
    x = F.col("block") * DRAW_BLOCK + F.least(inside, F.size("cdf") - 1)
    return found.select(*on, "b", x.cast("double").alias("x"))


def bootstrap_risk_ratio(tables: DataFrame, keys: list[str], replicates: int = 5000, seed: int = 1) -> DataFrame:
    """95 % percentile interval of the risk ratio over parametric bootstrap replicates.

    Every draw inverts the exact binomial distribution, whatever its size. Draws depend only on seed, keys and
    replicate number, so a repeated task repeats them. NULL keys are written as empty text and stay apart from others
    only by the remaining keys.
    """
    known = tables.filter((F.col("total1") > 0) & (F.col("total2") > 0))
    names = [f"__key{i}" for i in range(len(keys))]
    known = known.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, names)], *keys, "hits1", "total1", "hits2", "total2")
    known = settle(known)
    sides = known.select(
        *names,
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("side"), F.col(f"hits{s}").cast("bigint").alias("hits"), F.col(f"total{s}").cast("bigint").alias("n")) for s in "12"
        ])).alias("s"),
    ).select(*names, "s.*").withColumn("p", F.col("hits") / F.col("n"))
    inner = sides.filter("hits > 0 and hits < n")
    replicate = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    uniforms = inner.select(*names, "side", replicate.alias("b")).withColumn("u", _uniform(F.lit(seed), F.col("side"), F.col("b"), *[F.col(n) for n in names]))
    drawn = _binomial_draws(inner, names, uniforms)
    certain = sides.filter("hits = 0 or hits = n").select(*names, "side", replicate.alias("b"), F.col("hits").cast("double").alias("x"))
    shares = drawn.unionByName(certain).join(sides.select(*names, "side", "n"), names + ["side"]).withColumn("share", F.col("x") / F.col("n"))
    ratio = F.try_divide(F.max(F.when(F.col("side") == "2", F.col("share"))), F.max(F.when(F.col("side") == "1", F.col("share"))))
    per_draw = shares.groupBy(*names, "b").agg(ratio.alias("rr"))
    ends = per_draw.groupBy(*names).agg(F.percentile("rr", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    return known.select(*names, *keys).join(ends, names).select(
        *keys, F.get("__q", F.lit(0)).alias("rr_lower"), F.get("__q", F.lit(1)).alias("rr_upper")
    )


def fisher_exact(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided exact p: total probability of the tables no likelier than the observed one.

    The support is spread over rows in blocks, so no single array or task has to hold it.
    """
    col = F.col
    t = tables.select(
        *keys,
        col("hits2").cast("bigint").alias("x"),
        (col("hits1") + col("hits2")).cast("bigint").alias("marked"),
        col("total2").cast("bigint").alias("drawn"),
        (col("total1") + col("total2")).cast("bigint").alias("size"),
    ).withColumns(
        {"lo": F.greatest(F.lit(0), col("drawn") + col("marked") - col("size")), "hi": F.least(col("drawn"), col("marked"))}
    )
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    log_pmf = lambda k: (
        choose(col("marked"), k) + choose(col("size") - col("marked"), col("drawn") - k) - choose(col("size"), col("drawn"))
    )
    block = F.floor(col("lo") / FISHER_BLOCK), F.floor(col("hi") / FISHER_BLOCK)
    support = (
        t.withColumn("__observed", log_pmf(col("x")))
        .withColumn("__block", F.explode(F.sequence(*block)))
        .repartition(*keys, "__block")
        .withColumn(
            "k",
            F.explode(
                F.sequence(
                    F.greatest(col("lo"), col("__block") * FISHER_BLOCK),
                    F.least(col("hi"), col("__block") * FISHER_BLOCK + FISHER_BLOCK - 1),
                )
            ),
        )
        .withColumn("__pmf", log_pmf(col("k")))
    )
    # log-factorials near 1e9 are spaced wider than a fixed tolerance, so it follows their size
    tolerance = F.greatest(F.lit(1e-7), log_factorial(col("size")) * 1e-14)
    counted = F.when(col("__pmf") <= col("__observed") + tolerance, F.exp("__pmf"))
    return support.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(counted)).alias("pvalue"))

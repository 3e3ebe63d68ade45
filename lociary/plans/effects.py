"""Bayes factors against sample size, and per-variant regressions from individual rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociary.functions.stats import critical_sample_size, log10_bayes_factor


def log10_bf(rows: DataFrame) -> DataFrame:
    """``n, beta, prior, residual`` -> ``log10_bf``."""
    return rows.withColumn("log10_bf", log10_bayes_factor(*[F.col(c) for c in ("n", "beta", "prior", "residual")]))


def critical_n(rows: DataFrame) -> DataFrame:
    """``beta, prior, residual`` -> ``critical_n`` and the Bayes factor there."""
    beta, prior, residual = [F.col(c) for c in ("beta", "prior", "residual")]
    return rows.withColumn("critical_n", critical_sample_size(beta, prior, residual)).withColumn(
        "log10_bf_critical",
        F.when(F.col("critical_n") > 0, log10_bayes_factor(F.col("critical_n"), beta, prior, residual)),
    )


def marginal_assoc(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Regression through the origin of y on x per key, from map-side aggregates.

    ``s2`` uses the population variance of the residuals, mean removed. All sums and ``n`` run over the rows that have
    both values; a key without any has n = 0 and NULLs.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cx, cy = F.when(both, F.col(x)), F.when(both, F.col(y))
    sums = rows.groupBy(*keys).agg(
        F.count(cx).alias("n"),
        F.sum(cx * cx).alias("sxx"), F.sum(cx * cy).alias("sxy"),
        # around the means as they run, so large values do not cancel
        F.var_pop(cx).alias("vx"), F.var_pop(cy).alias("vy"), F.covar_pop(cx, cy).alias("cov"),
    )
    b = F.col("beta")
    spread = F.col("vy") - 2 * b * F.col("cov") + b * b * F.col("vx")
    return (
        sums.withColumn("beta", F.try_divide("sxy", "sxx"))
        .withColumn("sigma2", F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0))))
        .withColumn("s2", F.try_divide("sigma2", "sxx"))
        .withColumn("z", F.try_divide(b, F.sqrt("s2")))
        .drop("sxx", "sxy", "vx", "vy", "cov")
    )

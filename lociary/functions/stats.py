"""Closed-form statistics as column expressions. Undefined results are NULL, never NaN or infinity."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# fixed values: analysis thresholds
R2_THRESHOLD = 0.6
OUTLIER_NLOG10P = 4.0
PRIOR_VARIANCE = 0.04
CHI2_GENOME_WIDE = 29.716785  # chi-square (1 df) at p = 5e-8
Z_975 = 1.959963984540054

# fixed values: published rational approximation of the complementary error function
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def binomial_interval(successes: Column, trials: Column) -> tuple[Column, Column]:
    """95 % Wilson interval, with the usual replacement of the lower end at 1 success and of the upper
    end at n - 1; NULL when either count is NULL or there are no trials."""
    x, n = successes.cast("double"), trials.cast("double")
    z2 = Z_975 * Z_975
    p = F.try_divide(x, n)
    middle = p + F.try_divide(F.lit(z2 / 2), n)
    half = Z_975 * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z2 / 4), n), n))
    scale = 1 + F.try_divide(F.lit(z2), n)
    lower = F.when(x == 1, F.try_divide(F.lit(-math.log(0.95)), n)).otherwise((middle - half) / scale)
    upper = F.when(x == n - 1, 1 + F.try_divide(F.lit(math.log(0.95)), n)).otherwise((middle + half) / scale)
    known = x.isNotNull() & (n > 0)
    return F.when(known, lower), F.when(known, upper)


def nlog10p_chi2(chi2: Column) -> Column:
    """-log10 upper tail of chi-square with one degree of freedom, in log space (no underflow).

    Below zero, where rounded correlations beyond +-1 lead, the tail is 1 and the result 0.
    """
    x = F.sqrt(F.greatest(chi2, F.lit(0.0)) / 2)
    x = F.when(chi2.isNotNull(), x)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return (x * x - F.ln(t) - poly) / math.log(10)


def log_bayes_factor(z: Column, se2: Column, prior: float = PRIOR_VARIANCE) -> Column:
    """Natural log of the approximate Bayes factor for association."""
    shrink = prior / (prior + se2)
    return 0.5 * (F.ln(1 - shrink) + shrink * z * z)


def log10_bayes_factor(n: Column, beta: Column, prior: Column, residual: Column) -> Column:
    """log10 Bayes factor from sample size, marginal effect, prior variance and residual variance."""
    s2 = F.try_divide(residual, n)
    total = prior + s2
    log_bf = 0.5 * F.ln(F.try_divide(s2, total)) + 0.5 * F.try_divide(beta * beta * prior, total * s2)
    return log_bf / math.log(10)


def critical_sample_size(beta: Column, prior: Column, residual: Column) -> Column:
    """Sample size at which the Bayes factor stops falling: the larger root of its derivative's
    quadratic, written without division by the squared effect; NULL without a real root."""
    b2 = beta * beta
    a = -b2 * prior * prior / residual
    b = prior * prior - 2 * b2 * prior
    c = prior * residual + b2 * residual * residual - b2 * residual
    disc = b * b - 4 * a * c
    return F.when(disc >= 0, F.try_divide(-b - F.sqrt(disc), 2 * a))


def critical_sample_size_ratio_form(beta: Column, prior: Column, residual: Column) -> Column:
    """The same root from the form divided by the squared effect."""
    inverse = F.try_divide(F.lit(1.0), beta * beta)
    a = prior / residual
    b = 2 - prior * inverse
    c = residual / prior - residual * residual / prior - residual * inverse
    disc = b * b - 4 * a * c
    return F.when(disc >= 0, F.try_divide(-b + F.sqrt(disc), 2 * a))


def lead_consistency(z: Column, r: Column, lead_z: Column) -> Column:
    """Chi-square of a variant's z against what its correlation with the lead predicts; NULL at r = +-1."""
    gap = z - r * lead_z
    return F.try_divide(gap * gap, 1 - r * r)


def lead_consistency_unsigned(chi2: Column, r2: Column, lead_chi2: Column) -> Column:
    """The same statistic from chi-square values and squared correlations alone, without signs: the gap is
    between the absolute z and what the correlation predicts of it. Equal to the signed form where z and the
    correlation with the lead agree in sign, smaller elsewhere; NULL at r2 = 1."""
    gap = F.sqrt(chi2) - F.sqrt(r2 * lead_chi2)
    return F.try_divide(gap * gap, 1 - r2)


def effective_samples(cases: Column, total: Column) -> Column:
    """N phi (1 - phi) with phi the case fraction."""
    phi = _ratio(cases, total)
    return total * phi * (1 - phi)


def significance_stars(p: Column) -> Column:
    """Cut points 0.0001, 0.001, 0.01, 0.05, right-closed."""
    return (
        F.when(p <= 0.0001, "****").when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*")
        .when(p <= 1, "ns")
    )


def log_factorial(n: Column) -> Column:
    """ln n! for whole n >= 0: exact up to 20, Stirling series beyond (error below 1e-12)."""
    x = n.cast("double") + 1
    i2 = 1 / (x * x)
    series = (1 / x) * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))
    stirling = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(stirling)

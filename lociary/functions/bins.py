"""Bin indices. Two closures are in use and must not be mixed up; both keep indices as integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: bin edges of posterior probability and of its rank quantile
PIP_BREAKS = [0.0, 0.01, 0.1, 0.5, 0.9, 1.0]
QUANTILE_BREAKS = [0.0, 1e-4, 5e-4, 1e-3, 5e-3, 0.01]


def left_closed_bin(value: Column, breaks: list[float], include_highest: bool = True) -> Column:
    """[b0,b1) -> 0, [b1,b2) -> 1 ...; below -> -1, above -> len-1; the last bin may include its end."""
    last = len(breaks) - 2
    out = F.when(value < breaks[0], -1)
    for i in range(last):
        out = out.when(value < breaks[i + 1], i)
    top = value <= breaks[-1] if include_highest else value < breaks[-1]
    return out.when(top, last).when(value.isNotNull(), last + 1)


def right_closed_cut(value: Column, breaks: list[float | None]) -> Column:
    """(b0,b1] -> 0, (b1,b2] -> 1 ...; outside -> NULL. None as first or last edge means unbounded."""
    inside = F.lit(True)
    if breaks[0] is not None:
        inside = value > breaks[0]
    out = F.when(~inside, None)
    for i, edge in enumerate(breaks[1:]):
        out = out.when(value.isNotNull() if edge is None else value <= edge, i)
    return out


def uniform_bin(value: Column, start: float, end: float, bins: int, size: float) -> Column:
    """Right-closed equal bins: below start -> -1, start itself -> 0, above end -> ``bins``."""
    return (
        F.when(value < start, -1)
        .when(value == start, 0)
        .when(value > end, bins)
        .otherwise((F.ceil((value - start) / size) - 1).cast("int"))
    )


def threshold_index(value: Column, low: float, step: float, count: int) -> Column:
    """How many of ``low, low + step, ...`` (``count`` of them) lie strictly below the value."""
    guess = F.ceil((value - low) / step).cast("int")
    # the division may round across an edge by one; the comparison with the edge itself decides
    edge = lambda k: F.lit(low) + k * F.lit(step)
    exact = F.when(value <= edge(guess - 1), guess - 1).when(value > edge(guess), guess + 1).otherwise(guess)
    return F.greatest(F.lit(0), F.least(exact, F.lit(count)))


def folded_frequency(freq: Column) -> Column:
    """Minor allele frequency of an allele frequency."""
    return 0.5 - F.abs(0.5 - freq)

"""Parallel arrays, kept as text or as arrays, to rows by position and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from lociary.functions.text import parse_number_array


def arrays_to_rows(df: DataFrame, columns: dict[str, str], place: str) -> DataFrame:
    """One row per position of the arrays ``columns`` (array column -> value column), counted from 0 in ``place``.

    Text such as ``[1.0,null,2]`` is read as an array of doubles. The arrays of a row must have one length (an error
    otherwise); one that is NULL gives NULLs; rows without any element give no row. The other columns are repeated.
    """
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    arrays = {c: parse_number_array(F.col(c)) if c in texts else F.col(c) for c in columns}
    held = df.withColumns({f"__{c}": a for c, a in arrays.items()})
    length = F.greatest(*[F.coalesce(F.size(f"__{c}"), F.lit(0)) for c in columns], F.lit(0))
    fits = reduce(lambda a, b: a & b, [F.col(f"__{c}").isNull() | (F.size(f"__{c}") == length) for c in columns])
    message = F.concat(F.lit(f"arrays of different lengths in {', '.join(columns)}: "), F.concat_ws(", ", *[F.size(f"__{c}").cast("string") for c in columns]))
    zipped = F.when(fits, F.arrays_zip(*[F.coalesce(f"__{c}", F.array_repeat(F.lit(None), length)).alias(c) for c in columns])).otherwise(F.raise_error(message))
    others = [c for c in df.columns if c not in columns]
    rows = held.select(*others, F.posexplode(zipped).alias(place, "__x"))
    names = rows.schema["__x"].dataType.names
    return rows.select(*others, place, *[F.col(f"__x.`{n}`").alias(v) for n, v in zip(names, columns.values())])


def rows_to_arrays(df: DataFrame, keys: list[str], place: str, columns: dict[str, str], length: int, *, as_text: bool = False) -> DataFrame:
    """The inverse: per key one array of ``length`` elements per value column (value column -> array column).

    Positions without a row hold NULL; of several rows at one position the greatest counts; rows whose ``place`` lies
    outside 0 .. length - 1 are an error.
    """
    inside = F.col(place).between(0, length - 1)
    at = F.when(inside, F.col(place)).otherwise(F.raise_error(F.lit(f"{place} outside 0 .. {length - 1}")))
    cells = df.groupBy(*keys, at.alias(place)).agg(*[F.max(v).alias(v) for v in columns])
    element = lambda v, k: F.max(F.when(F.col(place) == k, F.col(v)))
    arrays = {a: F.array(*[element(v, k) for k in range(length)]) for v, a in columns.items()}
    return cells.groupBy(*keys).agg(*[(F.to_json(x) if as_text else x).alias(a) for a, x in arrays.items()])

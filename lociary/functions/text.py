"""Variant, region and label text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def variant_parts(variant: Column, strip_chr: bool = False) -> dict[str, Column]:
    """``contig:position:ref:alt`` as four columns; missing parts are NULL."""
    parts = F.split(variant, ":")
    contig = F.get(parts, F.lit(0))
    return {
        "contig": F.regexp_replace(contig, "^chr", "") if strip_chr else contig,
        "position": F.get(parts, F.lit(1)).try_cast("bigint"),
        "ref": F.get(parts, F.lit(2)),
        "alt": F.get(parts, F.lit(3)),
    }


def variant_text(contig: Column, position: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", contig, position.cast("string"), ref, alt)


def region_parts(region: Column) -> dict[str, Column]:
    """``chrN:start-end`` as contig, start, end. Half-open; a start of 0 means 1."""
    pattern = "^([^:]+):([0-9]+)-([0-9]+)$"
    start = F.regexp_extract(region, pattern, 2).try_cast("bigint")
    return {
        "contig": F.regexp_extract(region, pattern, 1),
        "start": F.greatest(start, F.lit(1)),
        "end": F.regexp_extract(region, pattern, 3).try_cast("bigint"),
    }


def before_first(text: Column, separator: str) -> Column:
    """Everything up to the first separator (short trait name)."""
    return F.substring_index(text, separator, 1)


def token(text: Column, separator: str, index: int) -> Column:
    """0-based token of a literal-separated text; NULL when there are not that many."""
    return F.get(F.split(text, "\\Q" + separator + "\\E"), F.lit(index))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def map_values(value: Column, mapping: dict[str, str], strict: bool = True) -> Column:
    """Dictionary lookup; an unmapped value is an error when ``strict``, else NULL."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, value)
    if not strict:
        return found
    problem = F.raise_error(F.concat(F.lit("no mapping for value "), F.coalesce(value, F.lit("NULL"))))
    return F.when(found.isNull(), problem).otherwise(found)


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    return F.coalesce(map_values(value, mapping, strict=False), value)


def level_rank(value: Column, levels: list[str]) -> Column:
    """1-based position in an ordered list of levels; NULL when it is not one of them."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.when(at > 0, at.cast("int"))


def percent_label(fraction: Column) -> Column:
    return F.concat(F.round(fraction * 100).cast("bigint").cast("string"), F.lit("%"))


def parse_number_array(text: Column) -> Column:
    """``[1.0,null,2e-3]`` written as text, back to an array of doubles."""
    return F.from_json(text, "array<double>")


def excluded_symbolic(variant: Column) -> Column:
    """True for ordinary alleles; False for symbolic ones such as <INS>."""
    return ~variant.contains("<")

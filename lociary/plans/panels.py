"""Which imputation panels carry which variants, over a grid of frequency and quality thresholds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from lociary.functions.bins import folded_frequency
from lociary.functions.text import excluded_symbolic, file_name, token, variant_parts
from lociary.operators.keyed import attach
from lociary.operators.ordered import rank_within

MAF_THRESHOLDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.2]
RSQ_THRESHOLDS = [0.0, 0.2, 0.4, 0.6, 0.8]
SHARED_MAF, SHARED_RSQ = [0.001, 0.005, 0.01, 0.05], [0.2, 0.4, 0.6, 0.8]
BITS = 63


def imputation_info(info: DataFrame, excluded: DataFrame, build_map: DataFrame, population: DataFrame) -> DataFrame:
    """Per-panel rows with labels from the file name, ids in one build, joined to population frequencies.

    ``info``: ``SNP, ALT_Frq, Rsq, filename``; ``excluded``: ``SNP``; ``build_map``: ``original_variant,
    variant``; ``population``: ``contig, position, ref, alt, min_maf, max_maf``.
    """
    name = file_name(F.col("filename"))
    part = lambda i: token(name, "_", i)
    kept = attach(info, excluded, ["SNP"], "left_anti", stored=True).withColumns(
        {
            "ancestry": part(0),
            "array": part(3),
            "imputation": token(part(4), ".", 0),
        }
    )
    mapped = attach(
        kept, build_map.select(F.col("original_variant").alias("SNP"), F.col("variant").alias("__mapped")), ["SNP"], "left", stored=True
    )
    other_build = F.col("imputation") == "TopMed"
    rows = mapped.select(
        F.when(other_build, F.col("__mapped")).otherwise(F.col("SNP")).alias("variant"),
        F.when(other_build, F.col("SNP")).alias("variant_b38"),
        F.col("ALT_Frq").alias("freq"),
        F.col("Rsq").alias("rsq"),
        "ancestry", "array", "imputation",
        F.concat_ws("_", "ancestry", "array", "imputation").alias("label"),
    )
    site = ["contig", "position", "ref", "alt"]
    parsed = rows.filter(excluded_symbolic(F.col("variant"))).withColumns(variant_parts(F.col("variant")))
    return attach(parsed, population, site, "inner", stored=True)


def panel_levels(info: DataFrame) -> DataFrame:
    """Dictionary of panel labels in alphabetical order, numbered from 0 (one label per input file)."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label"))
    return info.select("label").distinct().select("label", (place - 1).alias("level"))


def extend_levels(known: DataFrame, info: DataFrame) -> DataFrame:
    """``label, level``: the dictionary ``known`` with the labels of ``info`` it lacks, numbered on from its largest number.

    Numbers once given stay; new labels follow in alphabetical order, so the result does not depend on the order of rows.
    NULL is no label. ``known`` may be empty. It must not be the table that the result overwrites.
    """
    fresh = info.select("label").filter(F.col("label").isNotNull()).distinct()
    fresh = attach(fresh, known.select("label"), ["label"], "left_anti")
    first = known.agg(F.coalesce(F.max("level") + 1, F.lit(0)).cast("bigint").alias("first")).first()["first"]
    numbered = rank_within(fresh, [], [F.col("label")], "place").select("label", (F.col("place") + first).cast("bigint").alias("level"))
    return known.select("label", F.col("level").cast("bigint").alias("level")).unionByName(numbered)


def panel_collections(
    info: DataFrame,
    mode: str = "",
    maf: list[float] = MAF_THRESHOLDS,
    rsq: list[float] = RSQ_THRESHOLDS,
) -> DataFrame:
    """Number of variants per exact set of panels, for every threshold pair.

    ``mode``: "" (own folded frequency above), "gnomad_min" (population minimum above) or
    "gnomad_max_min" (population maximum above, minimum not). A set is a bit mask over the label
    dictionary, built for the whole grid by one aggregation with fixed-size, map-side combined buffers.
    """
    if mode not in ("", "gnomad_min", "gnomad_max_min"):
        raise ValueError(f"unknown frequency mode {mode!r}")
    names = [r["label"] for r in panel_levels(info).orderBy("level").collect()]
    words = range((len(names) + BITS - 1) // BITS or 1)
    passes = {
        "": lambda t: folded_frequency(F.col("freq")) > t,
        "gnomad_min": lambda t: F.col("min_maf") > t,
        "gnomad_max_min": lambda t: (F.col("max_maf") > t) & (F.col("min_maf") <= t),
    }[mode]
    cells = list(product(maf, rsq))
    rows = info.filter(F.col("variant").isNotNull())
    for w in words:
        own = names[w * BITS : (w + 1) * BITS]
        bits = F.create_map(*[x for i, n in enumerate(own) for x in (F.lit(n), F.lit(1 << i).cast("bigint"))])
        rows = rows.withColumn(f"__bit{w}", F.coalesce(F.try_element_at(bits, F.col("label")), F.lit(0).cast("bigint")))
    masks = rows.groupBy("variant").agg(
        *[
            F.bit_or(F.when(passes(m) & (F.col("rsq") > q), F.col(f"__bit{w}"))).alias(f"c{i}_{w}")
            for i, (m, q) in enumerate(cells)
            for w in words
        ]
    )
    per_cell = F.array(
        *[
            F.struct(F.lit(m).alias("maf"), F.lit(q).alias("rsq"), *[F.col(f"c{i}_{w}").alias(f"w{w}") for w in words])
            for i, (m, q) in enumerate(cells)
        ]
    )
    mask_columns = [f"w{w}" for w in words]
    counted = (
        masks.select(F.explode(per_cell).alias("c"))
        .select("c.*")
        .filter(F.col("w0").isNotNull())
        .groupBy("maf", "rsq", *mask_columns)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    member = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"w{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS))) != 0, F.lit(n))
                for i, n in enumerate(names)
            ]
        )
    )
    return counted.select(F.lit(mode).alias("mode"), "maf", "rsq", member.alias("labels"), "n").withColumn(
        "collection", F.concat_ws(",", "labels")
    )


def panel_top(collections: DataFrame, k: int = 30) -> DataFrame:
    """The k largest sets of each threshold pair with their numbers of ancestries, arrays and panels, and
    their display place (more ancestries first, then more variants)."""
    cell = Window.partitionBy("mode", "maf", "rsq")
    by_size = F.row_number().over(cell.orderBy(F.desc("n"), "collection"))
    top = collections.withColumn("__size_rank", by_size).filter(F.col("__size_rank") <= k)
    part = lambda i: F.size(F.array_distinct(F.transform("labels", lambda x: F.get(F.split(x, "_"), F.lit(i)))))
    counted = top.select(
        "mode", "maf", "rsq", "collection", "n",
        part(0).alias("n_ancestry"), part(1).alias("n_array"), part(2).alias("n_imputation"),
    )
    # at most k rows per threshold pair
    return counted.withColumn("place", F.row_number().over(cell.orderBy(F.desc("n_ancestry"), F.desc("n"), "collection")))


def panel_top_members(collections: DataFrame, k: int = 30) -> DataFrame:
    """Members of the top sets, one row per set and label, with the label's three parts."""
    cell = Window.partitionBy("mode", "maf", "rsq")
    by_size = F.row_number().over(cell.orderBy(F.desc("n"), "collection"))
    top = collections.withColumn("__size_rank", by_size).filter(F.col("__size_rank") <= k)
    return top.select("mode", "maf", "rsq", "collection", F.explode("labels").alias("label")).withColumns(
        {n: token(F.col("label"), "_", i) for i, n in enumerate(("ancestry", "array", "imputation"))}
    )


def panel_shared_fraction(collections: DataFrame, panels: int) -> DataFrame:
    """Share of variants present in every panel, per threshold pair."""
    everywhere = F.size("labels") == panels
    return collections.groupBy("mode", "maf", "rsq").agg(
        F.sum(F.when(everywhere, F.col("n")).otherwise(0)).alias("numer"), F.sum("n").alias("denom")
    ).withColumn("frac", F.try_divide(F.col("numer").cast("double"), "denom"))

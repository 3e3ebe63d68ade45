"""Per-cohort effects and sample sizes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from lociary.functions.stats import effective_samples
from lociary.functions.text import recode
from lociary.operators.keyed import attach

NAME_PATTERN = r"^(.+)_(.+)_(.+)$"  # cohort, ancestry, statistic; the first group is greedy
META_COHORT = "all_inv_var"


def cohort_sizes(sizes: DataFrame) -> DataFrame:
    """Cases, controls and effective size per trait, cohort and ancestry.

    ``sizes``: ``trait, kind ('-' or 'Total'), ancestry, biobank, cases, controls``.
    """
    meta = F.col("kind") == "Total"
    total = F.col("cases") + F.col("controls")
    return sizes.select(
        "trait",
        F.when(meta, "Meta").otherwise(F.col("biobank")).alias("cohort"),
        F.when(meta, "Meta").otherwise(F.upper("ancestry")).alias("ancestry"),
        total.alias("n"),
        F.col("cases").alias("n_case"),
        F.col("controls").alias("n_control"),
        effective_samples(F.col("cases"), total).alias("neff"),
    )


def cohort_z_pairs(effects: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """z of both variants of each pair in every cohort and ancestry.

    ``effects`` is wide: ``variant`` and one ``<cohort>_<ancestry>_beta`` / ``_sebeta`` column pair per
    cohort and ancestry. ``pairs``: ``pair_id, variant1, variant2``. Rows of the pairs are picked before
    the columns are unpivoted. Effects with a ``trait`` are kept apart by it and meet the ``sizes`` of their trait.
    """
    traits = [c for c in ("trait",) if c in effects.columns]
    slots = F.array(
        F.struct(F.lit(1).alias("slot"), F.col("variant1").alias("variant")),
        F.struct(F.lit(2).alias("slot"), F.col("variant2").alias("variant")),
    )
    wanted = pairs.select("pair_id", F.explode(slots).alias("s")).select("pair_id", "s.*")
    columns = [c for c in effects.columns if re.match(NAME_PATTERN, c) and c.endswith(("_beta", "_sebeta"))]
    long = attach(effects.select(*traits, "variant", *columns), wanted, ["variant"], "inner").unpivot(
        [*traits, "pair_id", "slot"], columns, "name", "value"
    )
    part = lambda i: F.regexp_extract("name", NAME_PATTERN, i)
    named = long.select(
        *traits, "pair_id", "slot", "value", part(1).alias("cohort"), part(2).alias("ancestry"), part(3).alias("statistic")
    ).filter(F.col("cohort") != "all")
    renamed = named.withColumn("cohort", recode(F.col("cohort"), {META_COHORT: "Meta"})).withColumn(
        "ancestry", F.when(F.col("cohort") == "Meta", "Meta").otherwise(F.upper("ancestry"))
    )
    value = lambda slot, stat: F.max(F.when((F.col("slot") == slot) & (F.col("statistic") == stat), F.col("value")))
    wide = renamed.groupBy(*traits, "pair_id", "cohort", "ancestry").agg(
        *[value(s, st).alias(f"variant{s}_{st}") for s in (1, 2) for st in ("beta", "sebeta")]
    )
    sized = attach(wide, sizes, [*traits, "cohort", "ancestry"], "left")
    missing = (
        F.when(F.col("variant1_beta").isNull(), "Missing variant1")
        .when(F.col("variant2_beta").isNull(), "Missing variant2")
        .otherwise("Both exist")
    )
    z = lambda s: F.when(F.col(f"variant{s}_beta").isNull(), 0.0).otherwise(
        F.try_divide(f"variant{s}_beta", f"variant{s}_sebeta")
    )
    show = (F.col("missingness") != "Both exist") | (F.col("cohort") == "Meta")
    off_scale = 8.0  # fixed value: where a missing effect is drawn
    return sized.withColumns({"missingness": missing, "variant1_z": z(1), "variant2_z": z(2)}).withColumns(
        {
            "label": F.when(show, F.col("cohort")).otherwise(""),
            "variant1_beta": F.coalesce("variant1_beta", F.lit(off_scale)),
            "variant2_beta": F.coalesce("variant2_beta", F.lit(off_scale)),
        }
    )


def pooled_neff(pairs: DataFrame) -> DataFrame:
    """Pooled sample size over the cohorts that have the second variant, per pair, and per trait where the pairs have one."""
    cases, controls = F.sum("n_case"), F.sum("n_control")
    return (
        pairs.filter(F.col("variant2_sebeta").isNotNull() & (F.col("cohort") != "Meta"))
        .groupBy(*[c for c in ("trait",) if c in pairs.columns], "pair_id")
        .agg(cases.alias("n_case"), controls.alias("n_control"))
        .withColumn("n", F.col("n_case") + F.col("n_control"))
        .withColumn("phi", F.try_divide(F.col("n_case").cast("double"), "n"))
        .withColumn("neff", F.col("n") * F.col("phi") * (1 - F.col("phi")))
    )

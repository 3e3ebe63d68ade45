"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociary.functions import labels
from lociary.functions.text import before_first, map_values, recode
from lociary.operators.keyed import attach
from lociary.plans.loci import nonsyn_variant_lists

ANCESTRY_ORDER = ["Total", "AFR", "AMR", "EAS", "FIN", "MID", "NFE", "SAS"]


def cohort_metadata(
    sizes: DataFrame, n_loci: DataFrame, descriptions: dict[str, str], ancestries: list[str] = ANCESTRY_ORDER
) -> DataFrame:
    """One row per trait: biobank list, number of loci, cases and controls per ancestry and in total.

    ``sizes``: ``trait, kind, ancestry, biobank, cases, controls``; an ancestry a trait lacks is NULL.
    """
    ancestry = F.when(F.col("kind") != "-", "Total").otherwise(F.upper(recode(F.col("ancestry"), {"ami": "mid"})))
    rows = sizes.withColumn("ancestry", ancestry)
    # names are made distinct before they are listed: the list holds biobanks, not rows
    biobanks = (
        rows.filter(F.col("ancestry") != "Total")
        .select("trait", "biobank")
        .distinct()
        .groupBy("trait")
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("biobank"))).alias("biobanks"))
    )
    counts = (
        rows.groupBy("trait")
        .pivot("ancestry", ancestries)
        .agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls"))
    )
    wide = counts.select(
        "trait",
        *[F.col(f"`{a}_{c}`").alias(f"n_{c}_{a}") for a in ancestries for c in ("cases", "controls")],
    )
    return (
        wide.join(biobanks, "trait", "left")
        .join(n_loci, "trait", "left")
        .withColumn("description", map_values(F.col("trait"), descriptions, strict=False))
    )


def loci_per_trait(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(F.col("trait_short").alias("trait")).agg(F.count(F.lit(1)).alias("n_loci"))


def report_studies(studies: DataFrame, flags: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Meta-analysed studies that finished, by accession."""
    flagged = attach(studies, flags, ["study_accession"], "left").filter("is_meta_analysis")
    return attach(flagged, succeeded, ["study_accession"], "left_semi").drop("is_meta_analysis")


def report_predictions(predicted: DataFrame, variants: DataFrame | None = None, studies: DataFrame | None = None) -> DataFrame:
    """Locus predictions in the published column layout; the list column needs the variants.

    With ``studies`` (``study_accession, is_meta_analysis``; the accession is the trait) only loci of meta-analysed studies.
    """
    if studies is not None:
        wanted = studies.filter("is_meta_analysis").select(F.col("study_accession").alias("trait")).distinct()
        predicted = attach(predicted, wanted, ["trait"], "left_semi")
    columns = [
        "region", "prediction", "n_total", "n_r2", "n_dentist_outlier", "fraction", "n_nonsyn",
        "max_pip", "max_pip_nonsyn", "cs_nonsyn", "cs_99_nonsyn",
    ]
    rows = predicted
    if variants is not None:
        rows = rows.join(nonsyn_variant_lists(variants), ["trait", "region"], "left")
        rows = rows.withColumn("nonsyn_variants", F.coalesce("nonsyn_variants", F.lit("")))
        columns.append("nonsyn_variants")
    return rows.withColumn("prediction", recode(F.col("prediction"), labels.PREDICTION_NAMES)).select(
        before_first(F.col("trait"), "_").alias("trait"), *columns
    )

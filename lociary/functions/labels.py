"""Fixed label sets and the first-match rules over them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: annotation classes, most severe first
ANNOTATION_LEVELS = ["pLoF", "Missense", "Synonymous", "UTR5", "UTR3", "Promoter", "CRE", "Non-genic"]
NONSYNONYMOUS = ["pLoF", "Missense"]
PREDICTION_LEVELS = ["SL", "NSL", "NA"]
PREDICTION_NAMES = {"SL": "Suspicious loci", "NSL": "Non-suspicious loci", "NA": "NA"}

# fixed values: sequence-ontology consequence terms by impact, most severe first
CODING_HIGH = [
    "transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained",
    "frameshift_variant", "stop_lost",
]
CODING_MEDIUM = [
    "start_lost", "initiator_codon_variant", "transcript_amplification", "inframe_insertion",
    "inframe_deletion", "missense_variant",
]
CODING_LOW = [
    "protein_altering_variant", "splice_region_variant", "incomplete_terminal_codon_variant",
    "start_retained_variant", "stop_retained_variant", "synonymous_variant", "coding_sequence_variant",
]
NON_CODING = [
    "mature_miRNA_variant", "5_prime_UTR_variant", "3_prime_UTR_variant",
    "non_coding_transcript_exon_variant", "non_coding_exon_variant", "intron_variant",
    "NMD_transcript_variant", "non_coding_transcript_variant", "nc_transcript_variant",
    "upstream_gene_variant", "downstream_gene_variant", "TFBS_ablation", "TFBS_amplification",
    "TF_binding_site_variant", "regulatory_region_ablation", "regulatory_region_amplification",
    "feature_elongation", "regulatory_region_variant", "feature_truncation", "intergenic_variant",
]
SEVERITY_ORDER = CODING_HIGH + CODING_MEDIUM + CODING_LOW + NON_CODING


def prediction(max_pip: Column, outliers: Column) -> Column:
    """The text "NA" is a class of its own: no variant stands out."""
    return F.when(max_pip < 0.1, "NA").when(outliers > 0, "SL").otherwise("NSL")


def consequence_category(term: Column) -> Column:
    return (
        F.when(term.isin(CODING_HIGH), "coding_high")
        .when(term.isin(CODING_MEDIUM), "coding_medium")
        .when(term.isin(CODING_LOW), "coding_low")
        .when(term.isin(NON_CODING), "non_coding")
    )


def annotation_class(
    term: Column, category: Column, lof: Column, promoter: Column, dhs: Column, h3k27ac: list[Column]
) -> Column:
    """Eight-level class, first match wins, missing inputs count as no match."""
    any_mark = F.lit(False)
    for mark in h3k27ac:
        any_mark = any_mark | (F.coalesce(mark, F.lit(0)) == 1)
    return (
        F.when(lof.isNotNull() & (lof != "LC"), "pLoF")
        .when((lof == "LC") | category.isin("coding_high", "coding_medium"), "Missense")
        .when(category == "coding_low", "Synonymous")
        .when(term == "3_prime_UTR_variant", "UTR3")
        .when(term == "5_prime_UTR_variant", "UTR5")
        .when(promoter == 1, "Promoter")
        .when((dhs == 1) & any_mark, "CRE")
        .otherwise("Non-genic")
    )


# fixed values: pooled simulation settings, first and last of each band
CONFIG_BANDS = {1317: (13, 17), 1822: (18, 22), 2327: (23, 27), 2832: (28, 32), 3337: (33, 37), 3842: (38, 42)}


def config_group(config: Column) -> Column:
    """Simulation settings of a band are pooled under its number; others stand alone."""
    pooled = config
    for number, (first, last) in CONFIG_BANDS.items():
        pooled = F.when(config.between(first, last), number).otherwise(pooled)
    return pooled


def array_label(group: Column) -> Column:
    return (
        F.when(group.isin(-1, 1, 2, 3, 10, 11, 12, 1822, 3337), "Omni25")
        .when(group.isin(4, 5, 6), "MEGA")
        .when(group.isin(7, 8, 9), "GSA")
        .when(group.isin(1317, 2327, 2832, 3842), "Mixed")
    )


def panel_label(group: Column) -> Column:
    return (
        F.when(group == -1, "TopMed")
        .when(group.isin(1, 4, 7, 10, 11, 12, 1317, 2832), "1000GP3")
        .when(group.isin(2, 5, 8), "HRC")
        .when(group.isin(3, 6, 9), "TopMed-liftover")
        .when(group.isin(1822, 2327, 3337, 3842), "Mixed")
    )


def ancestry_label(group: Column) -> Column:
    return (
        F.when(group == 10, "AFR + EUR")
        .when(group == 11, "EAS + EUR")
        .when(group.isin(12, 2832, 3337, 3842), "AFR + EAS + EUR")
        .otherwise("EUR")
    )


def mixture_label(group: Column) -> Column:
    return F.when(group == 2327, "Mixed array & panel (EUR)").when(
        group == 3842, "Mixed array & panel (multi-ancestry)"
    )


def coarse_annotation(consequence: Column) -> Column:
    """Five classes used for enrichment in the top of the ranking."""
    return (
        F.when(consequence.isin("pLoF", "Missense", "Synonymous"), "Coding")
        .when(consequence.isin("UTR5", "UTR3"), "UTR")
        .otherwise(consequence)
    )


def genic_annotation(consequence: Column) -> Column:
    """Three classes used for enrichment by change of posterior probability."""
    return F.when(
        consequence.isin("pLoF", "Missense", "Synonymous", "UTR5", "UTR3", "Promoter"),
        "Coding|UTR|Promoter",
    ).otherwise(consequence)

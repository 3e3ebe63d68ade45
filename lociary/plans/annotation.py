"""Functional annotation of variants: worst transcript consequence, interval marks, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociary.functions import labels
from lociary.operators.intervals import interval_flags

# fixed values: population names per genome build and how the frequency index spells them
POPULATIONS = {
    "GRCh37": ["afr", "amr", "asj", "eas", "fin", "nfe", "nfe_est", "nfe_nwe", "nfe_onf", "nfe_seu"],
    "GRCh38": ["afr", "ami", "amr", "asj", "eas", "mid", "fin", "nfe", "oth", "sas"],
}
INDEX_NAMES = {
    "GRCh37": lambda pop: f"gnomad_{pop}" if pop else "gnomad",
    "GRCh38": lambda pop: f"{pop}-adj" if pop else "adj",
}
TRANSCRIPT_FIELDS = [
    "gene_symbol", "lof", "hgnc_id", "hgvsp", "transcript_id",
    "polyphen_prediction", "polyphen_score", "sift_prediction", "sift_score",
]
INTERVAL_FILES = ["promoter", "dhs", "h3k27ac_tissue", "h3k27ac_cell"]


def population_freqs(sites: DataFrame, build: str, index: dict[str, int]) -> DataFrame:
    """Named population frequencies out of the site's frequency array, as ``freq_<pop>`` columns."""
    if build not in POPULATIONS:
        raise ValueError(f"unknown genome build {build!r}")
    named = INDEX_NAMES[build]
    pick = lambda pop: F.get("freq", F.lit(index[named(pop)]))
    return sites.withColumns({**{f"freq_{p}": pick(p) for p in POPULATIONS[build]}, "freq_all": pick("")})


def _severity(terms: Column) -> Column:
    order = F.array(*[F.lit(t) for t in labels.SEVERITY_ORDER])
    places = F.transform(terms, lambda t: F.array_position(order, t))
    return F.array_min(F.filter(places, lambda p: p > 0))


def worst_consequence(sites: DataFrame) -> DataFrame:
    """Most severe consequence over the canonical transcripts of each site, protein-coding ones first,
    and the fields of the worst canonical transcript. Works inside the row: no shuffle.

    ``transcripts``: array of structs with ``canonical, biotype, consequence_terms`` and the fields above.
    """
    canonical = F.filter("transcripts", lambda t: t["canonical"] == 1)
    ranked = F.filter(
        F.transform(canonical, lambda t, i: F.struct(_severity(t["consequence_terms"]).alias("rank"), i.alias("i"), t.alias("t"))),
        lambda x: x["rank"].isNotNull(),
    )
    coding = F.filter("__ranked", lambda x: x["t"]["biotype"] == "protein_coding")
    term = lambda rank: F.get(F.array(*[F.lit(t) for t in labels.SEVERITY_ORDER]), (rank - 1).cast("int"))
    best = F.coalesce(F.array_min("__coding"), F.array_min("__ranked"))["rank"]
    worst = F.array_min("__ranked")["t"]
    return (
        sites.withColumn("__ranked", ranked)
        .withColumn("__coding", coding)
        .withColumns(
            {
                "most_severe": F.coalesce(term(best), F.lit("intergenic_variant")),
                "protein_coding": F.size("__coding") > 0,
                **{("gene_most_severe" if f == "gene_symbol" else f): worst[f] for f in TRANSCRIPT_FIELDS},
            }
        )
        .drop("transcripts", "__ranked", "__coding")
    )


def annotate_consequence(sites: DataFrame, intervals: DataFrame, files: list[str] = INTERVAL_FILES) -> DataFrame:
    """Eight-level class of each site from consequence category, loss of function and interval marks."""
    marked = interval_flags(sites, intervals, files).withColumn(
        "consequence_category", labels.consequence_category(F.col("most_severe"))
    )
    promoter, dhs, *marks = [F.col(f) for f in files]
    return marked.withColumn(
        "consequence",
        labels.annotation_class(F.col("most_severe"), F.col("consequence_category"), F.col("lof"), promoter, dhs, marks),
    )

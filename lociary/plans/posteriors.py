"""Posteriors of two methods and several cohorts: merging, credible-set sizes, comparison with the
meta-analysis, annotation enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociary.functions import labels
from lociary.functions.bins import PIP_BREAKS, right_closed_cut
from lociary.functions.text import before_first, excluded_symbolic, map_values, recode, variant_parts, variant_text
from lociary.operators.contingency import bootstrap_risk_ratio, risk_ratio_columns
from lociary.operators.intervals import points_in_intervals
from lociary.operators.keyed import attach, near_keys, settle
from lociary.operators.ordered import exact_quantiles, top_fractions

# fixed values: extended MHC, both ends included; largest gap at which two methods are averaged
MHC = {"GRCh37": ("6", 25_000_000, 36_000_000), "GRCh38": ("chr6", 25_000_000, 36_000_000)}
AGREEMENT_GAP = 0.05
N_EFFECTS = 10

VARIANT_TRAIT = ["contig", "position", "ref", "alt", "trait"]


def _optional_array(df: DataFrame, prefix: str) -> Column:
    """``prefix1 .. prefix10`` as an array where the file has them, else a typed NULL."""
    if f"{prefix}1" in df.columns:
        return F.array(*[F.col(f"{prefix}{i}").cast("double") for i in range(1, N_EFFECTS + 1)])
    return F.lit(None).cast("array<double>")


def read_posteriors(raw: DataFrame, method: str, traits: dict[str, str], build: str) -> DataFrame:
    """One method's rows in the common layout: trait renamed, MHC and symbolic alleles removed,
    low-purity sets marked -1."""
    rows = raw.filter(excluded_symbolic(F.col("variant"))).withColumns(variant_parts(F.col("variant")))
    contig, first, last = MHC[build]
    rows = rows.filter(~((F.col("contig") == contig) & F.col("position").between(first, last)))
    cs = F.col("cs")
    if "low_purity" in raw.columns:
        cs = F.when((F.col("cs") == -1) | (F.col("low_purity") == 1), -1).otherwise(F.col("cs"))
    return rows.select(
        *VARIANT_TRAIT[:4],
        map_values(F.col("trait"), traits).alias("trait"),
        F.lit(method).alias("method"),
        "region",
        F.col("prob").alias("pip"),
        cs.alias("cs_id"),
        F.col("mean").alias("beta_posterior"),
        F.col("sd").alias("sd_posterior"),
        _optional_array(raw, "alpha").alias("alpha"),
        _optional_array(raw, "lbf_variable").alias("lbf_variable"),
    )


def merge_methods(susie: DataFrame, finemap: DataFrame) -> DataFrame:
    """One row per variant and trait from both methods (at most one row each).

    A single present value is kept, two values closer than the gap are averaged, others are NULL.
    """
    rows = susie.unionByName(finemap)
    of = lambda method, c: F.max(F.when(F.col("method") == method, F.col(c)))
    fields = ["pip", "cs_id", "beta_posterior", "sd_posterior"]
    merged = rows.groupBy(*VARIANT_TRAIT).agg(
        *[of("SUSIE", c).alias(f"susie_{c}") for c in fields + ["region", "alpha", "lbf_variable"]],
        *[of("FINEMAP", c).alias(f"finemap_{c}") for c in fields + ["region"]],
    )
    s, f = F.col("susie_pip"), F.col("finemap_pip")
    pip = (
        F.when(s.isNull(), f)
        .when(f.isNull(), s)
        .when(F.abs(s - f) < AGREEMENT_GAP, (s + f) / 2)
    )
    side = lambda m, extra: F.struct(*[F.col(f"{m}_{c}").alias(c) for c in fields + extra])
    return merged.select(
        *VARIANT_TRAIT,
        F.lit("Average").alias("method"),
        F.coalesce("susie_region", "finemap_region").alias("region"),
        pip.alias("pip"),
        side("finemap", []).alias("finemap"),
        side("susie", ["alpha", "lbf_variable"]).alias("susie"),
    )


def with_other_build(merged: DataFrame, build_map: DataFrame, build: str) -> DataFrame:
    """Variant text in both builds through a map (``original_variant, variant``); unmapped stays NULL."""
    here = variant_text(*[F.col(c) for c in VARIANT_TRAIT[:4]])
    mapped = attach(
        merged.withColumn("original_variant", here),
        build_map.select("original_variant", F.col("variant").alias("__other")),
        ["original_variant"],
        "left",
        stored=True,
    )
    new, old = (F.col("__other"), F.col("original_variant"))
    if build == "GRCh38":
        new, old = old, new
    return mapped.withColumns({"variant": new, "variant_b37": old}).drop("__other", "original_variant")


def merge_posteriors(
    cohort: str, susie: DataFrame, finemap: DataFrame, traits: dict[str, str], build: str, build_map: DataFrame
) -> DataFrame:
    """Posteriors of one cohort: both methods merged, both builds named, the first method's set id."""
    merged = merge_methods(
        read_posteriors(susie, "SUSIE", traits, build), read_posteriors(finemap, "FINEMAP", traits, build)
    )
    return with_other_build(merged, build_map, build).select(
        "trait", "variant", "variant_b37", F.lit(cohort).alias("cohort"), "pip", "region", F.col("susie.cs_id").alias("cs_id")
    )


def merge_cohorts(raw: DataFrame, builds: dict[str, str], traits: dict[str, str], build_map: DataFrame) -> DataFrame:
    """Posteriors of all cohorts in one pass: ``trait, variant, variant_b37, cohort, pip, region, cs_id``.

    ``raw``: ``cohort, method ('SUSIE' or 'FINEMAP'), trait, region, variant, prob, cs`` and optionally ``low_purity``;
    ``builds`` gives the genome build of each cohort (an unknown cohort is an error), so the removed region and the
    direction of the lookup follow from the row. ``build_map``: ``original_variant`` (GRCh37), ``variant`` (GRCh38).
    The rules are those of :func:`merge_methods`; cohort and build are keys of the one merge and the one lookup.
    """
    rows = raw.filter(excluded_symbolic(F.col("variant"))).withColumns(variant_parts(F.col("variant")))
    rows = rows.withColumn("build", map_values(F.col("cohort"), builds))
    in_mhc = reduce(
        lambda a, b: a | b,
        [(F.col("build") == b) & (F.col("contig") == contig) & F.col("position").between(first, last) for b, (contig, first, last) in MHC.items()],
    )
    low = F.coalesce(F.col("low_purity") == 1, F.lit(False)) if "low_purity" in raw.columns else F.lit(False)
    rows = rows.filter(~in_mhc).select(
        *VARIANT_TRAIT[:4], map_values(F.col("trait"), traits).alias("trait"), "cohort", "build", "method", "region", F.col("prob").alias("pip"),
        F.when(low, -1).otherwise(F.col("cs")).alias("cs_id"),
    )
    of = lambda method, c: F.max(F.when(F.col("method") == method, F.col(c)))
    merged = rows.groupBy(*VARIANT_TRAIT, "cohort", "build").agg(
        *[of(m, c).alias(f"{m}_{c}") for m in ("SUSIE", "FINEMAP") for c in ("pip", "region")], of("SUSIE", "cs_id").alias("cs_id")
    )
    s, f = F.col("SUSIE_pip"), F.col("FINEMAP_pip")
    pip = F.when(s.isNull(), f).when(f.isNull(), s).when(F.abs(s - f) < AGREEMENT_GAP, (s + f) / 2)
    old, new = F.col("original_variant"), F.col("variant")
    both = build_map.select(F.lit("GRCh37").alias("build"), old.alias("here"), new.alias("other")).unionByName(
        build_map.select(F.lit("GRCh38").alias("build"), new.alias("here"), old.alias("other"))
    )
    here = variant_text(*[F.col(c) for c in VARIANT_TRAIT[:4]])
    named = attach(merged.withColumn("here", here), both, ["build", "here"], "left", stored=True)
    newer = F.col("build") == "GRCh38"
    return named.select(
        "trait", F.when(newer, F.col("here")).otherwise(F.col("other")).alias("variant"), F.when(newer, F.col("other")).otherwise(F.col("here")).alias("variant_b37"),
        "cohort", pip.alias("pip"), F.coalesce("SUSIE_region", "FINEMAP_region").alias("region"), "cs_id",
    )


def all_cohorts(parts: list[DataFrame], previous: DataFrame, traits: list[str]) -> DataFrame:
    """Union of the cohorts and of earlier results for the listed traits."""
    return reduce(DataFrame.unionByName, [*parts, previous.filter(F.col("trait").isin(traits))])


def max_pip_across_cohorts(posteriors: DataFrame, cohorts: list[str]) -> DataFrame:
    """Largest posterior, membership of any credible set, and one column per cohort."""
    return posteriors.groupBy("trait", "variant", "variant_b37").agg(
        F.max("pip").alias("max_pip"),
        F.coalesce(F.bool_or(F.col("cs_id") > 0), F.lit(False)).alias("any_cs"),
        *[F.max(F.when(F.col("cohort") == c, F.col("pip"))).alias(c) for c in cohorts],
    )


def cs_size(posteriors: DataFrame) -> DataFrame:
    return (
        posteriors.filter(F.col("cs_id") > 0)
        .groupBy("trait", "cohort", "region", "cs_id")
        .agg(F.count(F.lit(1)).alias("cs_size"))
    )


def lead_cs_size(posteriors: DataFrame, leads: DataFrame) -> DataFrame:
    """Set sizes in every cohort at the lead variants (``trait, variant_b37``); rows of other variants do not move."""
    keys, leads = ["variant_b37", "trait"], settle(leads)
    at_leads = attach(settle(near_keys(posteriors, leads, keys)), leads, keys, "inner", stored=True)
    sized = attach(at_leads, cs_size(posteriors), ["trait", "cohort", "region", "cs_id"], "left")
    return sized.select("trait", "cohort", "variant", "cs_size")


def cs_size_rows(delta: DataFrame, lead_sizes: DataFrame) -> DataFrame:
    """Meta-analysis set size and smallest cohort set size per locus, as two labelled rows."""
    smallest = lead_sizes.groupBy("trait", "variant").agg(F.min("cs_size").alias("cs_size"))
    known = delta.filter(F.col("prob").isNotNull() & F.col("max_pip").isNotNull() & (F.col("prediction") != "NA"))
    per_locus = (
        attach(known, smallest, ["trait", "variant"], "inner")
        .groupBy("trait", "prediction", "region", "cs")
        .agg(F.count(F.lit(1)).alias("meta"), F.max(F.when(F.col("lead_variant"), F.col("cs_size"))).alias("biobanks"))
        .filter(F.col("biobanks").isNotNull())
    )
    return per_locus.unpivot(["trait", "prediction", "region", "cs"], ["meta", "biobanks"], "cohort", "cs_size")


def cs_size_comparison(rows: DataFrame) -> DataFrame:
    """Mean and median set size by cohort kind and class."""
    rows = settle(rows)
    group = ["cohort", "prediction"]
    means = rows.groupBy(*group).agg(F.avg("cs_size").alias("mean"))
    return means.join(exact_quantiles(rows, group, "cs_size", {"median": 0.5}), group)


def max_pip_per_variant(max_pips: DataFrame, build_map: DataFrame) -> DataFrame:
    """Variant id in both builds with its largest posterior."""
    parsed = max_pips.withColumns(variant_parts(F.col("variant")))
    return with_other_build(parsed.drop("variant"), build_map, "GRCh37").select("variant", "variant_b37", "max_pip")


# --- meta-analysis against cohorts ----------------------------------------------------------------


def pip_delta(
    variants: DataFrame, predicted: DataFrame | None, cohorts: DataFrame, renames: dict[str, str], *,
    stored: bool = False, like: DataFrame | None = None,
) -> DataFrame:
    """Meta-analysis posterior against the cohorts' largest one, per (trait, variant) both have.

    ``variants`` or ``cohorts`` already carry the external posteriors; ``renames`` maps the cohorts' trait names.
    ``predicted`` is None if the variants carry ``prediction`` too (:func:`loci.with_prediction`). ``stored`` says that
    ``cohorts`` is a file, so that it is not stored again; ``like`` holds trait and variant of the variants before any join.
    """
    classed = variants if predicted is None else attach(variants, predicted.select("trait", "region", "prediction"), ["trait", "region"], "left")
    named = cohorts.withColumn("trait", recode(F.col("trait"), renames))
    both = attach(
        classed.withColumn("trait", before_first(F.col("trait"), "_")),
        named,
        ["trait", "variant"],
        "inner",
        stored=stored,
        like=None if like is None else like.select(before_first(F.col("trait"), "_").alias("trait"), "variant"),
    )
    return both.withColumns(
        {
            "ratio": F.try_divide("prob", "max_pip"),
            "delta": F.col("prob") - F.col("max_pip"),
            "prob_bin": right_closed_cut(F.col("prob"), PIP_BREAKS),
            "max_pip_bin": right_closed_cut(F.col("max_pip"), PIP_BREAKS),
        }
    )


def credible_pairs(credible: DataFrame, cohorts: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Trait and variant of the meta-analysis' ``credible`` variants and of the cohorts' rows in a credible set, as
    :func:`pip_delta` compares them."""
    own = credible.select(before_first(F.col("trait"), "_").alias("trait"), "variant")
    return own.unionByName(cohorts.filter(F.col("cs_id") > 0).select(recode(F.col("trait"), renames).alias("trait"), "variant"))


def near_pairs(rows: DataFrame, pairs: DataFrame, renames: dict[str, str], short: bool = False) -> DataFrame:
    """The rows whose renamed trait (``short``: its first part) and variant are in the stored table ``pairs``, and possibly
    a few others."""
    trait = before_first(F.col("trait"), "_") if short else recode(F.col("trait"), renames)
    named = rows.withColumn("__trait", trait)
    return near_keys(named, pairs.withColumnRenamed("trait", "__trait"), ["__trait", "variant"]).select(*rows.columns)


def _known(delta: DataFrame) -> DataFrame:
    return delta.filter(F.col("prob").isNotNull() & F.col("max_pip").isNotNull())


TOP_FRACTIONS = [0.995, 0.999, 0.9995]


def rank_enrichment_tables(delta: DataFrame) -> DataFrame:
    """Annotation counts in the top of the meta-analysis and cohort rankings, as 2x2 rows.

    Populations: all loci, and loci of class SL and NSL ranked on their own.
    """
    population = F.array_compact(
        F.array(F.lit("All loci"), F.when(F.col("prediction").isin("SL", "NSL"), recode(F.col("prediction"), labels.PREDICTION_NAMES)))
    )
    of_variant = ["annotation", "prob", "max_pip", "trait", "region", "variant"]
    known = settle(_known(delta).withColumn("annotation", labels.coarse_annotation(F.col("consequence"))).select("prediction", *of_variant))
    slim = known.select(F.explode(population).alias("population"), *of_variant)
    tie = [F.col(c) for c in ("trait", "region", "variant")]
    tops = [
        top_fractions(slim, ["population"], score, tie, TOP_FRACTIONS)
        .groupBy("population", "fraction", "annotation")
        .agg(F.count(F.lit(1)).alias(name))
        for score, name in (("prob", "hits2"), ("max_pip", "hits1"))
    ]
    group = ["population", "fraction"]
    sides = []
    for top, hits in zip(tops, ("hits2", "hits1")):
        kept = top.filter(F.col("annotation").isNotNull())
        total = F.sum(hits).over(Window.partitionBy(*group))
        sides.append(kept.withColumn(hits.replace("hits", "total"), total))
    # an annotation seen in only one ranking has no table
    return sides[0].join(sides[1], group + ["annotation"], "inner")


def rank_enrichment(delta: DataFrame) -> DataFrame:
    """Risk ratio of each annotation, meta-analysis top against cohort top."""
    return rank_enrichment_tables(delta).withColumn("enrichment", risk_ratio_columns()["rr"])


def rank_enrichment_interval(delta: DataFrame, replicates: int = 5000) -> DataFrame:
    tables = settle(rank_enrichment(delta))
    keys = ["population", "fraction", "annotation"]
    return tables.join(bootstrap_risk_ratio(tables, keys, replicates), keys)


def delta_enrichment_tables(delta: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Annotation counts by change of posterior beyond +-t against the middle, as 2x2 rows.

    All thresholds are binned in one scan; what is repeated per threshold is the table of bin counts.
    """
    rows = (
        _known(delta)
        .filter(F.col("delta").isNotNull() & F.col("consequence").isNotNull())
        .select(
            labels.genic_annotation(F.col("consequence")).alias("annotation"),
            *[right_closed_cut(F.col("delta"), [None, -t, t, 1.0]).alias(f"b{i}") for i, t in enumerate(thresholds)],
        )
    )
    bins = [f"b{i}" for i in range(len(thresholds))]
    cells = rows.groupBy("annotation", *bins).agg(F.count(F.lit(1)).alias("n"))
    per = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(b).alias("bin")) for t, b in zip(thresholds, bins)])
    counts = (
        cells.select("annotation", "n", F.explode(per).alias("x"))
        .groupBy("annotation", F.col("x.threshold").alias("threshold"), F.col("x.bin").alias("bin"))
        .agg(F.sum("n").alias("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy("threshold", "bin")))
    )
    pick = lambda b, c: F.max(F.when(F.col("bin") == b, F.col(c)))
    wide = counts.groupBy("threshold", "annotation").agg(
        *[pick(b, c).alias(f"{c}{b}") for b in (0, 1, 2) for c in ("n", "total")]
    )
    direction = F.array(
        F.struct(F.lit("above").alias("direction"), F.col("n2").alias("hits2"), F.col("total2").alias("total2")),
        F.struct(F.lit("below").alias("direction"), F.col("n0").alias("hits2"), F.col("total0").alias("total2")),
    )
    return wide.select(
        "threshold", "annotation", F.col("n1").alias("hits1"), F.col("total1").alias("total1"), F.explode(direction).alias("d")
    ).select("threshold", "annotation", "hits1", "total1", "d.*")


def delta_enrichment(delta: DataFrame) -> DataFrame:
    return delta_enrichment_tables(delta).withColumn("enrichment", risk_ratio_columns()["rr"])


def delta_enrichment_interval(delta: DataFrame, replicates: int = 5000) -> DataFrame:
    tables = settle(delta_enrichment(delta))
    keys = ["threshold", "annotation", "direction"]
    return tables.join(bootstrap_risk_ratio(tables, keys, replicates), keys)


def nonsyn_cs_counts(delta: DataFrame) -> DataFrame:
    """Variants in credible sets, and nonsynonymous ones among them, meta-analysis and any cohort."""
    nonsyn = F.coalesce(F.col("consequence").isin(labels.NONSYNONYMOUS), F.lit(False))
    return _known(delta).agg(
        F.count_if(F.col("cs") & nonsyn).alias("n_cs_nonsyn"),
        F.count_if("cs").alias("n_cs"),
        F.count_if(F.col("any_cs") & nonsyn).alias("n_cs_any_nonsyn"),
        F.count_if("any_cs").alias("n_cs_any"),
    )


def _either_above(cut: float) -> Column:
    return (F.col("prob") > cut) | (F.col("max_pip") > cut)


def delta_outliers(delta: DataFrame, cut: float = 0.001) -> DataFrame:
    """Variants in classified loci with either posterior above the cut; a label where a non-suspicious
    locus changes by more than one half."""
    name = F.coalesce("rsid", "variant")
    return delta.filter((F.col("prediction") != "NA") & _either_above(cut)).withColumn(
        "label", F.when((F.col("prediction") == "NSL") & (F.abs("delta") > 0.5), name).otherwise("")
    )


def mean_delta(outliers: DataFrame) -> DataFrame:
    return outliers.groupBy("trait", "prediction").agg(
        F.avg("delta").alias("mean_delta"), F.count(F.lit(1)).alias("n")
    )


def pip_pairs(delta: DataFrame, cut: float = 0.001) -> DataFrame:
    return _known(delta).filter(_either_above(cut)).select("trait", "region", "variant", "max_pip", "prob", "prediction")


# --- merged credible sets ---------------------------------------------------------------------------


def with_merged_cs(rows: DataFrame, merged_sets: DataFrame) -> DataFrame:
    """Attach the merged set id to cohort rows by cohort, trait, region and variant."""
    keys = ["cohort", "trait", "region", "variant"]
    return attach(rows, merged_sets.select(*keys, "csm_id"), keys, "left", stored=True)


def cs_merge_labels(leads: DataFrame, merged_sets: DataFrame, window: int) -> DataFrame:
    """Merged sets around each lead: members on the lead's contig between 0.99 x start and 1.01 x end of
    its window, with their distance, the lead's own set id (1 when it has none) and a highlight flag.

    ``leads``: ``trait, lead_variant``. Sort by ``distance`` for the display order.
    """
    at = variant_parts(F.col("lead_variant"))
    own = merged_sets.groupBy("trait", F.col("variant").alias("lead_variant")).agg(F.min("csm_id").alias("lead_csm_id"))
    spans = attach(leads, own, ["trait", "lead_variant"], "left").select(
        "trait",
        at["contig"].alias("contig"),
        "lead_variant",
        at["position"].alias("lead_position"),
        F.coalesce("lead_csm_id", F.lit(1)).alias("lead_csm_id"),
        F.greatest(F.lit(0), F.ceil((at["position"] - window) * 0.99)).alias("start"),
        (F.floor((at["position"] + window) * 1.01) + 1).alias("end"),
    )
    members = merged_sets.withColumns(variant_parts(F.col("variant"))).select(
        "trait", "contig", "position", "cohort", "variant", "csm_id"
    )
    return points_in_intervals(members, spans, ["trait", "contig"]).select(
        "trait", "lead_variant", "cohort", "variant", "csm_id", "lead_csm_id",
        F.abs(F.col("position") - F.col("lead_position")).alias("distance"),
        (F.col("csm_id") == F.col("lead_csm_id")).alias("highlighted"),
    )

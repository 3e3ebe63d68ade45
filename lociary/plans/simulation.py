"""Calibration, recall and outlier metrics of fine-mapping on simulated studies.

A study is (pheno, config); a region is one locus of a study. Any of them may hold much of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociary.functions import labels
from lociary.functions.bins import PIP_BREAKS, QUANTILE_BREAKS, left_closed_bin, uniform_bin
from lociary.functions.stats import OUTLIER_NLOG10P, R2_THRESHOLD, binomial_interval
from lociary.functions.text import recode, region_parts, token, variant_parts
from lociary.operators.reshape import arrays_to_rows
from lociary.operators.intervals import points_in_intervals
from lociary.operators.keyed import attach, complete_few, settle
from lociary.operators.ordered import exact_quantiles, rank_within
from lociary.operators.roc import confusion_at, roc_auc, roc_curve, score_counts
from lociary.operators.sweep import add_fdr, calibration_sweep

REGION = ["pheno", "config", "region"]
STUDY_VARIANT = ["pheno", "config", "contig", "position", "ref", "alt"]
TRUTHS = ["abf_success", "abf_success_cs", "abf_success_cs_99"]
R2_BIN, PIP_BIN, NLOG10P_BIN = 0.1, 0.1, 0.5


def parse_study(abf: DataFrame) -> DataFrame:
    """``x.phenoN.configM`` and the variant text as typed columns."""
    return abf.withColumns(
        {
            "pheno": F.regexp_extract(token(F.col("trait"), ".", 1), "^.{5}(.*)$", 1).cast("int"),
            "config": F.regexp_extract(token(F.col("trait"), ".", 2), "^.{6}(.*)$", 1).cast("int"),
            **variant_parts(F.col("variant")),
        }
    )


def region_summary(variants: DataFrame) -> DataFrame:
    """One row per region: causal variant, its and the largest posterior, lead z, success flags.

    Success asks whether the causal variant is among the maximal ones, in the 95 % or 99 % set. That is a
    test on its own row, so no set of variants is gathered; :func:`region_cs_members` lists the sets.
    """
    totals = settle(
        variants.groupBy(*REGION).agg(
            F.coalesce(F.bool_or("gamma"), F.lit(False)).alias("gamma"),
            F.max("prob").alias("max_prob"),
            F.max("nlog10p_dentist").alias("max_nlog10p_dentist"),
            F.max(F.when(F.col("lead_variant"), F.try_divide("beta", "se"))).alias("lead_z"),
            F.count_if("cs").alias("n_cs"),
            F.count_if("cs_99").alias("n_cs_99"),
        )
    )
    causal = (
        variants.filter("gamma")
        .groupBy(*REGION)
        .agg(F.min(F.struct("position", "variant", "prob", "cs", "cs_99")).alias("c"))
        .select(
            *REGION,
            F.col("c.variant").alias("gamma_variant"),
            F.col("c.prob").alias("gamma_prob"),
            F.col("c.cs").alias("__cs"),
            F.col("c.cs_99").alias("__cs_99"),
        )
    )
    parts = region_parts(F.col("region"))
    hit = lambda cond: F.coalesce(cond, F.lit(False))
    # both sides have one row per region
    return (
        totals.join(causal, REGION, "left")
        .withColumns(
            {
                "abf_success": hit(F.col("gamma_prob") == F.col("max_prob")),
                "abf_success_cs": hit(F.col("__cs")),
                "abf_success_cs_99": hit(F.col("__cs_99")),
                "contig": parts["contig"],
                "start": parts["start"],
                "end": parts["end"],
            }
        )
        .drop("__cs", "__cs_99")
    )


def region_cs_members(variants: DataFrame) -> DataFrame:
    """Members of the credible sets of every region, one row per set and variant."""
    level = F.array_compact(F.array(F.when(F.col("cs"), "95%"), F.when(F.col("cs_99"), "99%")))
    return variants.select(*REGION, "variant", F.explode(level).alias("level")).distinct()


def parse_effects(effects: DataFrame) -> DataFrame:
    """True effects with their source path ``.../phenoN.beta...`` as pheno and variant columns."""
    name = token(F.substring_index(F.col("source"), "/", -1), ".", 0)
    return effects.select(F.regexp_extract(name, "^.{5}(.*)$", 1).cast("int").alias("pheno"), *[
        c.alias(n) for n, c in variant_parts(F.col("variant")).items()
    ])


def true_causal_in_region(effects: DataFrame, regions: DataFrame) -> DataFrame:
    """Causal variants lying in an analysed region of their phenotype, for each configuration."""
    spans = regions.select("pheno", "contig", "config", "start", "end")
    inside = points_in_intervals(effects, spans, ["pheno", "contig"])
    return inside.select(*STUDY_VARIANT, F.lit(True).alias("gamma_from_region"))


def variants_complete(variants: DataFrame, causal: DataFrame) -> DataFrame:
    """Variants plus the causal ones that were never tested, with study groups and their id.

    A full outer join in which the variants keep their place when the causal table is small; when it is not, only the
    variants that may be causal move.
    """
    return complete_few(variants, settle(causal), STUDY_VARIANT).withColumns(
        {
            "pheno_group": (F.floor((F.col("pheno") - 1) / 100) + 1).cast("int"),
            "config_group": labels.config_group(F.col("config")).cast("int"),
        }
    ).withColumn("id", F.concat_ws(",", "pheno_group", "config_group"))


def pip_quantile(complete: DataFrame) -> DataFrame:
    """0-based descending rank of the posterior within each study group and ``q = rank / n``.

    Rows without a posterior come last and get negative ranks, so they fall outside every q bin.
    """
    tie = [F.col(c) for c in ("pheno", "config", "contig", "position", "ref", "alt")]
    ranked = rank_within(complete, ["id"], [F.desc_nulls_last("prob"), *tie], "__place")
    known = ranked.groupBy("id").agg(F.count("prob").alias("__n"))
    out = attach(ranked, known, ["id"], "inner")
    rank = F.when(F.col("prob").isNull(), F.col("__n") - 1 - F.col("__place")).otherwise(F.col("__place"))
    return (
        out.withColumn("rank", rank)
        .withColumn("q", F.try_divide(F.col("rank").cast("double"), F.col("__n")))
        .drop("__place", "__n")
    )


def calibration_bins(ranked: DataFrame) -> DataFrame:
    """Five rows per study group, one per bin: counts and posteriors by posterior bin, causal counts by
    rank-quantile bin. A bin without rows is NULL, not 0."""
    group = ["pheno_group", "config_group"]
    binned = ranked.select(
        *group,
        "prob", "gamma", "gamma_from_region",
        left_closed_bin(F.col("prob"), PIP_BREAKS).alias("p_bin"),
        F.when(F.col("gamma"), left_closed_bin(F.col("q"), QUANTILE_BREAKS)).alias("q_bin"),
    )
    per_p = binned.groupBy(*group, F.col("p_bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("prob_bins"),
        F.nullif(F.count_if("gamma"), F.lit(0)).alias("prob_true_bins"),
        F.avg("prob").alias("mean_prob"),
        F.stddev_pop("prob").alias("mean_prob_sd"),
    )
    per_q = binned.groupBy(*group, F.col("q_bin").alias("bin")).agg(F.count(F.lit(1)).alias("q_true_bins"))
    frame = binned.groupBy(*group).agg(F.count_if("gamma_from_region").alias("Ngamma_region"))
    grid = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(4))))
    # five rows per study group from here on
    return (
        grid.join(per_p, [*group, "bin"], "left")
        .join(per_q, [*group, "bin"], "left")
        .withColumn("calibration", F.try_divide(F.col("prob_true_bins").cast("double"), "prob_bins"))
    )


def bins_as_arrays(metrics: DataFrame) -> DataFrame:
    """The same with one row per study group and arrays of five."""
    columns = ["prob_bins", "prob_true_bins", "calibration", "mean_prob", "mean_prob_sd", "q_true_bins"]
    at = lambda c, i: F.max(F.when(F.col("bin") == i, F.col(c)))
    return metrics.groupBy("pheno_group", "config_group", "Ngamma_region").agg(
        *[F.array(*[at(c, i) for i in range(5)]).alias(c) for c in columns]
    )


def arrays_as_bins(arrays: DataFrame) -> DataFrame:
    """The inverse of :func:`bins_as_arrays`; the arrays may also be kept as text."""
    columns = {c: c for c in ("prob_bins", "prob_true_bins", "calibration", "mean_prob", "mean_prob_sd", "q_true_bins")}
    rows = arrays_to_rows(arrays, columns, "bin")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("prob_bins", "prob_true_bins", "q_true_bins")})


def _in_causal_regions(ranked: DataFrame, regions: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``like`` (:func:`attach`): the variants before they were completed, for regions with much of the data."""
    truth = regions.filter("gamma").select(*REGION, "max_prob", "lead_z", *TRUTHS)
    return attach(ranked, truth, REGION, "inner", like=like)


def lead_samples(ranked: DataFrame, regions: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Sample size and heterogeneity of lead and causal variants in regions with a causal variant."""
    return (
        _in_causal_regions(ranked, regions, like)
        .filter(F.col("lead_variant") | F.col("gamma"))
        .select(*REGION, "variant", "n_samples", "lead_variant", "gamma", "prob", "p_het")
    )


CANDIDATE = ["variant", "gamma", "gamma_from_region", "prob", "cs", "cs_99", "lead_variant", "t_dentist", "nlog10p_dentist"]


def prob001(ranked: DataFrame, regions: DataFrame, cut: float = 0.01, columns: list[str] = CANDIDATE, like: DataFrame | None = None) -> DataFrame:
    """Variants above the posterior cut in regions with a causal variant, with all columns or those a later step reads."""
    return _in_causal_regions(ranked.filter(F.col("prob") > cut), regions, like).select(*REGION, *columns)


def dentist_bins(ranked: DataFrame, regions: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Non-lead variants per region and r2 / largest posterior / outlier-statistic bin."""
    expected = F.col("r") * F.col("lead_z") - F.try_divide("beta", "se")
    rows = _in_causal_regions(ranked.filter(~F.col("lead_variant")), regions, like).withColumns(
        {
            "r2_bin": uniform_bin(F.col("r") * F.col("r"), 0.0, 1.0, 10, R2_BIN),
            "max_prob_bin": uniform_bin(F.col("max_prob"), 0.0, 1.0, 10, PIP_BIN),
            "nlog10p_dentist_bin": uniform_bin(F.col("nlog10p_dentist"), 0.0, 15.0, 30, NLOG10P_BIN),
        }
    )
    capped = F.when(F.col("nlog10p_dentist") > 100, 100.0).otherwise(F.col("nlog10p_dentist"))
    return rows.groupBy(*REGION, "r2_bin", "max_prob_bin", "nlog10p_dentist_bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(expected > 0).alias("n_above"),
        F.count_if(expected < 0).alias("n_below"),
        F.sum("n_samples").alias("weighted_n_by_n_samples"),
        F.coalesce(F.sum(capped), F.lit(0.0)).alias("weighted_n_by_dentist"),
        F.max("nlog10p_dentist").alias("max_nlog10p_dentist"),
        F.max("n_samples").alias("max_n_samples"),
        F.min("n_samples").alias("min_n_samples"),
        *[F.bool_or(t).alias(t) for t in TRUTHS],
    )


def with_second_build(metrics: DataFrame, second: DataFrame) -> DataFrame:
    """Append the other build's metrics: phenotype groups 1, 3, 5, configurations negated."""
    kept = second.filter(F.col("pheno_group").isin(1, 3, 5)).withColumn("config_group", -F.col("config_group"))
    return metrics.unionByName(kept, allowMissingColumns=True)


def fdr_recall(metrics: DataFrame) -> DataFrame:
    """False discovery rate per posterior bin and cumulative recall per rank quantile, with intervals and
    setting labels. Bin rows are ordered by ``bin`` within a study group (five rows)."""
    group = Window.partitionBy("pheno_group", "config_group", "Ngamma_region")
    so_far = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = F.sum(F.coalesce("q_true_bins", F.lit(0))).over(so_far)
    edge = lambda breaks: F.get(F.array(*[F.lit(b) for b in breaks]), F.col("bin"))
    table = metrics.withColumns(
        {
            "prob_bin": edge(PIP_BREAKS[:5]),
            "q_bin": edge(QUANTILE_BREAKS[1:]),
            # a sum with a missing part is missing
            "Ngamma": F.when(F.count("prob_true_bins").over(group) == 5, F.sum("prob_true_bins").over(group)),
            "found": cumulative,
        }
    )
    cal_lo, cal_hi = binomial_interval(F.col("prob_true_bins"), F.col("prob_bins"))
    rec_lo, rec_hi = binomial_interval(F.col("found"), F.col("Ngamma_region"))
    setting = F.col("config_group")
    return table.withColumns(
        {
            "calibration_lower": cal_lo,
            "calibration_upper": cal_hi,
            "fdr": 1 - F.col("calibration"),
            "fdr_lower": 1 - cal_hi,
            "fdr_upper": 1 - cal_lo,
            "expected_fdr": 1 - F.col("mean_prob"),
            "recall": F.try_divide(F.col("found").cast("double"), "Ngamma_region"),
            "recall_lower": rec_lo,
            "recall_upper": rec_hi,
            "array": labels.array_label(setting),
            "imputation": labels.panel_label(setting),
            "ancestry": labels.ancestry_label(setting),
            "mixture": labels.mixture_label(setting),
        }
    )


def _bin_at_least(value: Column, threshold: float, size: float) -> Column:
    """Bin lower edge >= threshold, compared as whole bin numbers."""
    return value >= round(threshold / size)


def locus_metrics(frac: DataFrame, min_max_prob: float | None = None) -> DataFrame:
    """Outlier count, total and fraction per region among variants in LD with the lead."""
    rows = frac.dropna(subset=["r2_bin", "nlog10p_dentist_bin"]).filter(
        _bin_at_least(F.col("r2_bin"), R2_THRESHOLD, R2_BIN)
    )
    if min_max_prob is not None:
        rows = rows.filter(_bin_at_least(F.col("max_prob_bin"), min_max_prob, PIP_BIN))
    outlier = _bin_at_least(F.col("nlog10p_dentist_bin"), OUTLIER_NLOG10P, NLOG10P_BIN)
    return (
        rows.groupBy(*REGION)
        .agg(
            *[F.bool_or(t).alias(t) for t in TRUTHS],
            F.max("max_prob_bin").alias("max_prob_bin"),
            F.max("max_nlog10p_dentist").alias("max_nlog10p_dentist"),
            F.sum(F.when(outlier, F.col("n")).otherwise(0)).alias("count"),
            F.sum("n").alias("count_total"),
        )
        .withColumn("fraction", F.try_divide(F.col("count").cast("double"), "count_total"))
    )


def locus_prediction(metrics: DataFrame, count_threshold: int = 1) -> DataFrame:
    return metrics.withColumn(
        "prediction", recode(F.when(F.col("count") >= count_threshold, "SL").otherwise("NSL"), labels.PREDICTION_NAMES)
    )


def calibration_by_threshold(candidates: DataFrame, predicted: DataFrame) -> DataFrame:
    """Calibration of variants above each posterior threshold 0.01 .. 1, by predicted class."""
    joined = attach(candidates, predicted.select(*REGION, "prediction"), REGION, "left")
    known = joined.filter(F.col("prediction").isNotNull())
    return add_fdr(calibration_sweep(known, ["prediction"], "prob", "gamma", 0.01, 0.01, 100))


def variant_fraction(sweep: DataFrame) -> DataFrame:
    """Share of each class among the variants above a threshold."""
    total = F.sum("count").over(Window.partitionBy("threshold"))
    return sweep.select("threshold", "prediction", F.try_divide(F.col("count").cast("double"), total).alias("frac"))


def outlier_scores(metrics: DataFrame) -> DataFrame:
    """Regions with and without success per outlier count, for the three definitions of success."""
    long = metrics.select("count", F.explode(_truth_rows()).alias("t")).select("count", "t.*")
    return score_counts(long, ["truth"], "success", "count")


def _truth_rows() -> Column:
    return F.array(*[F.struct(F.lit(t).alias("truth"), F.col(t).alias("success")) for t in TRUTHS])


def outlier_roc(metrics: DataFrame) -> DataFrame:
    return roc_auc(outlier_scores(metrics), ["truth"])


def outlier_roc_curve(metrics: DataFrame) -> DataFrame:
    return roc_curve(outlier_scores(metrics), ["truth"])


def outlier_confusion(metrics: DataFrame, threshold: float = 1) -> DataFrame:
    return confusion_at(outlier_scores(metrics), ["truth"], threshold)


def auc_grid(frac: DataFrame, min_max_prob: float = 0.9) -> DataFrame:
    """AUC for 10 r2 thresholds x 21 statistic bounds x 3 truths from one scan of the bin table.

    Per region the counts are accumulated for all bounds at once, then repeated only per r2 threshold
    reached (at most ten rows per region).
    """
    bounds = list(range(21))
    rows = frac.dropna(subset=["r2_bin", "nlog10p_dentist_bin"]).filter(
        _bin_at_least(F.col("max_prob_bin"), min_max_prob, PIP_BIN) & (F.col("r2_bin") >= 0)
    )
    above = [F.sum(F.when(F.col("nlog10p_dentist_bin") >= j, F.col("n")).otherwise(0)).alias(f"c{j}") for j in bounds]
    per_bin = rows.groupBy(*REGION, F.least(F.col("r2_bin"), F.lit(9)).alias("r2_top")).agg(
        *above, *[F.bool_or(t).alias(t) for t in TRUTHS]
    )
    per_threshold = (
        per_bin.withColumn("r2_index", F.explode(F.sequence(F.lit(0), "r2_top")))
        .groupBy(*REGION, "r2_index")
        .agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in bounds], *[F.bool_or(t).alias(t) for t in TRUTHS])
    )
    cells = F.array(*[F.struct(F.lit(j).alias("bound_index"), F.col(f"c{j}").alias("count")) for j in bounds])
    long = (
        per_threshold.select("r2_index", F.explode(_truth_rows()).alias("t"), cells.alias("cells"))
        .select("r2_index", "t.*", F.explode("cells").alias("cell"))
        .select("r2_index", "truth", "success", "cell.*")
    )
    group = ["r2_index", "bound_index", "truth"]
    return roc_auc(score_counts(long, group, "success", "count"), group).select(
        F.round(F.col("r2_index") * R2_BIN, 1).alias("r2_threshold"),
        (F.col("bound_index") * NLOG10P_BIN).alias("nlog10p_bound"),
        "truth",
        "roc_auc",
    )


def sample_size_ratio(leads: DataFrame, configs: list[int]) -> DataFrame:
    """Max / min sample size among lead and causal variants of confidently mapped regions."""
    grouped = leads.groupBy(*REGION).agg(
        F.try_divide(F.max("n_samples").cast("double"), F.min("n_samples")).alias("ratio"),
        F.count(F.lit(1)).alias("n"),
        F.min("p_het").alias("min_p_het"),
        F.max("prob").alias("__max"),
    )
    return grouped.filter((F.col("n") > 1) & (F.col("__max") > 0.9) & F.col("config").isin(configs)).drop("__max")


def sample_size_ratio_summary(ratios: DataFrame) -> DataFrame:
    """Five-number summary, mean and the share of ratios below 1."""
    quantiles = exact_quantiles(ratios, [], "ratio", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    extremes = ratios.agg(
        F.min("ratio").alias("minimum"), F.avg("ratio").alias("mean"), F.max("ratio").alias("maximum"),
        F.avg((F.col("ratio") < 1).cast("double")).alias("share_below_1"),
    )
    one = F.lit(1).alias("__one")  # a single row on each side
    return extremes.select("*", one).join(quantiles.select("*", one), "__one").drop("__one")

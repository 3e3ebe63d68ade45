"""Per-variant posteriors and outlier statistics, locus summaries and what is derived from them.

Variants carry ``trait, region, variant, position, beta, se, r`` and more; a locus is (trait, region).
A locus may hold any share of the rows, so nothing here gathers a locus in one task: per-locus numbers
come from map-side aggregates and return to the rows through :func:`attach`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociary.functions import labels
from lociary.functions.bins import right_closed_cut
from lociary.functions.stats import (
    OUTLIER_NLOG10P,
    PRIOR_VARIANCE,
    R2_THRESHOLD,
    binomial_interval,
    effective_samples,
    lead_consistency,
    lead_consistency_unsigned,
    log_bayes_factor,
    nlog10p_chi2,
    significance_stars,
)
from lociary.functions.text import before_first, recode
from lociary.operators.density import density
from lociary.operators.contingency import bootstrap_risk_ratio, fisher_exact, risk_ratio_columns
from lociary.operators.keyed import (
    above_floor, attach, broadcast_bound, hot_keys, measured_bytes, near_keys, settle, shuffle_partitions, with_possible_partner
)
from lociary.operators.ordered import exact_quantiles, rank_within
from lociary.operators.sweep import calibration_sweep

LOCUS = ["trait", "region"]
LBF_BIN = 256  # exp(256) is far from overflow, so sums inside a bin are safe


def _with_score(variants: DataFrame, prior: float) -> DataFrame:
    return variants.withColumn(
        "lbf", log_bayes_factor(F.try_divide("beta", "se"), F.col("se") * F.col("se"), prior)
    ).withColumn("score", F.round("lbf", 9))


def _locus_totals(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Largest Bayes factor and score of each locus and the sum of the factors relative to the largest."""
    lbf_bin = F.floor(F.col("lbf") / LBF_BIN)
    bins = scored.groupBy(*keys, lbf_bin.alias("__bin")).agg(
        F.max("lbf").alias("__max"),
        F.max("score").alias("max_score"),
        F.sum(F.exp(F.col("lbf") - lbf_bin * LBF_BIN)).alias("__sum"),
    )
    top = F.max("__max").over(Window.partitionBy(*keys))  # over the bins of a locus, not its rows
    return (
        bins.withColumn("__top", top)
        .groupBy(*keys)
        .agg(
            F.max("__top").alias("__top"),
            F.max("max_score").alias("max_score"),
            F.sum(F.col("__sum") * F.exp(F.col("__bin") * LBF_BIN - F.col("__top"))).alias("__total"),
        )
    )


def _posterior() -> Column:
    return F.exp(F.col("lbf") - F.col("__top")) / F.col("__total")


def abf_pip(variants: DataFrame, prior: float = PRIOR_VARIANCE, keys: list[str] = LOCUS) -> DataFrame:
    """Add ``lbf``, ``prob`` (posterior within the locus) and ``score`` (rounded lbf used to pick leads).

    The log-sum-exp needs one pass: Bayes factors are summed relative to the floor of their bin, and
    the few bins of a locus are then rescaled to its largest.
    """
    scored = _with_score(variants, prior)
    totals = _locus_totals(scored, keys)
    return attach(scored, totals, keys, "inner", nulls_match=True).withColumn("prob", _posterior()).drop("__top", "__total")


def lead_rows(
    variants: DataFrame, carry: list[str], score: str, best: str, keys: list[str] = LOCUS
) -> DataFrame:
    """The row of each locus whose ``score`` equals the locus maximum ``best``; ties go to the smallest
    position, then variant, then the carried values. Only tied rows are aggregated."""
    order = ["position", "variant"] + [c for c in carry if c not in ("position", "variant")]
    return (
        variants.filter(F.col(score) == F.col(best))
        .groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("__lead"))
        .select(*keys, *[F.col(f"__lead.{c}").alias(f"lead_{c}") for c in order])
    )


def dentist_s(scored: DataFrame, keys: list[str] = LOCUS, signed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Outlier statistic of every variant against its locus lead. Returns (variants, leads).

    ``signed=False`` takes chi-square values and squared correlations only. Variants of a locus without a lead, where
    every standard error is zero or missing, stay with a NULL statistic.
    """
    with_z = scored.withColumn("z", F.try_divide("beta", "se"))
    leads = settle(lead_rows(with_z, ["z"], "score", "max_score", keys))
    chosen = leads.select(*keys, "lead_z", F.col("lead_variant").alias("__lead"), F.col("lead_position").alias("__at"))
    rows = attach(with_z, chosen, keys, "left", stored=True, nulls_match=True)
    return _with_outlier_statistic(rows, signed), leads


def _with_outlier_statistic(rows: DataFrame, signed: bool) -> DataFrame:
    z, r, lead_z = F.col("z"), F.col("r"), F.col("lead_z")
    t = lead_consistency(z, r, lead_z) if signed else lead_consistency_unsigned(z * z, r * r, lead_z * lead_z)
    is_lead = F.coalesce((F.col("variant") == F.col("__lead")) & (F.col("position") == F.col("__at")), F.lit(False))
    return (
        rows.withColumn("t_dentist", t)
        .withColumn("nlog10p_dentist", nlog10p_chi2(F.col("t_dentist")))
        .withColumn("lead_variant", is_lead)
        .drop("__lead", "__at")
    )


# the same two steps with one join by locus, for tables of more loci than can be broadcast


def locus_scores(variants: DataFrame, prior: float = PRIOR_VARIANCE, keys: list[str] = LOCUS) -> tuple[DataFrame, DataFrame]:
    """What :func:`abf_pip` and :func:`dentist_s` need of each locus, and the leads, both stored.

    Only variants whose score may be the largest of their locus are joined with it.
    """
    scored = _with_score(variants, prior).withColumn("z", F.try_divide("beta", "se"))
    totals = settle(_locus_totals(scored, keys))
    highest = above_floor(scored, totals, keys, F.col("score"), F.col("max_score"))
    best = attach(highest, totals.select(*keys, "max_score"), keys, "inner", stored=True, nulls_match=True)
    leads = settle(lead_rows(best, ["z"], "score", "max_score", keys))
    chosen = leads.select(*keys, "lead_z", F.col("lead_variant").alias("__lead"), F.col("lead_position").alias("__at"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return settle(totals.alias("t").join(chosen.alias("c"), same, "left").select("t.*", "c.lead_z", "c.__lead", "c.__at")), leads


def with_scores(
    variants: DataFrame, scores: DataFrame, prior: float = PRIOR_VARIANCE, keys: list[str] = LOCUS, signed: bool = True, above: float | None = None
) -> DataFrame:
    """The columns :func:`abf_pip` and :func:`dentist_s` add, from the loci's stored ``scores`` (:func:`locus_scores`) by one join.

    ``variants`` are some or all of the variants the scores come from. With ``above`` only those whose posterior is greater are
    returned, and most others do not move. If ``scores`` holds ``prediction`` (:func:`with_prediction`), it comes with them.
    """
    rows = _with_score(variants, prior)
    if above is not None:
        least = F.col("__top") + F.log(F.col("__total") * above) - 1e-6  # the posterior itself decides below
        unordered = F.isnan("__top") | F.isnan("__total")
        rows = above_floor(rows, scores, keys, F.col("lbf"), F.when(unordered, float("-inf")).otherwise(least))
    rows = attach(rows, scores, keys, "inner", stored=True, nulls_match=True).withColumn("prob", _posterior())
    if above is not None:
        rows = rows.filter(F.col("prob") > above)
    rows = _with_outlier_statistic(rows.withColumn("z", F.try_divide("beta", "se")), signed)
    added = ["lbf", "score", "max_score", "prob", "z", "lead_z", "t_dentist", "nlog10p_dentist", "lead_variant"]
    added += [c for c in ("prediction",) if c in scores.columns]
    return rows.select(*variants.columns, *[c for c in added if c not in variants.columns])


def with_prediction(scores: DataFrame, predicted: DataFrame, keys: list[str] = LOCUS) -> DataFrame:
    """The loci's scores with their class (:func:`locus_prediction`), stored: one join then brings both to the variants."""
    return settle(scores.join(predicted.select(*keys, "prediction"), keys, "left"))


def external_pips_near(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The external posteriors that rows of the stored table ``wanted`` (``variant``) may meet, stored."""
    return settle(near_keys(table, wanted, ["variant"]))


def is_outlier(r2: Column, nlog10p: Column, r2_threshold: float = R2_THRESHOLD) -> Column:
    return (r2 > r2_threshold) & (nlog10p > OUTLIER_NLOG10P)


def with_external_pips(variants: DataFrame, gwas: DataFrame, eqtl: DataFrame, stored: bool = False) -> DataFrame:
    """Largest external posterior per variant from two sources (one row per variant each)."""
    for name, table in (("max_pip_gwas", gwas), ("max_pip_eqtl", eqtl)):
        variants = attach(
            variants, table.select("variant", F.col("max_pip").alias(name)), ["variant"], "left", stored=stored
        )
    return variants


def with_external_pips_at_once(variants: DataFrame, gwas: DataFrame, eqtl: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The same for wide rows and stored tables: the variants move at most once. Without hot variants, counted in ``like``
    (:func:`attach`), both tables meet them where that shuffle puts them; else the tables are joined to each other first."""
    named = [t.select("variant", F.col("max_pip").alias(n)) for n, t in (("max_pip_gwas", gwas), ("max_pip_eqtl", eqtl))]
    bound = broadcast_bound(variants.sparkSession)
    if all(measured_bytes(t, bound) <= bound for t in named):
        return with_external_pips(variants, gwas, eqtl, stored=True)
    if hot_keys(variants if like is None else like, ["variant"], shuffle_partitions(variants), nulls_match=True).isEmpty():
        return variants.join(named[0], ["variant"], "left").join(named[1], ["variant"], "left")
    return attach(variants, named[0].join(named[1], ["variant"], "full_outer"), ["variant"], "left", like=like)


def locus_external_pips(variants: DataFrame, leads: DataFrame, gwas: DataFrame, eqtl: DataFrame, keys: list[str] = LOCUS) -> DataFrame:
    """External posteriors of each locus: the largest of its credible variants (``cs``, ``cs_99``) and those of its lead.

    Only leads and credible variants meet the external tables, which are stored; all other rows stay where they are, and so do
    external posteriors of other variants.
    """
    credible = variants.filter(F.col("cs") | F.col("cs_99")).select(*keys, "variant", "cs", "cs_99", F.lit(False).alias("__lead"))
    own = leads.select(*keys, F.col("lead_variant").alias("variant"), F.lit(False).alias("cs"), F.lit(False).alias("cs_99"), F.lit(True).alias("__lead"))
    wanted = credible.unionByName(own)
    bound = broadcast_bound(variants.sparkSession)
    if any(measured_bytes(t.select("variant", "max_pip"), bound) > bound for t in (gwas, eqtl)):
        wanted = settle(wanted)  # few rows, which are read twice
        gwas, eqtl = (with_possible_partner(t, wanted, ["variant"], "__maybe").filter("__maybe").drop("__maybe") for t in (gwas, eqtl))
    found = with_external_pips(wanted, gwas, eqtl, stored=True)
    of_lead = [F.max(F.when(F.col("__lead"), F.col(f"max_pip_{s}"))).alias(f"lead_max_pip_{s}") for s in ("gwas", "eqtl")]
    return settle(found.groupBy(*keys).agg(*_credible_maxima(), *of_lead))


def _credible_maxima() -> list[Column]:
    return [
        F.max(F.when(F.col(level), F.col(f"max_pip_{source}"))).alias(f"{level}_max_pip_{source}")
        for source in ("gwas", "eqtl")
        for level in ("cs", "cs_99")
    ]


def locus_summary(variants: DataFrame, leads: DataFrame, keys: list[str] = LOCUS, external: DataFrame | None = None) -> DataFrame:
    """One row per locus. ``leads`` holds the lead variant with its external posteriors
    (``lead_variant, lead_max_pip_gwas, lead_max_pip_eqtl``) and the variants ``max_pip_gwas, max_pip_eqtl``, unless
    ``external`` (:func:`locus_external_pips`) brings all of these.

    Every aggregate keeps a fixed-size buffer, so the whole summary is one hash aggregation. Maxima over
    no rows are NULL, any-tests over no rows are False.
    """
    r2 = F.col("r") * F.col("r")
    linked = r2 > R2_THRESHOLD
    nonsyn = linked & F.col("consequence").isin(labels.NONSYNONYMOUS)
    neff = effective_samples(F.col("n_cases"), F.col("n_samples"))
    any_of = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    summary = variants.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(linked).alias("n_r2"),
        F.count_if(is_outlier(r2, F.col("nlog10p_dentist"))).alias("n_dentist_outlier"),
        F.count_if(nonsyn).alias("n_nonsyn"),
        F.max("prob").alias("max_pip"),
        F.max(F.when(nonsyn, F.col("prob"))).alias("max_pip_nonsyn"),
        any_of(F.when(nonsyn, F.col("cs"))).alias("cs_nonsyn"),
        any_of(F.when(nonsyn, F.col("cs_99"))).alias("cs_99_nonsyn"),
        *([] if external is not None else _credible_maxima()),
        F.min(F.when(linked, neff)).alias("min_neff_r2"),
        F.max(F.when(linked, neff)).alias("max_neff_r2"),
    )
    fraction = F.coalesce(F.try_divide(F.col("n_dentist_outlier").cast("double"), F.col("n_r2")), F.lit(0.0))
    if external is not None:
        same = [F.col(f"v.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        of_credible = [f"{level}_max_pip_{s}" for s in ("gwas", "eqtl") for level in ("cs", "cs_99")]
        summary = summary.alias("v").join(external.alias("c"), same, "left").select("v.*", *[F.col(f"c.{c}") for c in of_credible])
        leads = leads.join(external.select(*keys, "lead_max_pip_gwas", "lead_max_pip_eqtl"), keys, "left")
    # both sides are one row per locus; Spark joins them by size
    return (
        summary.withColumn("fraction", fraction)
        .join(leads.select(*keys, "lead_variant", "lead_max_pip_gwas", "lead_max_pip_eqtl"), keys, "left")
        .withColumnRenamed("lead_variant", "lead_pip_variant")
    )


def nonsyn_in_ld(variants: DataFrame, keys: list[str] = LOCUS) -> DataFrame:
    """Nonsynonymous variants in LD with the lead, one row each: the scalable form of the list column."""
    linked = (F.col("r") * F.col("r") > R2_THRESHOLD) & F.col("consequence").isin(labels.NONSYNONYMOUS)
    return variants.filter(linked).select(*keys, "position", "variant")


def nonsyn_variant_lists(variants: DataFrame, keys: list[str] = LOCUS) -> DataFrame:
    """The same as one comma list per locus in position order, as the published report prints it."""
    listed = F.array_sort(F.collect_list(F.struct("position", "variant")))
    return nonsyn_in_ld(variants, keys).groupBy(*keys).agg(
        F.concat_ws(",", F.transform(listed, lambda x: x["variant"])).alias("nonsyn_variants")
    )


def locus_prediction(summary: DataFrame, dropped: DataFrame) -> DataFrame:
    """Add class, short trait name and bins; remove curated loci (``trait_short, lead_pip_variant``)."""
    pip_bin = right_closed_cut(F.col("max_pip"), [None, 0.1, 0.5, 0.9, 1.0])
    count_bin = right_closed_cut(F.col("n_dentist_outlier"), [None, 0, 10, 100, None])
    pick = lambda index, names: F.get(F.array(*[F.lit(x) for x in names]), index)
    labelled = summary.withColumns(
        {
            "prediction": labels.prediction(F.col("max_pip"), F.col("n_dentist_outlier")),
            "trait_short": before_first(F.col("trait"), "_"),
            "max_pip_bin": pick(pip_bin, ["[0,0.1]", "(0.1,0.5]", "(0.5,0.9]", "(0.9,1]"]),
            "count_bin": pick(count_bin, ["(-Inf,0]", "(0,10]", "(10,100]", "(100, Inf]"]),
        }
    )
    return attach(labelled, dropped, ["trait_short", "lead_pip_variant"], "left_anti", stored=True)


def locus_overview(predicted: DataFrame) -> DataFrame:
    """Loci by prediction and PIP bin for each trait and for all traits, with the class share."""
    cell = ["prediction", "max_pip_bin"]
    both = (
        predicted.groupingSets([["trait_short", *cell], cell], "trait_short", *cell)
        .agg(F.count(F.lit(1)).alias("n_loci"), F.grouping("trait_short").alias("__all"))
        .withColumn("trait_short", F.when(F.col("__all") == 1, "All traits").otherwise(F.col("trait_short")))
        .drop("__all")
    )
    of_class = F.sum("n_loci").over(Window.partitionBy("trait_short", "prediction"))
    of_trait = F.sum("n_loci").over(Window.partitionBy("trait_short"))
    return both.withColumns(
        {"n_class": of_class, "class_share": of_class / of_trait, "n_trait": of_trait}
    )


def trait_order(predicted: DataFrame) -> DataFrame:
    """Traits by number of loci, largest first, with their place in the order."""
    counts = predicted.groupBy("trait_short").agg(F.count_distinct("region").alias("n_loci"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_loci"), "trait_short"))
    return counts.withColumn("place", place)


# --- validation of leads and credible sets ------------------------------------------------------

VALIDATION_TYPES = {"lead": "Lead PIP", "cs": "in 95% CS", "cs_99": "in 99% CS"}


def _validation_flags(predicted: DataFrame) -> DataFrame:
    """One row per locus and evidence kind (nonsynonymous, trait, eQTL) with the three hit tests.

    A credible set without any external value counts as a miss; a lead without one is unknown.
    """
    has_nonsyn = F.col("n_nonsyn") > 0
    missing_false = lambda c: F.coalesce(F.col(c) > 0.9, F.lit(False))
    kind = lambda name, lead, cs, cs_99: F.struct(
        F.lit(name).alias("evidence"), lead.alias("lead"), cs.alias("cs"), cs_99.alias("cs_99")
    )
    kinds = F.array(
        F.when(has_nonsyn, kind("nonsyn", F.col("max_pip") == F.col("max_pip_nonsyn"), F.col("cs_nonsyn"), F.col("cs_99_nonsyn"))),
        kind("gwas", F.col("lead_max_pip_gwas") > 0.9, missing_false("cs_max_pip_gwas"), missing_false("cs_99_max_pip_gwas")),
        kind("eqtl", F.col("lead_max_pip_eqtl") > 0.9, missing_false("cs_max_pip_eqtl"), missing_false("cs_99_max_pip_eqtl")),
    )
    return (
        predicted.filter(F.col("prediction") != "NA")
        .select("prediction", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
        .select("prediction", "k.*")
    )


def validation_counts(predicted: DataFrame) -> DataFrame:
    """Hits, misses and loci by evidence, prediction and test."""
    wide = _validation_flags(predicted).groupBy("evidence", "prediction").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c)).alias(f"{c}_hit") for c in VALIDATION_TYPES],
        *[F.count_if(~F.col(c)).alias(f"{c}_miss") for c in VALIDATION_TYPES],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("type"), F.col(f"{c}_hit").alias("count"), F.col(f"{c}_miss").alias("count2"))
            for c, name in VALIDATION_TYPES.items()
        ]
    )
    return wide.select("evidence", "prediction", "n", F.explode(rows).alias("row")).select(
        "evidence", "prediction", "n", "row.*"
    )


def validation_fraction(predicted: DataFrame) -> DataFrame:
    """Hit share among known loci; its interval uses all loci of the class."""
    lower, upper = binomial_interval(F.col("count"), F.col("n"))
    return validation_counts(predicted).select(
        "evidence", "prediction", "type", "count", "count2",
        F.try_divide(F.col("count").cast("double"), F.col("count") + F.col("count2")).alias("frac"),
        lower.alias("frac_lower"), upper.alias("frac_upper"),
    )


def validation_tables(predicted: DataFrame) -> DataFrame:
    """2x2 table of each evidence and test: SL is the reference row."""
    pick = lambda cls, value: F.sum(F.when(F.col("prediction") == cls, value).otherwise(0))
    known = F.col("count") + F.col("count2")
    return validation_counts(predicted).groupBy("evidence", "type").agg(
        pick("SL", F.col("count")).alias("hits1"), pick("SL", known).alias("total1"),
        pick("NSL", F.col("count")).alias("hits2"), pick("NSL", known).alias("total2"),
    )


def validation_risk_ratio(predicted: DataFrame, p_cut: float = 0.05) -> DataFrame:
    """Risk ratio NSL against SL with Fisher's p and stars, kept when p is below the cut."""
    tables = settle(validation_tables(predicted))
    rr = risk_ratio_columns()["rr"]
    return (
        tables.join(fisher_exact(tables, ["evidence", "type"]), ["evidence", "type"])
        .withColumn("rr", rr)
        .withColumn("stars", significance_stars(F.col("pvalue")))
        .filter(F.col("pvalue") < p_cut)
    )


def validation_risk_ratio_interval(predicted: DataFrame, replicates: int = 5000) -> DataFrame:
    """Bootstrap interval of the same ratios."""
    tables = settle(validation_tables(predicted))
    return tables.withColumn("rr", risk_ratio_columns()["rr"]).join(
        bootstrap_risk_ratio(tables, ["evidence", "type"], replicates), ["evidence", "type"]
    )


def nonsyn_calibration(predicted: DataFrame, studies: DataFrame, strict: bool = False) -> DataFrame:
    """Sweep 0.1 .. 1 by 0.01 over loci of meta-analysed studies: is the lead nonsynonymous?

    ``strict`` takes the columns computed with the stricter nonsynonymous definition (suffix 08).
    """
    suffix = "08" if strict else ""
    kept = attach(
        predicted.withColumn("study", F.col("trait")), studies.withColumnRenamed("study_accession", "study"), ["study"], "left", stored=True
    ).filter("is_meta_analysis")
    usable = kept.withColumn("gamma", F.col("max_pip") == F.col(f"max_pip_nonsyn{suffix}")).filter(
        (F.col(f"n_nonsyn{suffix}") > 0) & (F.col("prediction") != "NA") & F.col("gamma").isNotNull()
    )
    return calibration_sweep(usable, ["prediction"], "max_pip", "gamma", 0.1, 0.01, 91).withColumn(
        "prediction", recode(F.col("prediction"), labels.PREDICTION_NAMES)
    )


def risk_ratio_tables(predicted: DataFrame) -> DataFrame:
    """Wald risk ratio of four events by class against SL: lead nonsynonymous, lead in a trait study,
    lead in an eQTL study, sample-size ratio above 2."""
    tests = F.array(
        F.struct(F.lit("nonsyn").alias("event"), F.when(F.col("n_nonsyn") > 0, F.col("max_pip") == F.col("max_pip_nonsyn")).alias("hit")),
        F.struct(F.lit("gwas").alias("event"), (F.col("lead_max_pip_gwas") > 0.9).alias("hit")),
        F.struct(F.lit("eqtl").alias("event"), (F.col("lead_max_pip_eqtl") > 0.9).alias("hit")),
        F.struct(
            F.lit("neff_ratio").alias("event"),
            F.when(F.col("n_r2") > 1, F.try_divide("max_neff_r2", "min_neff_r2") > 2).alias("hit"),
        ),
    )
    counts = (
        predicted.select("prediction", F.explode(tests).alias("t"))
        .select("prediction", "t.*")
        .filter(F.col("hit").isNotNull())
        .groupBy("event", "prediction")
        .agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    )
    reference = counts.filter(F.col("prediction") == "SL").select(
        "event", F.col("hits").alias("hits1"), F.col("total").alias("total1")
    )
    rows = counts.withColumnsRenamed({"hits": "hits2", "total": "total2"})
    return rows.join(reference, "event", "left").withColumns(risk_ratio_columns())


def outcome_table(predicted: DataFrame) -> DataFrame:
    """Contingency counts of class by lead outcome, the unknown outcome being its own level."""
    return (
        predicted.filter(F.col("n_nonsyn") > 0)
        .groupBy("prediction", (F.col("max_pip") == F.col("max_pip_nonsyn")).alias("count_lead"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sample_size_ratio(predicted: DataFrame) -> DataFrame:
    """Median of max / min effective sample size by class, loci with more than one linked variant."""
    ratios = settle(
        predicted.filter(F.col("n_r2") > 1).select("prediction", F.try_divide("max_neff_r2", "min_neff_r2").alias("ratio"))
    )
    counts = ratios.groupBy("prediction").agg(F.count(F.lit(1)).alias("n_loci"))
    medians = exact_quantiles(ratios, ["prediction"], "ratio", {"median_ratio": 0.5})
    return counts.join(medians, "prediction", "left")


def sample_size_ratio_density(predicted: DataFrame, width: float = 0.5) -> DataFrame:
    """Counts of the ratio in equal bins, by class."""
    ratio = F.try_divide("max_neff_r2", "min_neff_r2")
    return (
        predicted.filter((F.col("prediction") != "NA") & ratio.isNotNull())
        .groupBy("prediction", F.floor(ratio / width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_loci"))
        .withColumn("bin_start", F.col("bin") * width)
    )


def sample_size_ratio_curve(predicted: DataFrame, points: int = 512) -> DataFrame:
    """Kernel density of the ratio by class, at ``points`` places each."""
    ratio = F.try_divide("max_neff_r2", "min_neff_r2").alias("ratio")
    return density(predicted.filter(F.col("prediction") != "NA").select("prediction", ratio), ["prediction"], "ratio", points)


# --- views of variants -------------------------------------------------------------------------


def region_variants(variants: DataFrame) -> DataFrame:
    """Plot columns of variants: chi-square, r2, credible-set recode, outlier flag."""
    z = F.try_divide("beta", "se")
    r2 = F.col("r") * F.col("r")
    return variants.withColumns(
        {
            "chisq": z * z,
            "r2": r2,
            "cs_code": F.when(F.col("cs"), 1).otherwise(-1),
            "outlier": is_outlier(r2, F.col("nlog10p_dentist")),
        }
    )


def ld_span(variants: DataFrame, correlations: dict[str, str], keys: list[str] = LOCUS) -> DataFrame:
    """Positions spanned by variants with r2 above the threshold, per locus and correlation column."""
    linked = {name: F.when(F.col(c) * F.col(c) > R2_THRESHOLD, F.col("position")) for name, c in correlations.items()}
    ends = variants.groupBy(*keys).agg(
        *[F.struct(F.min(at).alias("min_position"), F.max(at).alias("max_position")).alias(f"__{name}") for name, at in linked.items()]
    )
    rows = F.array(*[F.struct(F.lit(name).alias("ld_to"), F.col(f"__{name}").alias("ends")) for name in linked])
    return (
        ends.select(*keys, F.explode(rows).alias("x"))
        .select(*keys, "x.ld_to", "x.ends.*")
        .filter(F.col("min_position").isNotNull())
        .withColumn("span", F.col("max_position") - F.col("min_position"))
    )


def display_window(span: DataFrame, leads: DataFrame, maximum: int, keys: list[str] = LOCUS) -> DataFrame:
    """Window around the lead: the span plus 25 kb, at least 50 kb, at most ``maximum``."""
    half = F.least(F.greatest(F.col("span") + 25000, F.lit(50000)), F.lit(maximum))
    joined = leads.select(*keys, "lead_position").join(span, keys, "inner")
    return joined.withColumns({"start": F.col("lead_position") - half, "end": F.col("lead_position") + half})


def manhattan_points(sumstats: DataFrame, p_cut: float = 1e-3) -> DataFrame:
    """Genome-ordered row number (1-based, by contig then position) of variants below the cut.

    The number counts all variants, so the rows are range-sorted rather than windowed as one group.
    """
    order = [F.col("contig_number"), F.col("position"), F.col("variant"), F.col("p")]
    ranked = rank_within(sumstats.select("contig_number", "position", "variant", "p"), [], order, "__idx")
    return ranked.filter(F.col("p") < p_cut).select(
        "contig_number", "position", "variant", "p",
        (F.col("__idx") + 1).alias("idx"),
        (-F.log10("p")).alias("nlog10p"),
        (F.col("contig_number") % 2).alias("shade"),
    )

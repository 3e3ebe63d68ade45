import os
import random

import pytest
from pyspark.sql import functions as F

from lociary.plans import annotation, cohorts, loci, panels, posteriors, reports, simulation
from lociary.sources import readers, schemas, writers


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """One locus with a third of the rows, one with a Bayes factor far beyond exp's range."""
    rng = random.Random(4)
    data = []
    for i in range(600):
        region = "big" if i % 3 == 0 else f"r{i % 7}"
        z = 70.0 if i == 1 else rng.gauss(0, 3)
        data.append(("t_x", region, f"chr1:{i}:A:G", i, 0.01 * z, 0.01, rng.random() * 0.99))
    return spark.createDataFrame(data, "trait string, region string, variant string, position bigint, beta double, se double, r double").repartition(5)


def test_posteriors_sum_to_one_and_match_window_form(spark, skewed, join_path):
    scored = loci.abf_pip(skewed)
    sums = [r[1] for r in scored.groupBy("region").agg(F.sum("prob")).collect()]
    assert sums == [pytest.approx(1.0, abs=1e-12)] * 8
    # all the mass on the extreme variant, and no overflow
    assert scored.filter("position = 1").first()["prob"] == pytest.approx(1.0)
    again = loci.abf_pip(skewed.repartition(2))
    assert rows(again.withColumn("p", F.round("prob", 12)), "variant", "p") == rows(scored.withColumn("p", F.round("prob", 12)), "variant", "p")


def test_outlier_statistic_uses_the_lead(spark, skewed, join_path):
    out, leads = loci.dentist_s(loci.abf_pip(skewed))
    top = {}
    for r in out.collect():
        if r["region"] not in top or (-r["score"], r["position"]) < top[r["region"]][0]:
            top[r["region"]] = ((-r["score"], r["position"]), r["variant"], r["z"])
    assert rows(leads, "region", "lead_variant", "lead_z") == sorted(((k, v[1], v[2]) for k, v in top.items()), key=repr)
    assert rows(out.filter("lead_variant"), "region", "variant") == sorted((k, v[1]) for k, v in top.items())
    for r in out.collect():
        assert r["t_dentist"] == pytest.approx((r["z"] - r["r"] * top[r["region"]][2]) ** 2 / (1 - r["r"] ** 2))


def test_summary_of_a_locus_without_nonsynonymous_variants(spark):
    df = spark.createDataFrame(
        [("t", "r", "v1", 0.2, 0.9, 9.0, "Missense", False, False, 100, 30, None, None), ("t", "r", "v2", 0.7, 0.1, 9.0, "pLoF", True, True, 100, 30, None, 0.5),
         ("t", "s", "v3", 0.9, 0.2, 1.0, None, True, True, 100, 30, None, None)],
        "trait string, region string, variant string, prob double, r double, nlog10p_dentist double, consequence string, cs boolean, cs_99 boolean, n_samples bigint, n_cases bigint, max_pip_gwas double, max_pip_eqtl double",
    )
    leads = spark.createDataFrame([("t", "r", "v2", None, 0.5), ("t", "s", "v3", None, None)], "trait string, region string, lead_variant string, lead_max_pip_gwas double, lead_max_pip_eqtl double")
    got = {r["region"]: r for r in loci.locus_summary(df, leads).collect()}
    r, s = got["r"], got["s"]
    assert (r["n_total"], r["n_r2"], r["n_dentist_outlier"], r["n_nonsyn"], r["max_pip_nonsyn"], r["cs_nonsyn"]) == (2, 1, 1, 1, 0.2, False)
    assert (r["max_pip"], r["cs_max_pip_eqtl"], r["min_neff_r2"], r["fraction"]) == (0.7, 0.5, pytest.approx(21.0), 1.0)
    # over no rows: NULL maxima, False any-tests, fraction 0
    assert (s["n_r2"], s["max_pip_nonsyn"], s["cs_nonsyn"], s["cs_max_pip_gwas"], s["fraction"], s["min_neff_r2"]) == (0, None, False, None, 0.0, None)


def test_region_summary_success_flags(spark):
    columns = "pheno int, config int, region string, variant string, position bigint, prob double, beta double, se double, nlog10p_dentist double, gamma boolean, lead_variant boolean, cs boolean, cs_99 boolean"
    df = spark.createDataFrame(
        [(1, 1, "chr1:0-100", "a", 1, 0.6, 1.0, 0.5, 1.0, True, True, True, True), (1, 1, "chr1:0-100", "b", 2, 0.6, 1.0, 0.5, 2.0, False, False, True, True),
         (1, 1, "chr1:100-200", "c", 3, 0.1, 1.0, 0.5, None, True, False, False, True), (1, 1, "chr1:100-200", "d", 4, 0.8, 1.0, 0.5, None, False, True, True, True),
         (1, 1, "chr1:200-300", "e", 5, 0.8, 1.0, 0.5, None, False, False, True, True)],
        columns,
    )
    got = rows(simulation.region_summary(df), "region", "gamma", "gamma_variant", "abf_success", "abf_success_cs", "abf_success_cs_99", "lead_z", "start")
    assert got == [
        ("chr1:0-100", True, "a", True, True, True, 2.0, 1),
        ("chr1:100-200", True, "c", False, False, True, 2.0, 100),
        ("chr1:200-300", False, None, False, False, False, None, 200),
    ]


def test_empty_bin_is_null_and_arrays_have_five_places(spark):
    df = spark.createDataFrame(
        [(1, 2, 0.95, True, True, 0.0), (1, 2, 0.95, False, None, 0.5), (1, 2, 0.001, False, None, 0.9), (1, 2, None, True, True, -0.5)],
        "pheno_group int, config_group int, prob double, gamma boolean, gamma_from_region boolean, q double",
    )
    metrics = simulation.calibration_bins(df)
    got = simulation.bins_as_arrays(metrics).first()
    assert got["prob_bins"] == [1, None, None, None, 2] and got["prob_true_bins"] == [None, None, None, None, 1]
    assert got["calibration"] == [None, None, None, None, 0.5] and got["q_true_bins"] == [1, None, None, None, None]
    assert got["Ngamma_region"] == 2


def test_negative_rank_for_rows_without_posterior(spark):
    df = spark.createDataFrame(
        [("g", 1, 1, "c", i, "A", "G", p) for i, p in enumerate([0.1, None, 0.9, None, 0.5])],
        "id string, pheno int, config int, contig string, position bigint, ref string, alt string, prob double",
    )
    got = {r["position"]: r["rank"] for r in simulation.pip_quantile(df).collect()}
    assert (got[2], got[4], got[0]) == (0, 1, 2) and sorted((got[1], got[3])) == [-2, -1]


def test_merge_methods_rules(spark):
    schema = schemas.POSTERIOR_RAW + ", low_purity int"
    s = [("T", "r", "1:10:A:G", 0.50, 0.1, 0.1, 2, 1), ("T", "r", "1:11:A:G", 0.50, 0.1, 0.1, 2, 0), ("T", "r", "1:12:A:G", None, 0.1, 0.1, 1, 0),
         ("T", "r", "1:13:A:G", 0.3, 0.1, 0.1, 1, 0), ("T", "r", "6:25000000:A:G", 0.3, 0.1, 0.1, 1, 0), ("T", "r", "6:36000001:A:G", 0.3, 0.1, 0.1, 1, 0), ("T", "r", "1:14:A:<INS>", 0.3, 0.1, 0.1, 1, 0)]
    f = [("T", "q", "1:10:A:G", 0.52, 0.1, 0.1, 3, 0), ("T", "q", "1:11:A:G", 0.60, 0.1, 0.1, 3, 0), ("T", "q", "1:12:A:G", 0.4, 0.1, 0.1, 3, 0), ("T", "q", "1:15:A:G", 0.7, 0.1, 0.1, 3, 0)]
    build_map = spark.createDataFrame([("1:10:A:G", "chr1:20:A:G")], schemas.BUILD_MAP)
    got = posteriors.merge_posteriors("one", spark.createDataFrame(s, schema), spark.createDataFrame(f, schema), {"T": "Trait"}, "GRCh37", build_map)
    want = {"1:10:A:G": (0.51, -1, "chr1:20:A:G"), "1:11:A:G": (None, 2, None), "1:12:A:G": (0.4, 1, None), "1:13:A:G": (0.3, 1, None), "1:15:A:G": (0.7, None, None), "6:36000001:A:G": (0.3, 1, None)}
    assert {r["variant_b37"]: (r["pip"] and pytest.approx(r["pip"]), r["cs_id"], r["variant"]) for r in got.collect()} == want


def test_optional_columns_become_arrays(spark):
    df = spark.createDataFrame([("T", "r", "1:10:A:G", 0.5, 0.1, 0.1, 1)], schemas.POSTERIOR_RAW)
    alphas = df.withColumns({f"alpha{i}": F.lit(i / 10) for i in range(1, 11)})
    got = posteriors.read_posteriors(alphas, "SUSIE", {"T": "T"}, "GRCh37").first()
    assert got["alpha"] == [i / 10 for i in range(1, 11)] and got["lbf_variable"] is None


def test_panel_sets_with_more_labels_than_one_word_holds(spark):
    labels = [f"A_{i:03d}_P" for i in range(70)]
    data = [("v1", x, 0.3, 0.9) for x in labels] + [("v2", labels[0], 0.3, 0.9), ("v2", labels[69], 0.3, 0.5), ("v2", labels[0], 0.3, 0.9)]
    df = spark.createDataFrame(data, "variant string, label string, freq double, rsq double")
    got = panels.panel_collections(df, "", [0.1], [0.0, 0.6])
    assert rows(got, "rsq", "collection", "n") == sorted(
        [(0.0, ",".join(labels), 1), (0.0, f"{labels[0]},{labels[69]}", 1), (0.6, ",".join(labels), 1), (0.6, labels[0], 1)], key=repr
    )
    assert rows(panels.panel_shared_fraction(got, 70), "rsq", "numer", "denom") == [(0.0, 1, 2), (0.6, 1, 2)]
    with pytest.raises(ValueError):
        panels.panel_collections(df, "other")


def test_worst_consequence_prefers_coding_and_defaults_to_intergenic(spark):
    t = "struct<canonical:int,biotype:string,consequence_terms:array<string>," + ",".join(f"{f}:string" for f in annotation.TRANSCRIPT_FIELDS) + ">"
    tr = lambda canonical, biotype, *terms, name: (canonical, biotype, list(terms), name, *[None] * 8)
    df = spark.createDataFrame(
        [("a", [tr(1, "lncRNA", "stop_gained", name="G1"), tr(1, "protein_coding", "intron_variant", "missense_variant", name="G2"), tr(0, "protein_coding", "stop_lost", name="G3")]),
         ("b", [tr(0, "protein_coding", "stop_gained", name="G4")]), ("c", None)],
        f"site string, transcripts array<{t}>",
    )
    got = rows(annotation.worst_consequence(df), "site", "most_severe", "protein_coding", "gene_most_severe")
    assert got[0] == ("a", "missense_variant", True, "G1")
    assert got[1][1] == got[2][1] == "intergenic_variant" and got[1][3] is None


def test_unknown_build_raises(spark):
    with pytest.raises(ValueError):
        annotation.population_freqs(spark.range(1), "hg17", {})
    with pytest.raises(ValueError):
        readers.read_sites(spark, "hg17", {})


def test_cohort_metadata_shape(spark):
    data = [("T1", "-", "nfe", "B2", 5, 50), ("T1", "-", "nfe", "B1", 7, 70), ("T1", "-", "ami", "B1", 1, 10), ("T1", "Total", "2", "2", 13, 130), ("T2", "-", "eas", "B3", 2, 20)]
    df = spark.createDataFrame(data, "trait string, kind string, ancestry string, biobank string, cases bigint, controls bigint")
    n_loci = spark.createDataFrame([("T1", 4)], "trait string, n_loci bigint")
    got = {r["trait"]: r for r in reports.cohort_metadata(df, n_loci, {"T1": "First"}).collect()}
    assert (got["T1"]["biobanks"], got["T1"]["n_cases_NFE"], got["T1"]["n_cases_MID"], got["T1"]["n_controls_Total"]) == ("B1,B2", 12, 1, 130)
    assert (got["T1"]["description"], got["T1"]["n_loci"], got["T2"]["n_loci"], got["T2"]["n_cases_NFE"]) == ("First", 4, None, None)


def test_text_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t", "NA", 0.5), ("u", None, None)], "trait string, prediction string, x double")
    writers.write_tsv(df, f"{tmp_path}/pheno7.beta.txt")
    lines = spark.read.text(f"{tmp_path}/pheno7.beta.txt").collect()
    assert {r[0] for r in lines} == {"trait\tprediction\tx", "t\tNA\t0.5", "u\tNA\tNA"}
    back = readers.read_tsv(spark, f"{tmp_path}/pheno7.beta.txt", "trait string, prediction string, x string", null_value=None, source="path")
    assert rows(back, "trait", "prediction") == [("t", "NA"), ("u", "NA")]
    assert "pheno7.beta.txt" in back.first()["path"]
    typed = readers.read_tsv(spark, f"{tmp_path}/pheno7.beta.txt", "trait string, prediction string, x double")
    assert rows(typed, "trait", "x") == [("t", 0.5), ("u", None)]
    assert rows(readers.read_tsv_columns(spark, f"{tmp_path}/pheno7.beta.txt", {"x": "value double"}), "value") == [(0.5,), (None,)]


def test_bed_ingest_and_region_read(spark, tmp_path):
    for name in ("dhs", "promoter"):
        with open(tmp_path / f"{name}.bed", "w") as out:
            out.write("chr1\t0\t10\n")
    got = readers.read_bed(spark, f"{tmp_path}/*.bed")
    assert rows(got, "file", "contig", "start", "end") == [("dhs", "chr1", 0, 10), ("promoter", "chr1", 0, 10)]

    variants = spark.createDataFrame([("t", f"r{i % 3}", i) for i in range(30)], "trait string, region string, position bigint")
    path = f"{tmp_path}/variants"
    writers.write_by_locus(variants, path)
    with pytest.raises(Exception):
        writers.write_by_locus(variants, path)
    one = readers.read_region(spark, path, "t", "r1")
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region,r1)" in plan and "PartitionFilters: [isnotnull(trait" in plan

    writers.write_json(variants, f"{tmp_path}/raw")
    stored = writers.ingest(spark, {"j": ("json", f"{tmp_path}/raw"), "p": ("parquet", path)}, f"{tmp_path}/tables", partitions=3)
    assert stored["j"].count() == stored["p"].count() == 30 and os.path.isdir(f"{tmp_path}/tables/j")


def test_sizes_of_every_trait_meet_its_effects(spark):
    effects = spark.createDataFrame(
        [("t", "v1", 0.2, 0.1), ("t", "v2", 0.4, 0.1), ("u", "v1", 0.6, 0.2), ("u", "v2", 0.8, 0.2)], "trait string, variant string, bb_eas_beta double, bb_eas_sebeta double"
    )
    pairs = spark.createDataFrame([(1, "v1", "v2")], "pair_id long, variant1 string, variant2 string")
    sizes = spark.createDataFrame([("t", "-", "eas", "bb", 10, 30), ("u", "-", "eas", "bb", 5, 5)], "trait string, kind string, ancestry string, biobank string, cases long, controls long")
    got = cohorts.cohort_z_pairs(effects, pairs, cohorts.cohort_sizes(sizes))
    assert rows(got, "trait", "pair_id", "variant1_beta", "variant2_beta", "n_case", "n") == [("t", 1, 0.2, 0.4, 10, 40), ("u", 1, 0.6, 0.8, 5, 10)]
    assert rows(cohorts.pooled_neff(got), "trait", "pair_id", "n", "neff") == [("t", 1, 40, 7.5), ("u", 1, 10, 2.5)]


def test_only_leads_and_credible_variants_meet_the_external_tables(spark, join_path):
    rows = [(t, r, f"v{i}", i / 40, i > 30, i > 20) for t, r in (("t", "r1"), ("t", "r2"), ("t", None)) for i in range(40)] + [("t", "r3", None, 0.0, None, None)]
    columns = "trait string, region string, variant string, prob double, cs boolean, cs_99 boolean"
    variants = spark.createDataFrame(rows, columns)
    leads = spark.createDataFrame([("t", "r1", "v39"), ("t", "r2", "v3"), ("t", None, "v1"), ("t", "r3", None)], "trait string, region string, lead_variant string")
    tables = [spark.createDataFrame([(f"v{i}", i * share) for i in range(start, 45, 2)] + [(None, 0.5)], "variant string, max_pip double") for start, share in ((0, 0.01), (1, 0.02))]
    whole = loci.with_external_pips(variants, *tables)
    at_once = loci.with_external_pips_at_once(variants, *tables)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, at_once.select(*whole.columns).collect()))
    for r in loci.locus_external_pips(variants, leads, *tables).collect():
        own = [x for x in whole.collect() if x.region == r.region]
        best = lambda level, source: max((x[source] for x in own if x[level] and x[source] is not None), default=None)
        assert r.cs_max_pip_gwas == best("cs", "max_pip_gwas") and r.cs_99_max_pip_eqtl == best("cs_99", "max_pip_eqtl")
        assert (r.lead_max_pip_gwas, r.lead_max_pip_eqtl) == {"r1": (None, 0.78), "r2": (None, 0.06), None: (None, 0.02), "r3": (None, None)}[r.region]

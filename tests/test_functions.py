import math

import pytest
from pyspark.sql import functions as F

from lociary.functions import bins, labels, stats, text


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_left_closed_bins(spark):
    got = column(spark, [-0.1, 0.0, 0.01, 0.5, 0.9, 1.0, 1.1, None], lambda v: bins.left_closed_bin(v, bins.PIP_BREAKS))
    assert got == [-1, 0, 1, 3, 4, 4, 5, None]
    got = column(spark, [1.0], lambda v: bins.left_closed_bin(v, bins.PIP_BREAKS, include_highest=False))
    assert got == [5]


def test_right_closed_cut(spark):
    got = column(spark, [0.0, 0.01, 0.010001, 1.0, 1.1, None], lambda v: bins.right_closed_cut(v, bins.PIP_BREAKS))
    assert got == [None, 0, 1, 4, None, None]
    got = column(spark, [-5.0, 0.0, 7.0, None], lambda v: bins.right_closed_cut(v, [None, 0, 10, None]))
    assert got == [0, 0, 1, None]


def test_uniform_bins(spark):
    got = column(spark, [-1.0, 0.0, 0.1, 0.1000001, 1.0, 2.0, None], lambda v: bins.uniform_bin(v, 0.0, 1.0, 10, 0.1))
    assert got == [-1, 0, 0, 1, 9, 10, None]


def test_threshold_index_counts_edges_strictly_below(spark):
    values = [0.0, 0.01, 0.02, 0.29, 0.57, 0.58, 0.999, 1.0, 0.010000001]
    edges = [0.01 + k * 0.01 for k in range(100)]
    got = column(spark, values, lambda v: bins.threshold_index(v, 0.01, 0.01, 100))
    assert got == [sum(e < v for e in edges) for v in values]


def test_variant_and_region_text(spark):
    v = text.variant_parts(F.lit("chr7:123:A:<DEL>"), strip_chr=True)
    assert one(spark, **v) == {"contig": "7", "position": 123, "ref": "A", "alt": "<DEL>"}
    assert one(spark, **text.variant_parts(F.lit("7:x")))["position"] is None
    assert one(spark, **text.region_parts(F.lit("chr1:0-50"))) == {"contig": "chr1", "start": 1, "end": 50}
    assert one(spark, a=text.before_first(F.lit("AB_c_d"), "_"), b=text.before_first(F.lit("AB"), "_")) == {"a": "AB", "b": "AB"}
    assert one(spark, a=text.token(F.lit("x.y.z"), ".", 1), b=text.token(F.lit("x"), ".", 1)) == {"a": "y", "b": None}
    assert one(spark, a=text.parse_number_array(F.lit("[1.5,null,2]")))["a"] == [1.5, None, 2.0]
    assert one(spark, a=text.level_rank(F.lit("NSL"), labels.PREDICTION_LEVELS), b=text.level_rank(F.lit("?"), ["x"])) == {"a": 2, "b": None}
    assert one(spark, a=text.percent_label(F.lit(0.256)))["a"] == "26%"


def test_unmapped_value_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    with pytest.raises(Exception, match="no mapping for value b"):
        df.select(text.map_values(F.col("t"), {"a": "x"})).collect()
    assert [r[0] for r in df.select(text.recode(F.col("t"), {"a": "x"})).collect()] == ["x", "b"]


def test_chi2_tail_matches_erfc_and_does_not_underflow(spark):
    values = [0.0, 0.5, 3.84, 29.716785, 700.0, 1300.0]
    got = column(spark, values, stats.nlog10p_chi2)
    for v, g in zip(values, got):
        if v < 1000:
            assert g == pytest.approx(-math.log10(math.erfc(math.sqrt(v / 2))), abs=1e-6)
    assert column(spark, [5000.0], stats.nlog10p_chi2)[0] == pytest.approx(1087.68, abs=0.01)


def test_lead_consistency_is_null_at_full_correlation(spark):
    assert one(spark, t=stats.lead_consistency(F.lit(3.0), F.lit(1.0), F.lit(5.0)))["t"] is None


def test_wilson_interval(spark):
    lo, hi = stats.binomial_interval(F.lit(5), F.lit(10))
    got = one(spark, lo=lo, hi=hi)
    assert got["lo"] == pytest.approx(0.236593, abs=1e-6) and got["hi"] == pytest.approx(0.763407, abs=1e-6)
    lo, hi = stats.binomial_interval(F.lit(1), F.lit(10))
    assert one(spark, lo=lo)["lo"] == pytest.approx(-math.log(0.95) / 10)
    lo, hi = stats.binomial_interval(F.lit(9), F.lit(10))
    assert one(spark, hi=hi)["hi"] == pytest.approx(1 + math.log(0.95) / 10)
    lo, hi = stats.binomial_interval(F.lit(0), F.lit(0))
    assert one(spark, lo=lo, hi=hi) == {"lo": None, "hi": None}


def test_critical_sample_size_forms_agree_and_stop_the_fall(spark):
    args = (F.lit(0.02), F.lit(0.04), F.lit(1.0))
    got = one(spark, a=stats.critical_sample_size(*args), b=stats.critical_sample_size_ratio_form(*args))
    assert got["a"] == pytest.approx(got["b"], rel=1e-9)
    bf = lambda n: one(spark, x=stats.log10_bayes_factor(F.lit(float(n)), *args))["x"]
    assert bf(got["a"]) < bf(got["a"] * 0.9) and bf(got["a"]) < bf(got["a"] * 1.1)


def test_log_factorial(spark):
    got = column(spark, [0, 1, 20, 21, 170, 100000], stats.log_factorial, "bigint")
    assert got == pytest.approx([math.lgamma(n + 1) for n in (0, 1, 20, 21, 170, 100000)], rel=1e-12)


def test_stars_and_prediction(spark):
    assert column(spark, [0.00005, 0.001, 0.02, 0.05, 0.5], stats.significance_stars) == ["****", "***", "*", "*", "ns"]
    df = spark.createDataFrame([(0.05, 3), (0.1, 1), (0.9, 0)], "p double, n int")
    assert [r[0] for r in df.select(labels.prediction(F.col("p"), F.col("n"))).collect()] == ["NA", "SL", "NSL"]


def test_config_bands(spark):
    got = column(spark, [12, 13, 17, 18, 27, 42, 43], labels.config_group, "int")
    assert got == [12, 1317, 1317, 1822, 2327, 3842, 43]


def test_annotation_class_first_match_wins(spark):
    rows = [
        ("intron_variant", "HC", 0, 0, 0), ("intron_variant", "LC", 1, 0, 0), ("synonymous_variant", None, 1, 1, 1),
        ("3_prime_UTR_variant", None, 1, 0, 0), ("intron_variant", None, 1, 1, 1), ("intron_variant", None, 0, 1, 1),
        ("intron_variant", None, 0, 1, 0), ("missense_variant", None, 0, 0, 0), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "term string, lof string, p int, d int, h int")
    c = F.col
    got = df.select(labels.annotation_class(c("term"), labels.consequence_category(c("term")), c("lof"), c("p"), c("d"), [c("h"), F.lit(0)]))
    assert [r[0] for r in got.collect()] == [
        "pLoF", "Missense", "Synonymous", "UTR3", "Promoter", "CRE", "Non-genic", "Missense", "Non-genic",
    ]

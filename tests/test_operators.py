import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lociary.operators import contingency, keyed, ordered, roc
from lociary.operators.intervals import interval_flags, points_in_intervals
from lociary.operators.sweep import calibration_sweep


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_matches_plain_join_with_a_hot_key_copies_and_nulls(spark, join_path, how):
    # a third of all rows share one key and are exact copies; some keys are NULL or unknown
    data = [("hot", 7)] * 300 + [(f"k{i % 40}", i) for i in range(550)] + [(None, 1)] * 50
    left = spark.createDataFrame(data, "k string, v int").repartition(4)
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, w int")
    got = keyed.attach(left, right, ["k"], how)
    want = left.join(right, "k", how)
    assert got.columns == want.columns and rows(got, *got.columns) == rows(want, *want.columns)


def test_rows_without_a_partner_do_not_move(spark, join_path, monkeypatch):
    data = [(f"k{i}", i % 3, i) for i in range(5000)] * 2 + [(None, 1, 1), ("k5", None, 5)] * 3
    left = spark.createDataFrame(data, "k string, j int, v int").repartition(4)
    right = spark.createDataFrame([(f"k{i}", i % 3, i) for i in range(0, 5400, 90)] + [("k90", 0, 91), (None, 1, 7)], "k string, j int, w int")
    moved = []
    join = keyed.salted_join
    monkeypatch.setattr(keyed, "salted_join", lambda rows, *more: moved.append(rows.count()) or join(rows, *more))
    got = keyed.attach_few(left, right, ["k", "j"])
    want = left.join(right, ["k", "j"], "left")
    assert got.columns == want.columns and rows(got, *got.columns) == rows(want, *want.columns)
    assert (not moved if join_path == "broadcast" else 112 <= moved[0] < 300)
    near = keyed.near_partners(left, right, ["k", "j"])
    met = rows(left.join(right, ["k", "j"], "left_semi"), *left.columns)
    assert rows(near.join(right, ["k", "j"], "left_semi"), *left.columns) == met and len(met) <= near.count() < 300
    none = right.limit(0)
    assert keyed.attach_few(left, none, ["k", "j"]).count() == len(data) and keyed.near_partners(left, none, ["k", "j"]).count() == 0


def test_hot_key_is_sliced_and_slices_are_bounded(spark):
    spark.conf.set(keyed.HOT_SAMPLE_CONF, "1.0")
    df = spark.createDataFrame([("hot",)] * 500 + [(f"k{i}",) for i in range(500)], "k string")
    hot = {r["k"]: r["__slices"] for r in keyed.hot_keys(df, ["k"], 100).collect()}
    spark.conf.unset(keyed.HOT_SAMPLE_CONF)
    assert hot["hot"] == 50 and sum(hot.values()) <= 200


def test_settle_keeps_rows_and_measures(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, n bigint")
    stored, size = keyed._settle_measured(df)
    assert rows(stored, "s", "n") == rows(df, "s", "n") and size == keyed.measured_bytes(df)
    empty, size = keyed._settle_measured(df.filter("n > 5"))
    assert empty.count() == 0 and size == 0


def test_attach_empty_table(spark, join_path):
    left = spark.createDataFrame([("a", 1)], "k string, v int")
    right = spark.createDataFrame([], "k string, w int")
    assert rows(keyed.attach(left, right, ["k"], "left"), "k", "w") == [("a", None)]
    assert keyed.attach(left, right, ["k"], "left_anti").count() == 1


def test_shared_folder_is_read_from_the_session(spark):
    assert keyed.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        keyed.shared_folder(Session())


def test_null_keys_can_match(spark, join_path):
    left = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    got = keyed.attach(left, right, ["k"], "inner", nulls_match=True)
    assert rows(got, "v", "w") == [(1, 10), (2, 20), (3, 20)]
    assert rows(keyed.attach(left, right, ["k"], "inner"), "v", "w") == [(1, 10)]


def test_rank_within_one_huge_group(spark, join_path):
    rng = random.Random(3)
    data = [("big" if i % 3 else f"g{i % 5}", rng.randint(0, 20), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(5)
    got = {r["i"]: r["rank"] for r in ordered.rank_within(df, ["g"], [F.desc("v"), F.col("i")], "rank").collect()}
    for g in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))
        assert [got[d[2]] for d in mine] == list(range(len(mine)))


def test_running_totals_and_quantiles(spark):
    data = [("a", i, i % 7) for i in range(500)] + [("b", i, 1) for i in range(10)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(6)
    got = {(r["g"], r["i"]): r["t"] for r in ordered.running_totals(df, ["g"], [F.col("i")], {"t": "v"}).collect()}
    for g, n in (("a", 500), ("b", 10)):
        sums = list(itertools.accumulate(v for h, _, v in data if h == g))
        assert [got[(g, i)] for i in range(n)] == sums
    q = ordered.exact_quantiles(df, ["g"], "i", {"m": 0.5, "q": 0.1})
    want = df.groupBy("g").agg(F.percentile("i", F.lit(0.5)).alias("m"), F.percentile("i", F.lit(0.1)).alias("q"))
    assert rows(q, "g", "m", "q") == [(g, pytest.approx(m), pytest.approx(x)) for g, m, x in rows(want, "g", "m", "q")]


@pytest.mark.parametrize("spread", ["ties", "distinct"])
def test_top_fractions(spark, spread):
    n = 1000
    score = (lambda i: 0.0 if i % 3 else (i % 50) / 50) if spread == "ties" else (lambda i: i / n)
    df = spark.createDataFrame([("p", score(i), i) for i in range(n)], "g string, s double, i int").repartition(4)
    got = ordered.top_fractions(df, ["g"], "s", [F.col("i")], [0.9, 0.995])
    down = sorted(((score(i), i) for i in range(n)), key=lambda x: (-x[0], x[1]))
    want = [(f, i) for f in (0.9, 0.995) for k, (_, i) in enumerate(down) if (n - k) / n > f]
    assert rows(got, "fraction", "i") == sorted(want, key=repr)


def test_points_in_intervals_equals_plain_range_join(spark, join_path):
    rng = random.Random(5)
    points = spark.createDataFrame([(rng.choice("ab"), rng.randint(1, 5000), i) for i in range(400)], "k string, position bigint, i int")
    spans = spark.createDataFrame(
        [(rng.choice("ab"), s, s + rng.choice([0, 1, 50, 3000]), j) for j, s in enumerate(rng.randint(1, 5000) for _ in range(60))],
        "k string, start bigint, end bigint, j int",
    )
    got = points_in_intervals(points, spans, ["k"], width=700)
    p, s = points.alias("p"), spans.alias("s")
    want = p.join(s, (F.col("p.k") == F.col("s.k")) & (F.col("start") <= F.col("position")) & (F.col("position") < F.col("end")))
    assert rows(got, "i", "j") == rows(want, "i", "j")


def test_interval_flags_with_nested_touching_equal_and_empty_intervals(spark, join_path):
    spans = [("x", "c1", 0, 10), ("x", "c1", 2, 5), ("x", "c1", 10, 12), ("x", "c1", 20, 20), ("x", "c2", 100, 40000),
             ("y", "c1", 5, 11), ("y", "c1", 5, 11), ("y", "c1", 30, 31)]
    df = spark.createDataFrame(spans, "file string, contig string, start bigint, end bigint")
    at = [("c1", p) for p in (1, 2, 5, 6, 10, 11, 12, 13, 20, 21, 30, 31, 32)] + [("c2", p) for p in (100, 101, 9999, 20001, 40000, 40001)] + [("c3", 1)]
    points = spark.createDataFrame(at, "contig string, position bigint")
    got = interval_flags(points, df, ["x", "y"], width=100)
    hit = lambda f, c, p: int(any(a == f and b == c and s < p <= e for a, b, s, e in spans))
    assert rows(got, "contig", "position", "x", "y") == sorted(((c, p, hit("x", c, p), hit("y", c, p)) for c, p in at), key=repr)


def test_sweep_equals_a_filter_per_threshold(spark):
    rng = random.Random(1)
    data = [("a" if rng.random() < 0.3 else "b", round(rng.random(), 2), rng.random() < 0.4) for _ in range(300)]
    got = calibration_sweep(spark.createDataFrame(data, "g string, p double, t boolean"), ["g"], "p", "t", 0.01, 0.01, 100)
    seen = {(r["g"], r["threshold"]): (r["count"], r["calibration"], r["mean_prob"]) for r in got.collect()}
    expected = {}
    for g in "ab":
        for k in range(100):
            kept = [d for d in data if d[0] == g and d[1] > 0.01 + k * 0.01]
            if kept:
                expected[(g, round(0.01 + k * 0.01, 9))] = (
                    len(kept), sum(d[2] for d in kept) / len(kept), pytest.approx(sum(d[1] for d in kept) / len(kept))
                )
    assert seen == expected


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_brute_force(spark, strict):
    rng = random.Random(4)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    place = lambda: rng.choice([None, *range(12)])
    left = [(key(), place(), k) for k in range(300)] + [("only rows", 3, 300)]
    right = [(key(), place(), rng.randrange(5), "x") for _ in range(60)] + [("only table", 1, 1, "x")]
    found = ordered.asof_join(
        spark.createDataFrame(left, "k string, at int, id int").repartition(7), spark.createDataFrame(right, "k string, at int, v int, w string"), ["k"], "at", ["v", "w"], strict=strict
    )
    assert found.columns == ["k", "at", "id", "v", "w"]
    for r in found.collect():
        before = [(a, v, w) for k, a, v, w in right if k == r["k"] and None not in (a, r["at"]) and (a < r["at"] or (a == r["at"] and not strict))]
        assert (r["v"], r["w"]) == (max(before)[1:] if before else (None, None))
    assert found.count() == 301


def test_roc_against_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.random() < 0.5, rng.randint(0, 6)) for _ in range(200)]
    df = spark.createDataFrame([("t", s, c) for s, c in data], "g string, success boolean, count int")
    counts = roc.score_counts(df, ["g"], "success", "count")
    bad, good = [c for s, c in data if not s], [c for s, c in data if s]
    wins = sum((a > b) + (a == b) / 2 for a in bad for b in good) / len(bad) / len(good)
    assert roc.roc_auc(counts, ["g"]).first()["roc_auc"] == pytest.approx(wins)
    curve = {r["threshold"]: (r["sensitivity"], r["specificity"]) for r in roc.roc_curve(counts, ["g"]).collect()}
    assert curve[-math.inf] == (1.0, 0.0) and curve[math.inf] == (0.0, 1.0)
    for t in set(c for _, c in data):
        assert curve[float(t)] == (sum(c >= t for c in bad) / len(bad), sum(c < t for c in good) / len(good))
    at = roc.confusion_at(counts, ["g"], 3).first()
    called = sum(c >= 3 for c in bad)
    assert at["sensitivity"] == called / len(bad) and at["precision"] == called / (called + sum(c >= 3 for c in good))


def test_auc_is_null_with_one_class(spark):
    df = spark.createDataFrame([("t", True, 1), ("t", True, 2)], "g string, success boolean, count int")
    assert roc.roc_auc(roc.score_counts(df, ["g"], "success", "count"), ["g"]).first()["roc_auc"] is None


def exact_fisher(h1, n1, h2, n2):
    total, marked = n1 + n2, h1 + h2
    pmf = lambda k: math.comb(marked, k) * math.comb(total - marked, n2 - k) / math.comb(total, n2)
    return sum(p for k in range(max(0, n2 + marked - total), min(n2, marked) + 1) if (p := pmf(k)) <= pmf(h2) * (1 + 1e-7))


def test_fisher_and_risk_ratio(spark):
    tables = [(1, 10, 8, 12), (0, 5, 5, 5), (30, 100, 29, 100), (3, 4000, 20, 9000)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, hits1 bigint, total1 bigint, hits2 bigint, total2 bigint")
    got = {r["i"]: r["pvalue"] for r in contingency.fisher_exact(df, ["i"]).collect()}
    for i, t in enumerate(tables):
        assert got[i] == pytest.approx(exact_fisher(*t), rel=1e-8)
    rr = {r["i"]: (r["rr"], r["rr_lower"]) for r in df.withColumns(contingency.risk_ratio_columns()).collect()}
    assert rr[0][0] == pytest.approx((8 / 12) / (1 / 10)) and rr[1] == (None, None)


def test_bootstrap_lays_out_every_possible_count_and_no_more(spark):
    cases = [(1, 0.5), (30, 0.01), (5_000, 0.4), (5_000, 0.0002), (100_000, 0.003), (2_000_000_000, 0.3)]
    df = spark.createDataFrame(cases, "n long, p double")
    for n, p, first, last in df.select("n", "p", *contingency._support(F.col("n"), F.col("p"))).collect():
        pmf = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
        assert (first == 0 or pmf(first - 1) == 0) and (last == n or pmf(last + 1) == 0)
    assert last - first < 5_000_000
    sides = spark.createDataFrame([("x", 600_000_000, 2_000_000_000, 650_000_000, 2_000_000_000)], "k string, hits1 long, total1 long, hits2 long, total2 long")
    (_, lower, upper), = contingency.bootstrap_risk_ratio(sides, ["k"], 400).collect()
    assert lower == pytest.approx(13 / 12 * math.exp(-1.96 * 4.7e-5), rel=2e-5) and upper == pytest.approx(13 / 12 * math.exp(1.96 * 4.7e-5), rel=2e-5)


def test_bootstrap_interval_is_repeatable_and_brackets_the_ratio(spark):
    df = spark.createDataFrame([("a", 20, 100, 45, 100), ("b", 3000, 10000, 3600, 10000)], "k string, hits1 bigint, total1 bigint, hits2 bigint, total2 bigint")
    first = rows(contingency.bootstrap_risk_ratio(df, ["k"], 2000), "k", "rr_lower", "rr_upper")
    again = rows(contingency.bootstrap_risk_ratio(df.repartition(3), ["k"], 2000), "k", "rr_lower", "rr_upper")
    assert first == again
    for (k, lo, hi), (rr, se) in zip(first, ((2.25, math.sqrt(1 / 20 - 1 / 100 + 1 / 45 - 1 / 100)), (1.2, math.sqrt(7 / 3 / 10000 + 64 / 36 / 10000)))):
        assert lo < rr < hi
        assert math.log(hi / lo) == pytest.approx(2 * 1.96 * se, rel=0.15)


@pytest.mark.parametrize("n, hits", [(3, 1), (700, 350), (5000, 7), (5000, 4990)])
def test_binomial_draws_invert_the_exact_distribution(spark, n, hits):
    p = hits / n
    uniforms = [(k + 0.5) / 97 for k in range(97)] + [1e-9, 1 - 1e-9]
    sides = spark.createDataFrame([("a", "1", n, p)], "k string, side string, n long, p double")
    draws = spark.createDataFrame([("a", "1", b, u) for b, u in enumerate(uniforms)], "k string, side string, b int, u double")
    got = {r["b"]: r["x"] for r in contingency._binomial_draws(sides, ["k"], draws).collect()}
    cumulative, total = [], 0.0
    for i in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))
        cumulative.append(total)
    for b, u in enumerate(uniforms):
        assert got[b] == next((i for i, c in enumerate(cumulative) if c >= u * total), n)

"""Steps at size: rows that meet nothing stay, joins are not run twice to find hot keys, wide intervals cost no more than narrow ones."""

import pytest
from pyspark.sql import functions as F

from lociary.operators import intervals, keyed
from lociary.plans import loci, posteriors
from lociary.testbed import bridge, registry
from test_column_use import folder, rows  # noqa: F401


@pytest.fixture
def beyond_bound(spark, monkeypatch):
    """Tables beyond the broadcast bound, with room for the bits of the tests' few keys."""
    spark.conf.set(keyed.BROADCAST_BYTES_CONF, "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset(keyed.BROADCAST_BYTES_CONF)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [False, True])
def test_completing_equals_a_full_outer_join(spark, join_path, hot):
    data = [("hot", 1, i) for i in range(600 * hot)] + [(f"k{i}", i % 3, i) for i in range(900)] * 2 + [(None, 1, 1), ("k5", None, 5), (None, None, 2)]
    left = spark.createDataFrame(data, "k string, j int, v int").repartition(4)
    right = spark.createDataFrame([("hot", 1, 9), ("k90", 0, 1), ("k90", 0, 2), ("k3", 2, 3), ("new", 1, 4), (None, 1, 5), ("k5", None, 6)], "k string, j int, w int")
    got = keyed.complete_few(left, keyed.settle(right), ["k", "j"])
    want = left.join(right, ["k", "j"], "full_outer")
    assert rows(got, want.columns) == rows(want, want.columns)
    assert keyed.complete_few(left, keyed.settle(right.limit(0)), ["k", "j"]).count() == len(data)


@pytest.mark.parametrize("step", ["sim_frac", "sim_candidates", "sim_leads", "delta"])
def test_hot_keys_are_found_before_the_joins(spark, folder, beyond_bound, monkeypatch, step):  # noqa: F811
    for earlier in (registry.sim_regions, registry.sim_causal, registry.predicted, registry.locus_scores):
        earlier(spark, folder)
    counted = []
    hot_keys = keyed.hot_keys
    found = lambda r, *more, **named: counted.append(plan(r)) or hot_keys(r, *more, **named)
    monkeypatch.setattr(keyed, "hot_keys", found)
    monkeypatch.setattr(loci, "hot_keys", found)
    getattr(registry, step).compute(spark, folder)
    assert counted and not any("Join" in p for p in counted)


def test_completed_variants_are_read_twice(spark, folder, beyond_bound):  # noqa: F811
    assert plan(registry.sim_complete(spark, folder, "prob")).count("Relation [l_orderkey") == 2


def test_class_and_scores_come_from_one_join(spark, folder, join_path):  # noqa: F811
    predicted = registry.predicted(spark, folder)
    scored, _ = registry.scored_variants(spark, folder)
    want = keyed.attach(scored, predicted.select("trait", "region", "prediction"), ["trait", "region"], "left")
    scores = loci.with_prediction(registry.locus_scores(spark, folder)[0], predicted)
    got = registry.with_credible(loci.with_scores(registry.sum_stats(spark, folder), scores))
    columns = ["trait", "region", "variant", "position", "prediction", "cs", "lead_variant"]
    assert rows(got, columns) == rows(want, columns)


def test_wide_intervals_are_listed_twice_at_most(spark, join_path, monkeypatch):
    spans = spark.createDataFrame(
        [("a", 10**k + 7, 10**k + 7 + 3 * 10**j) for k in range(2, 9) for j in range(0, 9)] + [("a", 5, 5), ("a", 9, 3), ("a", None, 4), ("b", 0, 4000), (None, 0, 9)], "k string, start long, end long"
    )
    points = spark.createDataFrame([("a", p) for k in range(1, 10) for p in (10**k, 10**k + 7, 4 * 10**k + 6)] + [("b", 3999), ("b", 4000), ("a", None), (None, 3)], "k string, position long")
    listed = []
    attach = intervals.attach
    monkeypatch.setattr(intervals, "attach", lambda r, t, *more, **named: listed.append((r.count(), t.count())) or attach(r, t, *more, **named))
    got = intervals.points_in_intervals(points, spans, ["k"], width=1000)
    inside = (F.col("p.k") == F.col("s.k")) & (F.col("start") <= F.col("position")) & (F.col("position") < F.col("end"))
    want = points.alias("p").join(spans.alias("s"), inside).select("p.k", "position", "start", "end")
    assert rows(got, want.columns) == rows(want, want.columns) and want.count()
    assert listed[0][1] <= 2 * spans.count() and listed[0][0] <= 12 * points.count()


def test_labels_do_not_store_the_scored_variants(spark, folder):  # noqa: F811
    registry._STAGED.clear()
    registry.QUERIES["cs_merge_labels"](spark, folder)
    assert {key[2] for key in registry._STAGED} == {"locus_scores"}


def test_cohort_rows_of_other_variants_do_not_meet_the_leads(spark, folder, join_path, monkeypatch):  # noqa: F811
    given = registry.named_posteriors(spark, folder)
    leads = given.select("trait", "variant_b37").distinct().orderBy("variant_b37").limit(6)
    sizes = posteriors.cs_size(given)
    want = given.join(leads, ["variant_b37", "trait"]).join(sizes, ["trait", "cohort", "region", "cs_id"], "left")
    met = []
    attach = posteriors.attach
    monkeypatch.setattr(posteriors, "attach", lambda r, *more, **named: met.append(r.count()) or attach(r, *more, **named))
    got = posteriors.lead_cs_size(given, leads)
    assert rows(got, got.columns) == rows(want, got.columns) and got.count()
    assert met[0] < given.count() / 4


def test_set_sizes_compare_only_variants_with_one(spark, folder, join_path, monkeypatch):  # noqa: F811
    sizes = registry.merged_lead_sizes(spark, folder)
    leads = registry.delta_leads(registry.delta.compute(spark, folder))
    whole = posteriors.lead_cs_size(registry.named_posteriors(spark, folder), leads)
    assert rows(sizes, whole.columns) == rows(whole, whole.columns)
    want = posteriors.cs_size_comparison(posteriors.cs_size_rows(registry.delta.compute(spark, folder), whole))
    met = []
    pip_delta = posteriors.pip_delta
    monkeypatch.setattr(posteriors, "pip_delta", lambda v, *more, **named: met.append(v.count()) or pip_delta(v, *more, **named))
    got = registry.QUERIES["cs_size_comparison"](spark, folder)
    assert rows(got, got.columns) == rows(registry.r6(want, "mean", "median"), got.columns)
    assert len(met) == 1 and met[0] < bridge.domain(spark, folder, "sumstats").count()

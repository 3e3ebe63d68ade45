"""Counts of credible variants: variants and cohort rows in no credible set do not move, and the counts are those of all rows."""

import pytest
from pyspark.sql import functions as F

from lociary.operators import keyed
from lociary.plans import loci, posteriors
from lociary.testbed import bridge, registry
from test_column_use import folder, rows  # noqa: F401


def _variants(spark):
    data = [
        (t, f"r{i % 40}" if i % 97 else None, f"v{i}", i, (i * 7 % 23 - 11) / 10 * (i % 40 % 5), 0.1 + i % 7 / 50, (i % 19 - 9) / 10)
        for i in range(2000) for t in ("A_x", "B_x")
    ]
    data += data[:50] + [("A_x", "r1", "none", 5, None, 0.1, 0.5), ("B_x", "none", "n1", 5, 0.1, 0.0, 0.5), (None, "r2", None, None, 0.3, 0.1, None)]
    data += [("A_x", "nan", f"i{i}", i, float("nan") if i == 3 else 0.1, 0.1, 0.5) for i in range(6)]
    return spark.createDataFrame(data, "trait string, region string, variant string, position long, beta double, se double, r double")


def test_one_join_by_locus_gives_the_same_scores(spark, join_path):
    variants = _variants(spark)
    whole, leads = loci.dentist_s(loci.abf_pip(variants))
    scores, own_leads = loci.locus_scores(variants)
    once = loci.with_scores(variants, scores)
    assert once.columns == whole.columns and own_leads.columns == leads.columns
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in whole.dtypes]
    assert rows(once.select(rounded), whole.columns) == rows(whole.select(rounded), whole.columns)
    assert rows(own_leads, leads.columns) == rows(leads, leads.columns)
    for cut in (0.01, 0.1):
        above = loci.with_scores(variants, scores, above=cut)
        assert rows(above, above.columns) == rows(once.filter(F.col("prob") > cut), above.columns) and above.count()


def test_few_variants_meet_the_loci(spark, join_path, monkeypatch):
    variants, met = _variants(spark), []
    scores, _ = loci.locus_scores(variants)
    attach = loci.attach
    monkeypatch.setattr(loci, "attach", lambda r, *more, **named: met.append(r.count()) or attach(r, *more, **named))
    found = loci.with_scores(variants, scores, above=0.1).count()
    assert found <= met[0] < variants.count() / 4


def test_near_keys_are_found_before_the_grouping(spark, join_path):
    table = keyed.settle(spark.range(20).selectExpr("concat('k', id) AS k"))
    given = spark.range(4000).selectExpr("concat('k', id % 1000) AS k", "id AS x").unionByName(spark.createDataFrame([(None, 1)], "k string, x long"))
    near = keyed.near_keys(given.groupBy("k").agg(F.max("x").alias("x")), table, ["k"])
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")
    assert {r["k"]: r["x"] for r in near.collect() if int(r["k"][1:]) < 20} == {f"k{i}": 3000 + i for i in range(20)}
    assert near.count() < 60


def test_joins_without_hot_keys_share_their_shuffle(spark):
    left = spark.range(3000).selectExpr("id % 1000 AS k", "id AS x")
    right = spark.range(1000).selectExpr("id AS k", "id * 2 AS y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = keyed.salted_join(keyed.salted_join(left, right, ["k"], "inner"), right.withColumnRenamed("y", "z"), ["k"], "inner")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert joined.filter("y = 2 * k AND z = y").count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_counts_of_credible_rows(spark, folder, join_path, monkeypatch):  # noqa: F811
    columns = ("consequence", "cs", "any_cs")
    whole = registry.delta.compute(spark, folder, *columns)
    moved = []
    pip_delta = posteriors.pip_delta
    monkeypatch.setattr(posteriors, "pip_delta", lambda v, p, c, *more, **named: moved.append((v.count(), c.count())) or pip_delta(v, p, c, *more, **named))
    few = registry.delta.compute(spark, folder, *columns, credible=True)
    assert few.columns == whole.columns
    assert rows(few.filter("cs OR any_cs"), few.columns) == rows(whole.filter("cs OR any_cs"), few.columns)
    counts = posteriors.nonsyn_cs_counts(few).first()
    assert counts == posteriors.nonsyn_cs_counts(whole).first() == registry.QUERIES["nonsyn_cs_counts"](spark, folder).first()
    assert counts["n_cs"] and counts["n_cs_any"]
    assert moved[0][0] < bridge.domain(spark, folder, "sumstats").count() and moved[0][1] < registry.pip_wide(spark, folder).count()

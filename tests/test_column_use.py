"""Steps carry only the columns that a later step reads, and give the same rows as with all of them."""

import datetime

import pytest
from pyspark.sql import functions as F

from lociary.plans import loci
from lociary.operators.keyed import shared_folder
from lociary.testbed import bridge, registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    lines = [
        (o, p, 1 + (o * 7 + p) % 40, n, float(1 + (o * 11 + n * 5) % 50), (o + n) % 11 / 100, (o * n) % 9 / 100, "ANR"[(o + n) % 3], "FO"[o % 2])
        for o in range(1, 160) for n in range(1, 6) for p in [1 + (o * 13 + n * 29) % 60]
    ]
    lines += lines[:40]  # repeated rows
    lines += [(None, 3, 1, 1, 5.0, 0.01, 0.02, "A", "F"), (5, 3, 1, 1, None, 0.01, None, "A", "F")]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(f"{d}/lineitem.parquet")
    return d


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("name", ["sumstats", "sim_abf", "true_effects", "posteriors"])
def test_wide_tables_are_read_off_the_source(spark, folder, name):
    table = bridge.domain(spark, folder, name)
    assert all("lineitem.parquet" in f for f in table.inputFiles())
    assert "l_tax" not in table.select("variant")._jdf.queryExecution().executedPlan().toString()


def test_sources_of_many_splits_are_not_moved(spark, tmp_path):
    spark.range(400_000).selectExpr("id", "md5(cast(id as string)) AS x").coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        assert len(table.inputFiles()) == 1 and bridge.spread(table) is table
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    short = spark.read.parquet(str(tmp_path / "t")).coalesce(1)
    assert bridge.spread(short).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_completed_variants_of_some_columns(spark, folder, join_path):
    columns = ["region", "variant", "prob", "gamma", "gamma_from_region", "id", "pheno", "config", "position"]
    whole = registry.sim_complete(spark, folder)
    narrow = registry.sim_complete(spark, folder, "region", "variant", "prob", "gamma")
    assert "t_dentist" in whole.columns and "t_dentist" not in narrow.columns
    assert rows(narrow, columns) == rows(whole, columns)


def test_delta_of_some_columns(spark, folder, join_path):
    columns = ["trait", "region", "variant", "prediction", "prob", "max_pip", "delta", "rsid", "any_cs", "max_pip_gwas"]
    whole = registry.delta.compute(spark, folder)
    narrow = registry.delta.compute(spark, folder, "rsid", "any_cs", "max_pip_gwas")
    assert narrow.columns == columns and "east" in whole.columns
    found = rows(narrow, columns)
    assert found and found == rows(whole, columns)
    assert shared_folder(spark) and registry.pip_wide(spark, folder, "max_pip").columns == ["trait", "variant", "max_pip"]


def test_external_posteriors_of_other_variants_do_not_move(spark, folder, join_path, monkeypatch):
    rows_, leads = registry.scored_variants(spark, folder, "consequence")
    rows_ = rows_.withColumns({"cs": F.col("prob") > 0.9, "cs_99": F.col("prob") > 0.9})
    wanted = {r["variant"] for r in rows_.filter("cs").collect()} | {r["lead_variant"] for r in leads.collect()}
    others = spark.createDataFrame([(f"v{i}", i / 3000) for i in range(3000)] + [(v, 0.5) for v in sorted(wanted, key=str)[::2]], "variant string, max_pip double")
    met = []
    attach = loci.attach
    monkeypatch.setattr(loci, "attach", lambda r, t, *more, **named: met.append(t.count()) or attach(r, t, *more, **named))
    found = loci.locus_external_pips(rows_, leads, others, others)
    assert all(n == others.count() if join_path == "broadcast" else n < others.count() / 4 for n in met)
    monkeypatch.setattr(loci, "with_possible_partner", lambda t, *more: t.withColumn("__maybe", F.lit(True)))
    assert rows(found, found.columns) == rows(loci.locus_external_pips(rows_, leads, others, others), found.columns)

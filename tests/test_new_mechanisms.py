"""Sketches, densities, arrays as rows, grid and sorted sinks, lasting labels, NULL groups: against plain Python."""

import glob
import gzip
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lociary.operators import density, keyed, ordered, reshape, roc, sketch
from lociary.plans import effects, panels
from lociary.sources import readers, writers


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_merged_sketches_answer_within_the_bound(spark, accuracy):
    rng = random.Random(7)
    data = [(rng.choice(["a", "a", "b", None]), k % 5, rng.choice([0.0, -1, 1]) * 10 ** rng.uniform(-12, 12)) for k in range(3000)]
    data += [("a", 9, None), ("a", 9, float("nan")), ("a", 9, float("inf")), ("none", 0, None), ("one", 3, -4.5)]
    df = spark.createDataFrame(data, "g string, batch int, x double")
    asked = {f"q{k}": k / 20 for k in range(21)}
    merged = sketch.merge_sketches(sketch.quantile_sketches(df, ["g", "batch"], "x", accuracy), ["g"])
    whole = {r["g"]: r for r in sketch.quantile_sketches(df, ["g"], "x", accuracy).collect()}
    answers = sketch.sketch_quantiles(merged, asked, accuracy).collect()
    assert {r["g"] for r in answers} == {"a", "b", None, "one"}
    for r in answers:
        values = sorted(x for g, _, x in data if g == r["g"] and x is not None and math.isfinite(x))
        assert r["n"] == len(values) and whole[r["g"]]["sketch"] == r["sketch"]
        for name, p in asked.items():
            exact = values[math.floor(p * (len(values) - 1))]
            assert abs(r[name] - exact) <= (accuracy + 1e-9) * abs(exact)


def test_density_against_the_sum_of_kernels(spark):
    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 1) for _ in range(400)], None: [rng.choice([1.0, 2.0, 7.5]) for _ in range(90)], "same": [3.0] * 8, "one": [-2.0], "zero": [0.0, 0.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in [*xs, None]], "g string, x double").repartition(5)
    got = density.density(df, ["g"], "x", points=512).collect()
    for g, xs in groups.items():
        rows = sorted((r["place"], r["at"], r["density"], r["bandwidth"]) for r in got if r["g"] == g)
        n, width = len(xs), rows[0][3]
        sd = statistics.stdev(xs) if n > 1 else 0
        quarter = lambda p: sorted(xs)[math.floor(p * (n - 1))] + (p * (n - 1) % 1) * (sorted(xs)[math.ceil(p * (n - 1))] - sorted(xs)[math.floor(p * (n - 1))])
        low = min(sd, (quarter(0.75) - quarter(0.25)) / 1.34) or sd or abs(xs[0]) or 1
        assert width == pytest.approx(0.9 * low * n**-0.2)
        assert [r[0] for r in rows] == list(range(512))
        assert rows[0][1] == pytest.approx(min(xs) - 3 * width) and rows[-1][1] == pytest.approx(max(xs) + 3 * width)
        exact = [sum(math.exp(-0.5 * ((at - x) / width) ** 2) for x in xs) / (n * width * math.sqrt(2 * math.pi)) for _, at, _, _ in rows]
        assert max(abs(e - r[2]) for e, r in zip(exact, rows)) < 0.002 * max(exact)
    assert density.density(df.filter("x > 100"), ["g"], "x").count() == 0


def test_arrays_to_rows_and_back(spark):
    df = spark.createDataFrame(
        [(1, "[1.5,null,-2e-3]", [1, 2, 3], "k"), (2, None, [4], "k"), (3, "[]", [], "k"), (4, None, None, "k"), (5, "[7]", None, None)], "id int, t string, a array<int>, place string"
    )
    rows = reshape.arrays_to_rows(df.drop("place"), {"t": "x", "a": "y"}, "place")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 1.5, 1), (1, 1, None, 2), (1, 2, -0.002, 3), (2, 0, None, 4), (5, 0, 7.0, None)]
    back = reshape.rows_to_arrays(rows, ["id"], "place", {"x": "t", "y": "a"}, 3, as_text=True)
    assert {r["id"]: (r["t"], r["a"]) for r in back.collect()} == {1: ("[1.5,null,-0.002]", "[1,2,3]"), 2: ("[null,null,null]", "[4,null,null]"), 5: ("[7.0,null,null]", "[null,null,null]")}
    again = reshape.arrays_to_rows(back, {"t": "x", "a": "y"}, "place").filter("x IS NOT NULL OR y IS NOT NULL")
    assert sorted(map(tuple, again.collect())) == [(1, 0, 1.5, 1.0), (1, 1, None, 2.0), (1, 2, -0.002, 3.0), (2, 0, None, 4.0), (5, 0, 7.0, None)]
    with pytest.raises(Exception, match="different lengths"):
        reshape.arrays_to_rows(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>"), {"a": "x", "b": "y"}, "place").collect()
    with pytest.raises(Exception, match="outside 0"):
        reshape.rows_to_arrays(rows, ["id"], "place", {"x": "t"}, 2).collect()


def test_grid_keeps_what_is_not_written(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3 / 10).alias("maf"), (F.col("id") % 2 / 5).alias("rsq"), F.col("id").alias("n"))
    writers.write_grid(rows, f"{tmp_path}/g", ["maf", "rsq"])
    assert len(glob.glob(f"{tmp_path}/g/maf=*/rsq=*")) == 6
    writers.write_grid(rows.filter("maf = 0.1 AND rsq = 0.2").withColumn("n", -F.col("n")), f"{tmp_path}/g", ["maf", "rsq"])
    got = readers.read_grid(spark, f"{tmp_path}/g", "maf double, rsq double")
    assert got.dtypes == [("n", "bigint"), ("maf", "double"), ("rsq", "double")]
    want = [(-r["n"] if (r["maf"], r["rsq"]) == (0.1, 0.2) else r["n"], r["maf"], r["rsq"]) for r in rows.collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("text", [False, True])
def test_sorted_export_is_one_order_over_all_files(spark, tmp_path, text):
    rng = random.Random(3)
    data = [(rng.randrange(40), rng.choice("abc"), k) for k in range(5000)]
    df = spark.createDataFrame(data, "a int, b string, k int").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.write_sorted(df, f"{tmp_path}/s", [F.desc("a"), "b"], text=text)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = sorted(data, key=lambda r: (-r[0], r[1], r[2]))
    if text:
        files = sorted(glob.glob(f"{tmp_path}/s/part-*"))
        lines = [line.split("\t") for f in files for line in gzip.open(f, "rt").read().split("\n")[1:] if line]
        assert len(files) > 1 and [(int(a), b, int(k)) for a, b, k in lines] == want
    else:
        got = readers.read_sorted(spark, f"{tmp_path}/s").collect()
        assert [(r["a"], r["b"], r["k"]) for r in sorted(got, key=lambda r: r["place"])] == want
        assert sorted(r["place"] for r in got) == list(range(5000))


def test_labels_keep_their_numbers(spark):
    table = lambda *labels: spark.createDataFrame([(x,) for x in labels], "label string")
    none = spark.createDataFrame([], "label string, level bigint")
    first = panels.extend_levels(none, table("m", "c", "m", None))
    assert dict(first.collect()) == {"c": 0, "m": 1}
    second = panels.extend_levels(first, table("a", "m", "z", "a"))
    assert dict(second.collect()) == {"c": 0, "m": 1, "a": 2, "z": 3}
    assert dict(panels.extend_levels(second, table("m")).collect()) == dict(second.collect())
    assert panels.extend_levels(none, table()).count() == 0


def test_null_values_and_null_groups(spark, join_path):
    rows = spark.createDataFrame([("v", 1.0, 2.0), ("v", 2.0, 4.0), ("v", 3.0, None), ("v", None, 1.0), (None, 1.0, 3.0), ("w", 1.0, None)], "k string, x double, y double")
    got = {r["k"]: (r["n"], r["beta"]) for r in effects.marginal_assoc(rows, ["k"]).collect()}
    assert got == {"v": (2, 2.0), None: (1, 3.0), "w": (0, None)}
    scored = spark.createDataFrame([(g, k / 10, k) for g in ("p", None) for k in range(10)], "g string, s double, k int")
    top = ordered.top_fractions(scored, ["g"], "s", [F.col("k")], [0.7])
    assert sorted((r["g"] or "", r["k"]) for r in top.collect()) == [("", 7), ("", 8), ("", 9), ("p", 7), ("p", 8), ("p", 9)]
    truths = scored.select("g", (F.col("k") % 2 == 0).alias("t"), "k")
    curve = roc.roc_curve(roc.score_counts(truths, ["g"], "t", "k"), ["g"]).collect()
    assert sum(r["g"] is None for r in curve) == 12 and sum(r["g"] == "p" for r in curve) == 12


def test_levels_from_the_data(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "Meta", "c", "a", None, "b", "Other"]], "x string")
    assert dict(ordered.level_ranks(df, "x", ("c", "none"), ("Other", "Meta")).collect()) == {"c": 1, "a": 2, "b": 3, "Other": 4, "Meta": 5}
    assert dict(ordered.level_ranks(df, "x").collect()) == {"Meta": 1, "Other": 2, "a": 3, "b": 4, "c": 5}


def test_index_leaves_out_files(spark, tmp_path):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "t").otherwise("u").alias("trait"), (F.col("id") % 3).cast("string").alias("contig"), F.col("id").alias("position"),
        F.concat(F.lit("r"), F.floor(F.col("id") / 500).cast("string")).alias("region"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.write_by_locus(rows, f"{tmp_path}/v")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    index = readers.region_index(spark, f"{tmp_path}/v")
    found = readers.read_positions(spark, f"{tmp_path}/v", index, "t", "1", 100, 220)
    assert sorted(r["position"] for r in found.collect()) == [p for p in range(100, 221) if p % 2 == 0 and p % 3 == 1]
    assert 0 < len(found.inputFiles()) < len(spark.read.parquet(f"{tmp_path}/v").inputFiles())
    assert readers.read_positions(spark, f"{tmp_path}/v", index, "none", "1", 0, 9).count() == 0
    assert readers.read_positions(spark, f"{tmp_path}/v", index, "t", "1", 0, 9).columns == spark.read.parquet(f"{tmp_path}/v").columns


def test_layouts_are_read_by_each_header(spark, tmp_path):
    for name, text in {"a": "x\ty\tz\n1\tone\tNA\n2\t\t2.5\n", "b": "z\tx\n0.5\t3\n\n", "c": "x\nx\n4\n", "d": ""}.items():
        (tmp_path / f"{name}.tsv").write_text(text)
    got = readers.read_tsv_layouts(spark, str(tmp_path), "x int, y string, z double, w bigint", required=["x"], source="file")
    assert got.dtypes == [("x", "int"), ("y", "string"), ("z", "double"), ("w", "bigint"), ("file", "string")]
    assert sorted((r[:4] for r in got.collect()), key=str) == [(1, "one", None, None), (2, None, 2.5, None), (3, None, 0.5, None), (4, None, None, None)]
    with pytest.raises(Exception, match="no column y"):
        readers.read_tsv_layouts(spark, str(tmp_path), "x int, y string", required=["y"]).collect()


def test_stored_tables_can_be_discarded(spark, tmp_path):
    kept = spark.range(3)
    kept.write.parquet(f"{tmp_path}/kept")
    stored = keyed.settle(kept)
    (file,) = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    assert glob.glob(file.removeprefix("file:").replace("//", "/"))
    assert keyed.discard_stored(spark) > 0 and keyed.discard_stored(spark) == 0
    assert not glob.glob(file.removeprefix("file:").replace("//", "/"))
    assert keyed.settle(spark.read.parquet(f"{tmp_path}/kept")).count() == 3

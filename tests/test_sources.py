"""Block gzip: against the gzip module and plain text, over ranges of every size."""

import glob
import gzip
import random

import pytest
from pyspark.sql import functions as F

from lociary.sources import blockgzip, readers, writers


@pytest.fixture
def ranges(spark):
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")

    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def some_lines(n):
    rng = random.Random(n)
    lines = ["".join(rng.choice("abcdefgh\tij é") for _ in range(rng.choice([0, 3, 50, 200]))) + str(k) for k in range(n)]
    lines[n // 2], lines[n // 3] = "x" * 400_000, ""
    return lines


@pytest.mark.parametrize("bytes_a_range", [7_001, 60_000, 128 << 20])
def test_lines_come_back_from_many_ranges(spark, tmp_path, ranges, bytes_a_range):
    lines = some_lines(12_000)
    blockgzip.write_block_gzip(spark.createDataFrame([(x,) for x in lines], "x string").coalesce(1), f"{tmp_path}/a", header="head")
    (file,) = glob.glob(f"{tmp_path}/a/part-*")
    assert sorted(gzip.open(file).read().decode().split("\n")) == sorted(["", "head", *lines])
    ranges(bytes_a_range)
    got = blockgzip.read_block_gzip(spark, f"{tmp_path}/a")
    if bytes_a_range < 100_000:
        assert blockgzip._ranges(spark, f"{tmp_path}/a").select(F.spark_partition_id()).distinct().count() > 4
    rows = got.collect()
    assert sorted(r["line"] for r in rows) == sorted(["head", *lines])
    assert [r["line"] for r in rows if r["first"]] == ["head"] and blockgzip.first_line(spark, f"{tmp_path}/a") == "head"


def test_other_headers_line_ends_and_faults(spark, tmp_path, ranges):
    other = bytearray(blockgzip.block(b"c\r\nd"))
    other[4] = 9  # a time stamp: not the usual header
    file = tmp_path / "x.bgz"
    file.write_bytes(blockgzip.block(b"a\nb") + bytes(other) + blockgzip.END + blockgzip.block(b"d\ne") + blockgzip.END)
    assert sorted(r["line"] for r in blockgzip.read_block_gzip(spark, str(file)).collect()) == ["a", "bc", "dd", "e"]
    (tmp_path / "empty.bgz").write_bytes(blockgzip.END)
    assert blockgzip.read_block_gzip(spark, str(tmp_path / "empty.bgz")).count() == 0
    broken = bytearray(blockgzip.block(b"text\n" * 100))
    broken[30] ^= 1
    (tmp_path / "broken.bgz").write_bytes(bytes(broken))
    with pytest.raises(Exception):
        blockgzip.read_block_gzip(spark, str(tmp_path / "broken.bgz")).collect()
    (tmp_path / "plain.bgz").write_bytes(b"no gzip at all\n")
    with pytest.raises(Exception, match="not block gzip"):
        blockgzip.read_block_gzip(spark, str(tmp_path / "plain.bgz")).collect()


def test_same_rows_as_plain_text(spark, tmp_path, ranges):
    rows = spark.range(20_000).select(
        (F.col("id") % 7).alias("n"), F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("x"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("name")
    ).repartition(3)
    writers.write_tsv(rows, f"{tmp_path}/plain", compress=False)
    writers.write_tsv(rows, f"{tmp_path}/blocks", block_gzip=True)
    ranges(20_000)
    schema = "name string, x double, n int"
    plain, blocks = readers.read_tsv(spark, f"{tmp_path}/plain", schema), readers.read_tsv(spark, f"{tmp_path}/blocks", schema, block_gzip=True, source="file")
    assert blocks.columns == ["name", "x", "n", "file"] and blocks.select("file").distinct().count() == 3
    assert sorted(plain.collect()) == sorted(blocks.drop("file").collect())
    with pytest.raises(ValueError, match="no column y"):
        readers.read_tsv(spark, f"{tmp_path}/blocks", "y int", block_gzip=True)
    (tmp_path / "a.bgz").write_bytes(blockgzip.block(b"name\tx\nv\t1\n"))
    (tmp_path / "b.bgz").write_bytes(blockgzip.block(b"x\tname\n2\tw\n"))
    assert readers.read_tsv(spark, f"{tmp_path}/a.bgz", "x int").collect()[0]["x"] == 1
    with pytest.raises(Exception, match="another header"):
        readers.read_tsv(spark, [f"{tmp_path}/a.bgz", f"{tmp_path}/b.bgz"], "x int").collect()

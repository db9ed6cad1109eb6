"""Layouts: what a scan is told, and how many row groups the statistics leave for a lookup."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.operators import layout, search


def left(folder, column, low, high):
    """Row groups that may hold values from ``low`` to ``high``, and all."""
    hit = total = 0
    for file in glob.glob(f"{folder}/*.parquet"):
        told = pq.ParquetFile(file).metadata
        for g in range(told.num_row_groups):
            stats = next(c.statistics for i in range(told.num_columns) if (c := told.row_group(g).column(i)).path_in_schema == column)
            total += 1
            hit += stats.min <= high and stats.max >= low
    return hit, total


def test_files_are_skipped_by_every_column(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"Name{rng.randrange(5000):04d}", f"mod.m{rng.randrange(3000):04d}", i) for i in range(40_000)]
    held = search.keyed(spark.createDataFrame(rows, "name string, module string, id int"))
    layout.clustered(held, ["module", "name_key"], partitions=512).write.parquet(f"{tmp_path}/z")
    for column, value in (("module", "mod.m1234"), ("name_key", "name0777")):
        hit, total = left(f"{tmp_path}/z", column, value, value)
        assert total >= 400 and hit <= total / 10, (column, hit, total)
    z = spark.read.parquet(f"{tmp_path}/z")
    assert sorted(map(tuple, z.drop("name_key").collect())) == sorted(rows)
    assert z.filter("module = 'mod.m1234'").count() == sum(m == "mod.m1234" for _, m, _ in rows)


def test_a_prefix_is_pushed_down_as_a_range(spark, tmp_path):
    search.keyed(spark.createDataFrame([("Abc",), ("abD",), ("ab",), ("b",), (None,)], "name string")).write.parquet(f"{tmp_path}/k")
    held = search.prefix_filter(spark.read.parquet(f"{tmp_path}/k"), "AB")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(name_key,ab)" in plan and "LessThan(name_key,ac)" in plan
    assert sorted(r["name"] for r in held.collect()) == ["Abc", "ab", "abD"]


@pytest.mark.parametrize("prefix", ["", "a", "az", "é", "\u007f", "퟿", "￿", "\U0010ffff", "a\U0010ffff", "\U0010ffff\U0010ffff", "日本"])
def test_prefix_ranges_beyond_ascii(spark, prefix):
    alphabet = ["", "a", "z", "{", "é", "ê", "\u007f", "\u0080", "퟿", "", "￿", "\U00010000", "\U0010ffff", "日本", "日本語", "日末"]
    texts = [a + b for a in alphabet for b in alphabet]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = sorted(r["t"] for r in df.filter(layout.prefix_range("t", prefix)).collect())
    assert got == sorted(t for t in texts if t.startswith(prefix))


def test_clustering_of_few_or_odd_rows(spark):
    for rows in ([], [(None, None)], [("a", None)] * 3, [("a", "b")]):
        df = spark.createDataFrame(rows, "x string, y string")
        assert layout.clustered(df, ["x", "y"]).count() == len(rows)
    numbers = spark.range(4).select(layout.interleaved([F.col("id"), F.lit(3)], 2).alias("z")).collect()
    assert [r["z"] for r in numbers] == [0b0101, 0b0111, 0b1101, 0b1111]

"""Running totals and carried values over groups that are spread over partitions, against windows and by hand."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convoke.operators.scan import scan


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_scan_equals_windows(spark, coalesce):
    """In one partition, as Spark puts few rows together, and in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        scanned(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def scanned(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), i, rng.choice([None, 1, 2, 3]), "x") for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long, sum string").repartition(5)
    upto = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("k")
    expected = df.select("*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.last("v", True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("l"), F.count("*").over(every).alias("c"))
    found = scan(df, ["k"], ["i"], {"s": F.col("v")}, {"l": F.col("v")}, {"c": F.lit(1)})
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    whole = scan(df, [], ["i"], {"n": F.lit(1)}).orderBy("i").collect()
    assert [r["n"] for r in whole] == list(range(1, 2001))
    assert scan(df.limit(0), ["k"], ["i"], {"s": F.col("v")}).count() == 0


def test_one_group_is_spread_over_tasks(spark):
    """The window of a group that has all rows runs in as many tasks as there are partitions."""
    df = spark.range(40000).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scan(df, ["k"], ["i"], {"n": F.lit(1)}).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["c"] for r in out) == 40000 and max(r["hi"] for r in out) == 40000
    assert len(out) > 1 and max(r["c"] for r in out) < 40000

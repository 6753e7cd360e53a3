"""Keys in names against a nested loop."""

import random

from pyspark.sql import functions as F

from convoke.operators import coverage, matching


def test_containing_equals_a_nested_loop(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé-") for _ in range(rng.randrange(n)))
    names, keys = [word(14) for _ in range(80)] + ["", None, "😀ab"], [word(11) for _ in range(120)] + ["", None, "😀", "longer than any name"]
    n, k = (spark.createDataFrame([(x, x) for x in v], "v string, name string").repartition(3) for v in (names, keys))
    got = {tuple(r) for r in matching.containing(n, k, "v", "v").collect()}
    assert got == {(b, a) for a in names if a is not None for b in keys if b is not None and b in a}
    assert matching.containing(n.limit(0), k, "v", "v").count() == 0 == matching.containing(n, k.limit(0), "v", "v").count()


def test_parts_that_are_parts_of_others_count(spark):
    cells = coverage.grid(spark, test=["reduce", "gather"], nodes=[4, 8], size=[1024, 32768]).withColumn("key", F.concat_ws("-", "test", "nodes", "size"))
    names = spark.createDataFrame([("log-allreduce-4-1024-x",), ("2021-gather-8-327680-x",), (None,)], "name string")
    left = coverage.missing(cells, names, "key", "name")
    assert {r["key"] for r in left.collect()} == {"reduce-4-32768", "reduce-8-1024", "reduce-8-32768", "gather-4-1024", "gather-4-32768", "gather-8-1024"}
    assert "NestedLoop" not in left._jdf.queryExecution().toString() and "Cartesian" not in left._jdf.queryExecution().toString()

"""Exact sums against fractions, and for three partitionings bit by bit."""

import math
import random
import struct
from fractions import Fraction

import pytest

from convoke.operators import exact


def bits(x: float) -> bytes:
    return struct.pack("<d", x)


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_are_exact_and_the_same_however_partitioned(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(4000):
        x = rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300), rng.uniform(-1, 1) * 2.0 ** rng.randrange(-1074, 1020), 0.1, -0.1, 2.0 ** rng.randrange(-1074, 1023)])
        rows.append((i % 7, x))
    rows += [(8, math.ulp(0.0))] * 3 + [(9, 1e308), (9, 1e308), (9, -1e308)] + [(10, 1.0), (10, 2.0**-53), (10, 2.0**-53)] + [(11, 0.0), (11, -0.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, x double")
    found = [{r["k"]: r["value"] for r in exact.exact_sum(d, ["k"], "x").collect()} for d in (df, df.repartition(3), df.repartition(11, "x"))]
    assert [{k: bits(v) for k, v in f.items()} for f in found[1:]] == [{k: bits(v) for k, v in found[0].items()}] * 2
    for k, v in found[0].items():
        total = sum((Fraction(x) for g, x in rows if g == k), Fraction(0))
        assert bits(v) == bits(total.numerator / total.denominator), k


def test_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, nan), (2, 1.0), (3, inf), (3, 1.0), (4, inf), (4, -inf), (5, 1.7e308), (5, 1.7e308), (6, None), (6, 2.0), (None, 3.0)]
    got = {r["k"]: r["value"] for r in exact.exact_sum(spark.createDataFrame(rows, "k int, x double"), ["k"], "x").collect()}
    assert got[1] is None and math.isnan(got[2]) and got[3] == inf and math.isnan(got[4]) and got[5] == inf and got[6] == 2.0 and got[None] == 3.0
    assert exact.exact_sum(spark.createDataFrame([], "k int, x double"), ["k"], "x").count() == 0


def test_units_edges_without_a_row_for_each_piece(spark):
    """Doubles next to where units begin, of both signs, and the plan: one row in and none more, added up as numbers."""
    rng = random.Random(3)
    edges = [2.0 ** (32 * k + d) for k in range(-33, 32) for d in (-1, 0) if -1074 <= 32 * k + d <= 1023] + [2.0**500, 2.0**-500]
    rows = [(i % 5, rng.choice([1, -1]) * x) for i, x in enumerate(y for e in edges for y in (e, math.nextafter(e, math.inf), math.nextafter(e, 0.0)))]
    found = exact.exact_sum(spark.createDataFrame(rows, "k int, x double"), ["k"], "x")
    for r in found.collect():
        total = sum((Fraction(x) for g, x in rows if g == r["k"]), Fraction(0))
        assert bits(r["value"]) == bits(total.numerator / total.denominator)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "aggregate(" not in plan

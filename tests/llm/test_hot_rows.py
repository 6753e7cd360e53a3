"""Rows that crowd: ids that lie close together far from 0, rows without an id, and labels of any type."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from convoke.llm import ranges, repeats, vectors


@pytest.mark.parametrize("low", [0, 2**62, -(2**62)])
def test_ranges_of_ids_close_together(spark, low):
    df = ranges.ordered(spark.createDataFrame([(low + i, "x" * 1000) for i in range(400)], "doc_id long, text string"))
    sizes = ranges.ordered_ranges(spark, df, 10_000).groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("bucket").collect()
    assert max(r["n"] for r in sizes) <= 20 and sum(r["n"] for r in sizes) == 400
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))


def test_ranges_of_ids_far_apart(spark):
    ids = [-(2**63), 2**63 - 1, *range(-50, 50)]
    df = ranges.ordered(spark.createDataFrame([(i, "x" * 100) for i in ids], "doc_id long, text string"))
    sizes = ranges.ordered_ranges(spark, df, 1000).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 20


def test_rows_without_an_id_are_spread(spark):
    df = spark.createDataFrame([(None, f"{i:04d}") for i in range(4000)], "doc_id long, text string")
    sizes = [r["count"] for r in df.withColumn("chunk", repeats.chunk_of(4)).groupBy("chunk").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1300


@pytest.mark.parametrize("kind,labels", [("double", [0.2, 0.7, 0.2, None]), ("string", ["a", "b", "a", None]), ("decimal(3,1)", ["0.2", "0.7", "0.2", None])])
def test_labels_of_any_type(spark, kind, labels):
    rows = [(i, str(x) if x is not None else None, [1.0, 2.0, 3.0]) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumn("label", F.col("label").cast(kind))
    out = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark, df).collect())
    assert out == Counter([(0, 1, 0), (1, 0, 1), (2, 1, 0), (3, 0, 3)])


def test_vectors_that_met_before_are_compared_with_the_rest(spark, monkeypatch):
    """Near copies share a bucket in most tables, and are compared with each other in one; links are those of brute force."""
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    x = np.concatenate([base + rng.normal(size=(150, 16)) * 1e-4, base + rng.normal(size=(60, 16)) * 0.25, rng.normal(size=(60, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    seen, sided = [], vectors.sided
    monkeypatch.setattr(vectors, "sided", lambda places, made: seen.append(sided(places, made).collect()) or sided(places, made))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark, df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    later = [r for r in seen[0] if r["t"] > 8 and r["rep"] < 150]
    assert sum(r["met"] for r in later) > 0.8 * len(later) and all(r["new"] * 40 >= sum(q["k"] == r["k"] and not q["met"] for q in seen[0]) for r in later[:200])
    assert sum(abs(got[i][0] - (near[i].sum() - 1)) for i in range(len(x))) <= 4  # of pairs at the bound a few in 100,000 are missed
    for i in range(150):
        assert got[i][1] == 0 and got[i][0] >= 149

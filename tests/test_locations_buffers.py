"""Validity and as-of lookups, and buffers in blocks, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from convoke.operators import buffers, locations


def test_validity_and_as_of(spark):
    rng = random.Random(5)
    events = [(rng.choice([None, "hot", "hot", "hot", "b"]), rng.randrange(300), i, rng.choice([None, "x", "y", "z"])) for i in range(400)]
    wanted = [(rng.choice([None, "hot", "b", "never"]), rng.choice([None, *range(-5, 305)]), i, "kept") for i in range(300)]
    e = spark.createDataFrame(events, "k string, t int, i int, owner string").repartition(4)
    w = spark.createDataFrame(wanted, "k string, t int, i int, note string").repartition(3)

    got = {(r["k"], r["t"], r["i"], r["note"]): r["owner"] for r in locations.as_of(w, e, ["k"], ["t", "i"], ["owner"]).collect()}
    assert len(got) == len(wanted)
    for k, t, i, note in wanted:
        before = [x for x in events if x[0] == k and t is not None and x[1] <= t]
        assert got[k, t, i, note] == (max(before, key=lambda x: x[1:3])[3] if before else None)

    expected = set()
    for k in {x[0] for x in events}:
        own = sorted((x for x in events if x[0] == k), key=lambda x: x[1:3])
        changes = [x for j, x in enumerate(own) if j == 0 or own[j - 1][3] != x[3]]
        expected |= {(k, x[3], x[1], n[1] if n else None) for x, n in zip(changes, [*changes[1:], None]) if x[3] is not None}
    assert {tuple(r) for r in locations.validity(e, ["k"], ["t", "i"], "owner").collect()} == expected
    assert locations.as_of(w, e.limit(0), ["k"], ["t", "i"], ["owner"]).where("owner is not null").count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_buffers_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([None, "a", "b"]), i, [float(rng.randrange(100)) for _ in range(rng.randrange(30))] if i % 9 else None) for i in range(60)] + [("empty", 0, [])]
    df = spark.createDataFrame(rows, "k string, i int, vec array<float>").repartition(4)
    whole = {k: [x for g, _, v in sorted(rows, key=lambda r: r[1]) if g == k for x in v or []] for k in (None, "a", "b")}
    made = buffers.blocked(df, ["k"], "i", block=block)
    got = {(r["k"], r["block"]): r for r in made.collect()}
    assert all(len(r["data"]) <= block and r["first"] == r["block"] * block for r in got.values())
    for k, v in whole.items():
        assert [x for j in range(-(-len(v) // block)) for x in got[k, j]["data"]] == v
    assert sum(len(r["data"]) for r in got.values()) == sum(map(len, whole.values()))
    wanted = [(k, a, n) for k in whole for a, n in ((0, 10), (5, 0), (3, 200), (10**6, 5))]
    w = spark.createDataFrame(wanted, "k string, first long, n long")
    back = {}
    for r in buffers.read(made, w, ["k"], block).orderBy("at").collect():
        back.setdefault((r["k"], r["first"], r["n"]), []).extend(r["data"])
    assert back == {(k, a, n): whole[k][a : a + n] for k, a, n in wanted if whole[k][a : a + n]}
    assert buffers.blocked(df.limit(0), ["k"], "i").agg(F.count("*")).first()[0] == 0

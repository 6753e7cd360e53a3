"""Mixing: targets by hand, taken words against positions in the shuffled sources, and the schedule's evenness."""

from collections import Counter, defaultdict

import pytest

from convoke.llm import mixing
from convoke.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, source string, first string"


def level(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Targets by bisection, without the operator's passes."""
    lo, hi = 0.0, most * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < share * sum(sizes) else (lo, mid)
    return [min(most * s, lo * w) for s, w in zip(sizes, weights)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], SCHEMA)


def rows_of() -> list[tuple]:
    texts = {"a": [40, 7, 0, 900], "b": [3] * 5, "c": [60] * 10, None: [5, 11], "": [1], "é": [0, 0], "z": [2500]}
    rows, i = [], 0
    for source, sizes in texts.items():
        for n in sizes:
            rows.append((i, " ".join(f"w{i}" for _ in range(n)), source))
            i += 1
    return [*rows, (None, "no id", "a"), (None, "no id", "a"), (3, None, "a"), *[(77, "same text here", "c")] * 50]


@pytest.mark.parametrize("block", [16, 2048])
def test_mixing(spark, block):
    rows = rows_of()
    out = mixing.mixed(spark, table(spark, rows).repartition(5), block=block).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    expected = dict(zip(order, level([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
    source_of = {i: s for i, _, s in rows if i is not None} | {None: "a"}
    taken = defaultdict(int)
    for r in out:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in expected.items():
        assert t - 1 - 1e-6 <= taken[s] <= t + 1e-6
    again = mixing.mixed(spark, table(spark, rows[::-1]).repartition(3), block=block).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.mixed(spark, table(spark, rows).limit(0)).count() == 0
    assert [tuple(r) for r in mixing.mixed(spark, table(spark, [(1, None, "a"), (2, " ", None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_schedule_is_even_and_gives_each_word_in_order(spark):
    rows = [(i, " ".join(["w"] * (50 + i % 40)), f"s{i % 4}") for i in range(400)]
    scratch = Scratch(spark, "test")
    docs = scratch.write(mixing.kinds(table(spark, rows)), "d")
    sources = mixing.targets(scratch, docs)
    slots = scratch.write(mixing.schedule(scratch, sources, 64), "s")
    words = {r["source"]: r["words"] for r in sources.collect()}
    order = [r["source"] for r in slots.orderBy("slot").collect()]
    n, seen = len(order), Counter()
    for i, s in enumerate(order, 1):  # at any point of the schedule each source has had about its part
        seen[s] += 1
        for k, w in words.items():
            assert abs(seen[k] - i * w / sum(words.values())) < 8
    assert {s: -(-w // 64) <= seen[s] for s, w in words.items()} == dict.fromkeys(words, True) and n == sum(seen.values())
    mix = mixing.mixture(slots, mixing.pieces(docs, 64)).collect()
    for s, w in words.items():
        got = [(r["begin"], r["end"], r["size"]) for r in mix if r["source"] == s and r["end"] > r["begin"]]
        assert sum(b - a for a, b, _ in got) == w and all(0 <= a < b <= z for a, b, z in got)
    for r in mix:  # a block's words stay within the block
        assert r["end"] - r["begin"] <= 64

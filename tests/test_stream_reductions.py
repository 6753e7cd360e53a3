"""Streams of tasks, objects and failures, in any order and in several runs, against the first k that haven't failed."""

import random

import pytest

from convoke.streaming import reductions


def expected(events: list[tuple]) -> dict:
    seq, failed, lists, k_of = {}, set(), {}, {}
    for kind, task, o, k, s in events:
        if kind == "member":
            lists.setdefault(task, set()).add(o)
            k_of[task] = k
        elif kind == "arrived":
            seq[o] = min(s, seq.get(o, s))
        else:
            failed.add(o)
    out = {}
    for task, members in lists.items():
        good = sorted((seq[o], o) for o in members if o in seq and o not in failed)[: k_of[task]]
        if good:
            out[task] = ({o for _, o in good}, len(good) == k_of[task])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_in_several_runs(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [("member", f"r{t}", o, 2 + 3 * t, 0) for t in range(4) for o in rng.sample(range(30), 18)]
    events += [("member", "never", 999, 1, 0)] + [("arrived", None, o, None, o % 7) for o in range(28)] + [("failed", None, o, None, 100 + o) for o in rng.sample(range(30), 9)]
    events += rng.sample(events, 10)  # repeated ones count once
    rng.shuffle(events)
    given, at = f"{tmp_path}/events", 0
    for size in (len(events) // 3, len(events) // 3, len(events)):  # a run ends after each part, and the next goes on from its state
        part = events[at : at + size]
        at += size
        spark.createDataFrame(part, reductions.EVENT).repartition(3).write.mode("append").parquet(given)
        changes = reductions.run(spark, given, f"{tmp_path}/state", files=1)
    got = {}
    for r in reductions.contributors(changes).collect():
        got.setdefault(r["reduction_id"], (set(), r["filled"]))[0].add(r["object_id"])
    assert got == expected(events)
    log = changes.orderBy("reduction_id", "version").collect()
    for task in got:  # the log adds up, and has every version once
        own = [r for r in log if r["reduction_id"] == task]
        assert [r["version"] for r in own] == list(range(1, len(own) + 1))
        assert sum(r["change"] for r in own) == len(got[task][0]) and own[-1]["filled"] == got[task][1]


def test_quota_below_one(spark):
    with pytest.raises(Exception, match="at least 1"):
        reductions.task_events(spark.createDataFrame([("r", [1], 0, 0)], "reduction_id string, members array<long>, k int, seq long")).collect()

"""Repair of conversations against a brute force that compares whole audits, in one piece and in many."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from convoke.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows: list[tuple]) -> tuple[set, dict]:
    ids, out = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return ids, out


def brute(rows: list[tuple]) -> Counter:
    ids, by = damage(rows)
    result = Counter()
    for conv in ids:
        own, seen, faults = by.get(conv, []), set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(own, own[1:]))
        # best[state] = (cost, audit, lines) over the rows from i on; states by what was said last
        after = {"": "u", "s": "u", "u": "a", "a": "u"}
        name = {"u": "user", "a": "assistant"}

        def inserted(best):
            for _ in range(4):
                for q, n in after.items():
                    c, a, lines = best[n]
                    best[q] = min(best[q], (c + 2, "I" + a, (f"{name[n]}:", *lines)), key=lambda x: x[:2])
            return best

        best = inserted({"": (0, "", ()), "a": (0, "", ()), "s": (10**9, "", ()), "u": (10**9, "", ())})
        for (_, role, text), fault in zip(own[::-1], faults[::-1]):
            new = {}
            for q, n in after.items():
                c, a, lines = best[q]
                options = [(c + 3, "D" + a, lines)]
                if fault not in ("b", "d"):
                    extra = fault == "t"
                    initial = role[:1]
                    if (q, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        c, a, lines = best[initial]
                        options.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
                    c, a, lines = best[n]
                    options.append((c + 2 + extra, "R" + a, (f"{name[n]}:{text}", *lines)))
                new[q] = min(options, key=lambda x: x[:2])
            best = inserted(new)
        cost, audit, lines = best[""]
        n = Counter(faults)
        result[conv, gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return result


def invented(seed: int, convs: int, turns: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randrange(1, turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, rng.choice([t, t, t, None, t // 2]), role, rng.choice(["Yes.", "No", "", " \n", "Well!", f"t{t}?", None, f"x{t}", "é."])))
    return rows


def found(spark, rows, **more) -> Counter:
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{SCHEMA}, copies int, late string").repartition(3)
    return Counter(tuple(r) for r in C.repaired_conversations(spark, df, **more).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = invented(1, 60, 25) + [(None, 1, "user", "Hello."), (None, None, None, None), (7, 2**62, "user", "far."), (7, -(2**62), "assistant", "near."), (9, 1, "user", "again.")]
    rows += [(9, 1, "user", "again.")] * 30 + [(500, i, "user", "x" * 100000) for i in range(2)] + [(600, t, "user", "") for t in range(3)]
    assert found(spark, rows) == brute(rows)
    assert C.repaired_conversations(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    for t in range(500):  # a conversation all of whose rows are dropped
        if zlib.crc32(f"1:{t}".encode()) % 20 == 0:
            assert found(spark, [(1, t, "user", "a.")]) == Counter({(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()): 1})
            break


@pytest.mark.parametrize("seed", [2, 3])
def test_conversations_of_many_partitions(spark, monkeypatch, seed):
    """One conversation has most rows, so that it fills several partitions, with null and repeated turns."""
    monkeypatch.setattr(C, "PART", 300)
    rng = random.Random(seed)
    rows = invented(seed, 5, 12)
    rows += [(None if seed == 2 else 77, rng.choice([None, t, t, t // 3]), rng.choice(["user", "assistant", "system", "user"]), rng.choice(["Yes.", "no", f"t{t}.", f"u{t}", "", "Same. again"])) for t in range(300)]
    assert found(spark, rows) == brute(rows)


def test_dial_equals_bellman():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.random() < 0.4) for _ in range(rng.randrange(8))]
        ends = [rng.choice([0, 1, 2, 3, 5, C.FAR]) for _ in range(4)]
        n, expected = len(rows), {}
        for i in range(n, -1, -1):
            for q in range(4):
                expected[i, q] = ends[q] if i == n else C.FAR
            if i == n:
                continue
            initial, cut = rows[i]
            for q in range(4):
                expected[i, q] = min(expected[i + 1, q] + 3, expected[i + 1, C.TURN[q]] + 2 + cut, *([expected[i + 1, C.KEEP[initial][q]] + cut] if q in C.KEEP.get(initial, ()) else []))
            for _ in range(4):
                for q in range(4):
                    expected[i, q] = min(expected[i, q], expected[i, C.TURN[q]] + 2)
        dist = C.distances(rows, ends, ())
        assert [min(d, C.FAR) for d in dist] == [min(expected[i, q], C.FAR) for i in range(n + 1) for q in range(4)]


def test_damage_is_as_stated(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(20) for t in range(20)]
    made = C.damaged(spark.createDataFrame(rows, SCHEMA)).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    _, by = damage(rows)
    assert Counter({(r["conv_id"], r["turn"], r["role"], r["text"]): r["n"] for r in made}) == Counter((c, *r) for c, v in by.items() for r in v)

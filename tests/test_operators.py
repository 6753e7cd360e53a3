"""Operators on hand-made cases: errors, quotas, provenance, unequal lengths, plans of topology and log folders."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from convoke.functions import hashing, ids, vectors
from convoke.functions.hashing import murmur64a
from convoke.operators import benchstats, objects, reduce, training
from convoke.plans import topology
from convoke.sources import logs
from convoke.streaming import quota


def made(spark, vecs):
    return spark.createDataFrame([(i, [float(x) for x in v], i) for i, v in enumerate(vecs)], "object_id long, vec array<float>, arrival long")


def test_reduction_rules(spark):
    o = made(spark, [[1, 2], [10, 20], [100, 200]])
    m = reduce.reduction(spark, [2, 0, 0, 1], "r")
    row = reduce.reduce_vectors(o, m).first()
    assert (row["vec"], row["contributors"]) == ([111.0, 222.0], [0, 1, 2])
    row = reduce.subset_reduce(o, m, 2, ["arrival"]).first()
    assert (row["vec"], row["contributors"]) == ([11.0, 22.0], [0, 1])
    row = reduce.subset_reduce(o, m, 2, ["arrival"], failed=F.col("object_id") == 0).first()
    assert (row["vec"], row["contributors"]) == ([110.0, 220.0], [1, 2])
    with pytest.raises(ValueError):
        reduce.reduction(spark, [], "r")
    with pytest.raises(ValueError):
        reduce.subset_reduce(o, m, 0, ["arrival"])
    with pytest.raises(PySparkException):
        reduce.subset_reduce(o, m, 4, ["arrival"]).collect()
    with pytest.raises(PySparkException):
        reduce.reduce_vectors(made(spark, [[1], [1, 2]]), reduce.reduction(spark, [0, 1], "r")).collect()


def test_subset_sum_is_of_its_contributors(spark):
    rng = random.Random(1)
    vecs = [[rng.random() for _ in range(5)] for _ in range(20)]
    row = reduce.subset_reduce(made(spark, vecs), reduce.reduction(spark, rng.sample(range(20), 15), "r"), 7, ["arrival"]).first()
    assert len(row["contributors"]) == 7
    for k in range(5):
        assert row["vec"][k] == pytest.approx(sum(vecs[i][k] for i in row["contributors"]), rel=1e-5)


def test_special_values(spark):
    row = reduce.reduce_vectors(made(spark, [[1, float("inf"), float("nan")], [2, 1, 1]]), reduce.reduction(spark, [0, 1], "r")).first()
    assert row["vec"][:2] == [3.0, float("inf")] and row["vec"][2] != row["vec"][2]


def test_objects(spark):
    o = objects.put(spark, [[1, 2], [3]])
    assert o.select(F.octet_length("object_id")).distinct().first()[0] == 20
    with pytest.raises(ValueError):
        objects.put(spark, [[1], [2]], [b"a" * 20, b"a" * 20])
    kept = objects.put(spark, [[1]], [b"a" * 20])
    assert objects.get(kept, b"a" * 20).first()["vec"] == [1.0]
    with pytest.raises(KeyError):
        objects.get(kept, b"b" * 20)
    sizes = spark.createDataFrame([(65536,), (65540,)], "n long").select(objects.size_class(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["inband", "streaming"]


def test_ids(spark):
    r = spark.range(1).select(ids.id_hex(ids.id_from_int(F.lit(1234))).alias("h"), ids.is_nil(F.unhex(F.lit("ff" * 20))).alias("n")).first()
    assert r["h"] == "1234".zfill(40) and r["n"]
    with pytest.raises(PySparkException):
        spark.range(1).select(ids.id_from_hex(F.lit("abcd"))).collect()


def test_vector_functions(spark):
    v = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    r = spark.range(1).select(vectors.argmax(v).alias("a"), vectors.sgd_step(v, v, 0.5).alias("s"), vectors.log_softmax(v).alias("l"), vectors.ramp(4, F.lit(2.0), 3).alias("r"), vectors.relu(F.array(F.lit(-1.0), F.lit(2.0))).alias("u")).first()
    assert r["a"] == 1 and r["s"] == [0.5, 1.5, 1.5] and r["r"] == [0.0, 2.0, 4.0, 0.0] and r["u"] == [0.0, 2.0]
    assert sum(2.718281828459045**x for x in r["l"]) == pytest.approx(1)


def test_hash():
    assert murmur64a(b"") == 0 and murmur64a(b"", 1) != 0
    seen = {murmur64a(bytes([i]) * n) for i in range(50) for n in range(1, 40)}
    assert len(seen) == 50 * 39 and all(0 <= x < 1 << 64 for x in seen)


@pytest.mark.parametrize(("n", "k", "depth", "chains"), [(128, 8, 4, {8: 1, 7: 15}), (152, 24, 3, {19: 1, 18: 7}), (61, 2, 5, {1: 30, 0: 2}), (32, 44, 0, {32: 1})])
def test_topology(n, k, depth, chains):
    p = topology.plan(n, k)
    assert p.depth == depth and {c: p.chains.count(c) for c in set(p.chains)} == chains
    assert [x.order for x in p.nodes] == list(range(n)) and sum(x.is_tree for x in p.nodes) == 2**depth - 1
    assert sum(x.parent is None for x in p.nodes) == 1
    for x in p.nodes:  # every node reaches the root
        seen, at = set(), x
        while at.parent is not None:
            assert at.order not in seen
            seen.add(at.order)
            at = p.nodes[at.parent]


def test_logs(spark, tmp_path):
    for folder, ranks in {"20210101-0900-reduce-4-1024": {0: "x\nduration = 1.5\n", 1: "duration = 2.5\nduration = bad\n"}, "latest": {0: "duration = 9"}}.items():
        (tmp_path / folder).mkdir()
        for r, text in ranks.items():
            (tmp_path / folder / f"rank_{r}.log").write_text(text)
    lines = logs.log_lines(spark, f"{tmp_path}/*/*")
    got = lines.withColumn("d", logs.duration(F.col("line"))).where("d is not null").select("folder", "file", "line_no", "d").collect()
    assert sorted((r["file"], r["line_no"], r["d"]) for r in got) == [("rank_0.log", 1, 1.5), ("rank_1.log", 0, 2.5)]
    assert logs.log_lines(spark, f"{tmp_path}/*/*", rank=0).select("file").distinct().count() == 1
    part = lines.select(logs.folder_parts(F.col("folder")).alias("p")).first()["p"]
    assert (part["test"], part["nodes"], part["size"]) == ("reduce", 4, 1024)
    with pytest.raises(PySparkException):
        spark.createDataFrame([("a-b-c",)], "f string").select(logs.folder_parts(F.col("f"))).collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("reduce", 4, 1024, 0.5)], logs.SERIES_SCHEMA)
    for i in (1, 2, 4):
        logs.write_csv(df, f"{tmp_path}/result-{i}", header=False)
    found = logs.numbered_series(spark, f"{tmp_path}/result-%d", lambda p: (tmp_path / p.rsplit("/", 1)[1]).exists())
    assert found.count() == 2 and found.first()["duration"] == 0.5
    (tmp_path / "e.json").write_text('[{"id": 1, "duration": 0.5, "event": "fail"}, {"id": 2, "duration": 1.0, "event": "ok"}]')
    assert logs.events_json(spark, f"{tmp_path}/e.json").where("event = 'fail'").count() == 1
    trace = spark.createDataFrame([("a", "BEGIN", 1005, 1, 2, "m")], "name string, phase string, ts_ms long, pid long, tid long, message string")
    logs.write_trace(trace, f"{tmp_path}/trace", "log")
    assert '"ts":"1.005"' in logs.document_text(spark, f"{tmp_path}/trace")


def test_window_rules(spark):
    steps = spark.createDataFrame([("a", i, float(i)) for i in range(6)] + [("b", i, 1.0) for i in range(3)], "k string, i int, v double")
    tail = benchstats.tumbling(steps, ["k"], ["i"], 4, "v").where("k = 'a'").orderBy("w").collect()
    assert [(r["mean"], r["rows"]) for r in tail] == [(1.5, 4), (4.5, 2)]
    with pytest.raises(PySparkException):
        benchstats.pairwise_mean(steps, ["k"], ["i"], "v").collect()
    one = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert benchstats.summary(one, ["k"], "v").first()["std"] == 0.0 and benchstats.summary(one, ["k"], "v", sample=True).first()["std"] is None
    order = benchstats.ranked(spark.createDataFrame([("x",), ("b",), ("a",)], "c string"), "c", ["b", "a"]).collect()
    assert [r["c"] for r in order] == ["b", "a", "x"]


def test_hash_verification_value():
    """The public test of the hash: keys 0, 1, .. of each length below 256 with falling seeds, their hashes hashed."""
    made = b"".join(hashing.murmur64a(bytes(range(i)), 256 - i).to_bytes(8, "little") for i in range(256))
    assert hashing.murmur64a(made, 0) & 0xFFFFFFFF == 0x1F0D3804
    many = [bytes(range(i % 256)) * (1 + i % 5) for i in range(300)] + [b"", b"x" * 10_000]
    assert hashing.murmur64a_all(many, 7).tolist() == [hashing.murmur64a(b, 7) for b in many] and len(hashing.murmur64a_all([], 7)) == 0


def test_objects_from_buffers(spark):
    a = np.arange(4, dtype="<f4")
    out = sorted(list(r["vec"]) for r in objects.from_buffer(spark, [a, a.tobytes(), memoryview(a), pa.py_buffer(a * 2), a.reshape(2, 2)]).collect())
    assert out == [[0.0, 1.0, 2.0, 3.0]] * 4 + [[0.0, 2.0, 4.0, 6.0]]
    assert [bytes(r["object_id"]) for r in objects.from_buffer(spark, [a], [b"i" * 20]).collect()] == [b"i" * 20]
    with pytest.raises(ValueError):
        objects.from_buffer(spark, [a, a], [b"i" * 20] * 2)


def test_unknown_task_raises(spark):
    lines = spark.createDataFrame([("nothing", "rank_0.log", "x")], "test string, file string, line string")
    with pytest.raises(Exception, match="Unknown task"):
        logs.counted_ranks(lines).collect()
    with pytest.raises(Exception, match="unknown: nothing"):
        benchstats.mapped(lines, "test", {"a": "b"}, "out").collect()


def test_staleness(spark):
    rows = spark.createDataFrame([(o, [1.0, float(o)], 1.0) for o in range(3)], "owner long, x array<double>, y double")
    ready, rejoins = [[0, 1], [0, 2], [1, 2], [2, 0]], {3: [0]}
    _, log = training.asynchronous(rows, [0.0, 0.0], training.linear_gradient, 4, 0.1, "owner", lambda k: ready[k], lambda k: rejoins.get(k, []))
    assert log == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 2, 0), (3, 0, 0)]


def test_uniform_numbers(spark):
    df = spark.range(200).select(vectors.uniform(F.col("id"), 50, 3).alias("u"))
    one, two = (sorted(map(str, d.collect())) for d in (df, df.repartition(7)))
    x = np.array([r["u"] for r in df.collect()])
    assert one == two and (x >= 0).all() and (x < 1).all() and abs(x.mean() - 0.5) < 0.02 and abs(x.var() - 1 / 12) < 0.01


def test_numbered_over_partitions(spark):
    df = spark.createDataFrame([(f"n{i % 50:03}", i) for i in range(500)], "k string, i int").repartition(9)
    out = {r["i"]: r["place"] for r in benchstats.numbered(df, [F.desc("k"), F.asc("i")]).collect()}
    assert [i for i, _ in sorted(out.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda i: (-(i % 50), i)) and sorted(out.values()) == list(range(1, 501))


def test_waiters_never_served_wait(spark, tmp_path):
    rows = [(1, 1, "request"), (1, 2, "request"), (1, 3, "ready"), (1, 4, "request"), (1, 5, "ready"), (2, 1, "request")]
    spark.createDataFrame(rows, "object_id long, seq long, kind string").write.parquet(f"file://{tmp_path}/e")
    out = quota.run_once(spark, f"file://{tmp_path}/e", quota.waiters_stream, "waiters")
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, True), (1, 2, 3, True), (1, 4, 4, False)]


def test_buffers_and_backups(spark):
    rows = [(1, [1.5, -2.0], 3), (2, None, 1), (3, [], 2), (4, [float("inf")], 2)]
    o = spark.createDataFrame(rows, "object_id long, vec array<float>, arrival long")
    back = {r["object_id"]: r["vec"] for r in objects.from_buffers(objects.to_buffers(o)).collect()}
    assert back == {i: v for i, v, _ in rows}
    with pytest.raises(PySparkException):
        objects.from_buffers(spark.createDataFrame([(1, b"abc")], "object_id long, buffer binary")).collect()
    put = objects.put_rows(o.select("vec", "arrival"))
    first, again = ({r["object_id"] for r in put.collect()} for _ in range(2))
    assert first == again and len(first) == 4 and all(len(i) == 20 for i in first)
    m = reduce.reduction(spark, [1, 2, 3, 4, 4], "r")
    assert {(r["object_id"], r["rn"]) for r in reduce.backups(o, m, 2, ["arrival", "object_id"]).collect()} == {(4, 3), (1, 4)}
    assert {r["object_id"] for r in reduce.backups(o, m, 2, ["arrival", "object_id"], F.col("object_id") == 2).collect()} == {1}


def test_training_without_a_server_is_that_with_one(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), [float(v) for v in rng.normal(size=4)], float(rng.normal())) for i in range(50)]
    df = spark.createDataFrame(rows, "owner long, x array<double>, y double")
    w = training.synchronous(df, np.zeros(4), training.linear_gradient, 3, 0.1, "owner")
    held = {r["owner"]: r["w"] for r in training.allreduce_training(df, 4, training.linear_gradient, 3, 0.1, "owner").collect()}
    assert set(held) == {0, 1, 2} and all(v == pytest.approx(w.tolist()) for v in held.values())

"""Log files in blocks, by many tasks; new files only; documents of many parts; nested spans."""

import json

import pytest
from pyspark.sql import functions as F

from convoke.sources import logs


def folder(path, name: str, ranks: dict[int, str]) -> None:
    (path / name).mkdir(parents=True)
    for rank, text in ranks.items():
        (path / name / f"rank_{rank}.log").write_text(text)


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    folder(tmp_path, "20210101-0900-reduce-4-1024", {0: "".join(f"line {i}{'é' * (i % 7)}\n" for i in range(5000)), 1: "a\n\nb"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = logs.raw_lines(spark.read.text(f"{tmp_path}/*/*"))
        assert raw.where("file = 'rank_0.log'").select(F.spark_partition_id()).distinct().count() > 10
        lines = logs.log_lines(spark, f"{tmp_path}/*/*")
        got = {(r["file"], r["line_no"]): r["line"] for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 5003 and all(got["rank_0.log", i] == f"line {i}{'é' * (i % 7)}" for i in range(5000))
    assert [got["rank_1.log", i] for i in range(3)] == ["a", "", "b"]


def test_files_of_other_ranks_are_not_opened(spark, tmp_path):
    folder(tmp_path, "20210101-0900-reduce-4-1024", {0: "x\n"})
    (tmp_path / "20210101-0900-reduce-4-1024" / "rank_1.log.gz").write_bytes(b"no such archive")
    assert logs.log_lines(spark, f"{tmp_path}/*/*", rank=0).count() == 1
    with pytest.raises(Exception, match="gzip|not a"):
        logs.log_lines(spark, f"{tmp_path}/*/*").count()


def test_new_folders_only(spark, tmp_path):
    at = tmp_path / "logs"
    run = lambda: logs.ingest(spark, f"{at}/*/*", f"{tmp_path}/table", f"{tmp_path}/state")
    folder(at, "20210101-0900-reduce-4-1024", {0: "a\nb\n", 1: "c\n"})
    folder(at, "latest", {0: "never\n"})
    assert run().count() == 3
    (at / "20210101-0900-reduce-4-1024" / "rank_0.log").unlink()  # a run that read it again would fail or lose it
    folder(at, "20210102-0900-gather-4-1024", {0: "d\ne\nf\n"})
    assert {(r["folder"][9:], r["file"], r["line_no"], r["line"]) for r in run().where("batch = 1").collect()} == {("0900-gather-4-1024", "rank_0.log", i, x) for i, x in enumerate("def")}
    assert run().count() == 6 and run().groupBy("batch").count().count() == 2


@pytest.mark.parametrize("n", [0, 1, 700])
def test_a_document_of_many_parts(spark, tmp_path, n):
    rows = [(i % 50, f'a "quote", {i}') for i in range(n)]
    df = spark.createDataFrame(rows, "id long, event string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        logs.write_document(df, f"{tmp_path}/d", ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    made = json.loads(text)
    assert json.loads(logs.document_text(spark, f"{tmp_path}/d")) == made
    assert [r["id"] for r in made] == sorted(i for i, _ in rows) and sorted((r["id"], r["event"]) for r in made) == sorted(rows)
    assert sorted(map(tuple, logs.read_document(spark, f"{tmp_path}/d", "id long, event string").collect())) == sorted(rows)
    if n == 700:
        assert len(list((tmp_path / "d").glob("part-*"))) > 1
        logs.write_document(df, f"{tmp_path}/d", ["id"])  # again, in its place
        assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))) == made


def test_a_trace_is_one_document(spark, tmp_path):
    lines = [f"{(2000 - i) * 1_000_000 + i} app:{i % 3}:9 s.cc:1 f{i} ]: [TIMELINE] [{i}] [{'BEGIN' if i % 2 else 'END'}] two  words" for i in range(300)]
    df = spark.createDataFrame([(x,) for x in [*lines, "short", "1 a:b:c d e ]: other words here"]], "line string")
    logs.write_trace(logs.timeline(df), f"{tmp_path}/t", 'log/"x"')
    made = json.loads("".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))))
    assert made["displayTimeUnit"] == "ms" and made["otherData"] == {"log_dir": 'log/"x"'} and len(made["traceEvents"]) == 300
    times = [float(e["ts"]) for e in made["traceEvents"]]
    assert times == sorted(times)
    assert made["traceEvents"][0] == {"name": "f299_[299]", "cat": "event", "ph": "B", "ts": "1.701", "pid": "app:2", "tid": "9", "args": {"message": "two words"}}


def test_spans_nest(spark):
    marks = "BBEBBEEEBE" + "E" + "BB"  # an end too many, and two that stay open
    rows = [(1, i, f"f{i}", 10 * i, "BEGIN" if c == "B" else "END") for i, c in enumerate(marks)] + [(2, 0, "g", 5, "BEGIN"), (2, 1, "g", 9, "END"), (2, 2, "odd", 9, None)]
    df = spark.createDataFrame(rows, "pid long, i long, name string, ns long, phase string").repartition(4)
    stack, expected = [], set()
    for _, _, name, ns, phase in rows[: len(marks)]:
        if phase == "BEGIN":
            stack.append((name, ns))
        elif stack:
            name, begin = stack.pop()
            expected.add((1, len(stack) + 1, name, begin, ns, ns - begin))
    got = {tuple(r) for r in logs.spans(df, ["pid"], ["i"]).collect()}
    assert got == expected | {(2, 1, "g", 5, 9, 4)}

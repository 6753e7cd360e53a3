"""Log folders to tables: names with five parts, lines with measurements, and the CSV and JSON files around them."""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoke.operators.scan import scan

#: Result table of a benchmark.
RESULT_SCHEMA = "`Benchmark Name` string, `#Nodes` int, `Object Size (in bytes)` long, `Average Time (s)` double, `Std Time (s)` double, `Repeated Times` long"
SERIES_SCHEMA = "algorithm string, world_size int, object_size long, duration double"


def folder_parts(folder: Column) -> Column:
    """date-time-test-nodes-size as a struct; another number of parts raises."""
    p = F.split(folder, "-")
    bad = F.raise_error(F.concat(F.lit("folder name has not 5 parts: "), folder))
    return F.when(F.size(p) == 5, F.struct(p[0].alias("date"), p[1].alias("time"), p[2].alias("test"), p[3].cast("int").alias("nodes"), p[4].cast("long").alias("size"))).otherwise(bad)


def raw_lines(text: DataFrame, rank: int | None = None, without_rank: int | None = None) -> DataFrame:
    """(folder, file, block, line) of a text source's lines, batch or stream, whose files Spark cuts into blocks of bytes; block is where the line's begins.

    Files are left out by their path before they are opened.
    """
    path = F.split("_metadata.file_path", "/")
    files = text.select(F.element_at(path, -2).alias("folder"), F.element_at(path, -1).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    files = files.where("folder <> 'latest' and contains(file, 'rank')")
    if rank is not None:
        files = files.where(F.col("file") == f"rank_{rank}.log")
    if without_rank is not None:
        files = files.where(F.col("file") != f"rank_{without_rank}.log")
    return files


def log_lines(spark: SparkSession, glob: str, rank: int | None = None, without_rank: int | None = None) -> DataFrame:
    """(folder, file, line_no, line) of rank files under glob, e.g. log/*/*; a folder named latest is skipped. line_no is from 0.

    A large file is read by several tasks, a block of bytes each; the lines of the blocks before are added up for the numbers.
    """
    return numbered_lines(raw_lines(spark.read.text(glob), rank, without_rank))


def numbered_lines(raw: DataFrame) -> DataFrame:
    """Lines with their numbers: a block is read by one task in order, so a number that rises within a task orders its lines."""
    lines = scan(raw.withColumn("at", F.monotonically_increasing_id()), ["folder", "file"], ["block", "at"], {"n": F.lit(1)})
    return lines.select("folder", "file", (F.col("n") - 1).cast("int").alias("line_no"), "line")


def ingest(spark: SparkSession, glob: str, table: str, state: str) -> DataFrame:
    """Adds the lines of the log files under glob that were not read before to a table, and returns all of it: (folder, file, line_no, line, batch).

    A stream over the files keeps in state which ones it has seen, so a later run opens new files only. Each of its batches, which has whole files,
    is a folder of the table, which a repeated batch replaces: no line is lost or doubled when a run fails and starts again.
    """
    stream = raw_lines(spark.readStream.text(glob))

    def add(rows: DataFrame, batch: int) -> None:
        numbered_lines(rows).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("folder string, file string, line_no int, line string, batch long").parquet(table)


def write_logs(lines: DataFrame, path: str) -> None:
    """Writes (folder, file, line_no, line) as path/folder/file. Tasks write the files' contents; the driver only renames them, one rename a file."""
    spark = lines.sparkSession
    dealt = lines.repartition("folder", "file").sortWithinPartitions("folder", "file", "line_no")
    dealt.select("folder", "file", "line").write.partitionBy("folder", "file").text(f"{path}/_made")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for made in fs.globStatus(at(f"{path}/_made/folder=*/file=*/part-*")):
        p = made.getPath()
        file, folder = p.getParent().getName().removeprefix("file="), p.getParent().getParent().getName().removeprefix("folder=")
        fs.mkdirs(at(f"{path}/{folder}"))
        if not fs.rename(p, at(f"{path}/{folder}/{file}")):
            raise FileExistsError(f"{path}/{folder}/{file}")
    fs.delete(at(f"{path}/_made"), True)


#: Tasks by the ranks whose logs count: rank 0 only, all, or all but rank 0. Fixed names of the tasks.
RANK_0, ALL_RANKS, NOT_RANK_0 = ("reduce", "gather", "subset_reduce"), ("allreduce", "allgather"), ("multicast",)


def counted_ranks(lines: DataFrame) -> DataFrame:
    """Log lines (test, file, ...) of the ranks that count for their task; an unknown task raises."""
    test, root = F.col("test"), F.col("file") == "rank_0.log"
    bad = F.raise_error(F.concat(F.lit("Unknown task "), test)).cast("boolean")
    return lines.where(F.when(test.isin(*ALL_RANKS), True).when(test.isin(*NOT_RANK_0), ~root).when(test.isin(*RANK_0), root).otherwise(bad))


def parsed_folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder, test, nodes, size, n, seconds): a folder's trials, each the slowest of the ranks that count. A folder whose ranks differ in the number of trials, or one of whose ranks has none, is bad and has one row with n and seconds null."""
    lines = log_lines(spark, f"{path}/*/*").withColumn("p", folder_parts(F.col("folder"))).select("folder", "file", "line_no", "line", "p.test", "p.nodes", "p.size")
    keys = ["folder", "test", "nodes", "size"]
    trials = counted_ranks(lines).withColumn("seconds", duration(F.col("line")))
    ranks = trials.groupBy(*keys, "file").agg(F.count("seconds").alias("c"))
    even = ranks.groupBy(*keys).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).select(*keys, ((F.col("lo") == F.col("hi")) & (F.col("lo") > 0)).alias("good"))
    n = F.row_number().over(Window.partitionBy("folder", "file").orderBy("line_no"))
    slowest = trials.where("seconds is not null").withColumn("n", n).groupBy("folder", "n").agg(F.max("seconds").alias("seconds"))
    return even.join(slowest, "folder", "left").where("good or n = 1 or n is null").select(*keys, F.when(F.col("good"), F.col("n")).alias("n"), F.when(F.col("good"), F.col("seconds")).alias("seconds"))


def line_token(lines: DataFrame, line_no: int, n: int, unit: float, out: str) -> DataFrame:
    """(folder, file, out): the n-th token of one line (both from 0) as a number, times unit."""
    return lines.where(F.col("line_no") == line_no).select("folder", "file", (token(F.col("line"), n).try_cast("double") * unit).alias(out))


def write_document(records: DataFrame, path: str, order: list[str], head: str = "[", tail: str = "]", columns: list[str] | None = None) -> None:
    """Writes records as one JSON document in a folder: head, the records (their columns) as objects with commas between, in order, and tail.

    Many tasks write it, each a range of the order: the parts' bytes, one part after another by name, are the document. A task that
    runs again replaces its part. Records that are equal in order may come in any; an empty table gives head and tail.
    """
    made = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns or records.columns]))
    rows = scan(records.select(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], made.alias("value")), [], [f"o{i}" for i in range(len(order))], {"n": F.lit(1)})
    rows = rows.select("n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "value").alias("value"))
    ends = records.sparkSession.createDataFrame([(0, head), ((1 << 63) - 1, tail)], "n long, value string")
    rows.unionByName(ends).orderBy("n").select("value").write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a document as write_document writes it, each on a line of its own; read in parallel."""
    lines = spark.read.text(path).select(F.ltrim("value", F.lit(",")).alias("value")).where(F.startswith("value", F.lit("{")) & F.endswith("value", F.lit("}")))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def document_text(spark: SparkSession, path: str) -> str:
    """The document of a folder as text; for documents that a viewer opens."""
    return "\n".join(r["value"] for r in sorted(spark.read.text(path).select(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"), "value").collect()))


def duration(line: Column, marker: str = "duration = ") -> Column:
    """The number after the marker; null where there is none."""
    return F.when(F.contains(line, F.lit(marker)), F.element_at(F.split(line, marker), -1).try_cast("double"))


def ranked_step(line: Column, label: str = "step time:") -> Column:
    """struct(rank, seconds) of lines like ' 3 step time: 0.25'."""
    pattern = rf" (\d+) {label}\s*([-+0-9.eE]+)"
    return F.struct(F.regexp_extract(line, pattern, 1).try_cast("int").alias("rank"), F.regexp_extract(line, pattern, 2).try_cast("double").alias("seconds"))


def token(line: Column, n: int) -> Column:
    """The n-th (from 0) token between runs of space; null beyond the last."""
    return F.get(F.split(F.trim(line), r"\s+"), F.lit(n))


def results_csv(spark: SparkSession, path: str, header: bool = True, schema: str = RESULT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def numbered_series(spark: SparkSession, pattern: str, exists, schema: str = SERIES_SCHEMA, last: int = 99) -> DataFrame:
    """Files pattern % 1, pattern % 2, ... up to the first that is missing."""
    paths = []
    for i in range(1, last + 1):
        if not exists(pattern % i):
            break
        paths.append(pattern % i)
    if not paths:
        raise FileNotFoundError(pattern % 1)
    return spark.read.schema(schema).csv(paths)


def events_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, duration double, event string").json(path, multiLine=True)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def trace_events(lines: DataFrame) -> DataFrame:
    """One event of a trace viewer's file as JSON for each timeline row (name, phase, ts_ms, pid, tid, message). The rows stay distributed; a writer joins them by commas."""
    event = F.struct(
        F.col("name"), F.lit("event").alias("cat"), F.substring("phase", 1, 1).alias("ph"), (F.col("ts_ms").cast("decimal(20,0)") / 1000).cast("decimal(20,3)").cast("string").alias("ts"), F.col("pid").cast("string").alias("pid"), F.col("tid").cast("string").alias("tid"), F.struct(F.col("message")).alias("args")
    )
    return lines.select(F.to_json(event).alias("event"))


def write_trace(lines: DataFrame, path: str, log_dir: str) -> None:
    """Writes a trace viewer's document of timeline rows in order of time, with the folder of the logs in it; see write_document."""
    events = trace_events(lines).select(F.from_json("event", TRACE_EVENT).alias("e")).select("e.*").withColumn("at", F.col("ts").cast("decimal(30,3)"))
    tail = f'],"displayTimeUnit":"ms","otherData":{json.dumps({"log_dir": log_dir})}}}'
    write_document(events, path, ["at", "pid", "tid", "name", "ph"], '{"traceEvents":[', tail, events.columns[:-1])


#: Of a trace viewer's file.
TRACE_EVENT = "name string, cat string, ph string, ts string, pid string, tid string, args struct<message: string>"


def timeline(lines: DataFrame) -> DataFrame:
    """Engine log lines (line, ...) that mark where a function begins and ends -> (all columns, name, phase, ns, ts_ms, pid, tid, message).

    A line is: nanoseconds app:pid:tid file:line function ]: [TIMELINE] [id] [BEGIN] message. Lines of other kinds, or with fewer than
    eight parts, are left out; another mark than BEGIN or END gives a null phase. pid is app:pid.
    """
    known = lines.withColumn("_p", F.filter(F.split("line", r"\s+"), lambda x: x != "")).where((F.size("_p") >= 8) & (F.get("_p", F.lit(5)) == "[TIMELINE]"))
    p = F.col("_p")
    phase = F.when(p[7] == "[BEGIN]", "BEGIN").when(p[7] == "[END]", "END")
    ns = p[0].try_cast("long")
    message = F.array_join(F.slice(p, 9, F.greatest(F.size(p) - 8, F.lit(0))), " ")
    who = F.split(p[1], ":")
    made = known.withColumn("ns", ns)
    return made.select(*lines.columns, F.concat(p[3], F.lit("_"), p[6]).alias("name"), phase.alias("phase"), "ns", F.expr("ns div 1000000").alias("ts_ms"), F.concat_ws(":", F.get(who, F.lit(0)), F.get(who, F.lit(1))).alias("pid"), F.get(who, F.lit(2)).alias("tid"), message.alias("message"))


def spans(events: DataFrame, keys: list[str], order: list[str], time: str = "ns", name: str = "name") -> DataFrame:
    """(keys, level, name, begin, end, took) of timeline rows with a phase: what begins and ends within keys, as brackets nest.

    A running depth gives each row its level; an END closes the last BEGIN before it of its level. An END without a BEGIN, and a BEGIN that nothing
    closes, are left out. Both passes are over ranges, so a thread's log is not sorted as a whole.
    """
    marks = events.where("phase is not null").select(*keys, *order, F.col(time).alias("_time"), F.col(name).alias("_name"), (F.col("phase") == "BEGIN").alias("_b"))
    deep = scan(marks, keys, order, {"_depth": F.when(F.col("_b"), 1).otherwise(-1)})
    deep = deep.withColumn("level", F.when(F.col("_b"), F.col("_depth")).otherwise(F.col("_depth") + 1))
    met = scan(deep, [*keys, "level"], order, lasts={"_open": F.struct("_b", "_time", "_name")})
    return met.where("not _b and _open._b").select(*keys, "level", F.col("_open._name").alias("name"), F.col("_open._time").alias("begin"), F.col("_time").alias("end"), (F.col("_time") - F.col("_open._time")).alias("took"))

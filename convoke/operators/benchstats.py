"""Grouped statistics of repeated measurements: positional windows, slowest participants, means and deviations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoke.operators.scan import scan
from convoke.sources.workspace import written


def ordinal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """n: the 1-based position of a measurement within its group, by a scan over ranges: a group with all rows is spread over all tasks."""
    return scan(df, keys, order, {"n": F.lit(1)})


def drop_warmup(df: DataFrame, keys: list[str], order: list[str], first: int) -> DataFrame:
    return ordinal(df, keys, order).where(F.col("n") > first)


def trim_ends(df: DataFrame, keys: list[str], order: list[str], head: int, tail: int) -> DataFrame:
    return scan(df, keys, order, {"n": F.lit(1)}, totals={"total": F.lit(1)}).where((F.col("n") > head) & (F.col("n") <= F.col("total") - tail))


def tumbling(df: DataFrame, keys: list[str], order: list[str], width: int, value: str) -> DataFrame:
    """Means of runs of width measurements; a shorter tail is kept."""
    w = F.floor((F.col("n") - 1) / width).cast("long")
    return ordinal(df, keys, order).groupBy(*keys, w.alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("rows"))


def pairwise_mean(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Means of consecutive pairs; a group with an odd number of rows raises."""
    pairs = tumbling(df, keys, order, 2, value)
    mean = F.when(F.col("rows") == 2, F.col("mean")).otherwise(F.raise_error(F.lit("odd number of steps")))
    return pairs.select(*keys, "w", mean.alias("mean"))


def slowest_by_trial(df: DataFrame, folder: list[str], rank: str, order: list[str], value: str) -> DataFrame:
    """The largest value over ranks for each trial; folders whose ranks have unequal numbers of trials are left out."""
    trials = ordinal(df, [*folder, rank], order)
    per_rank = trials.groupBy(*folder, rank).agg(F.count("*").alias("c")).groupBy(*folder).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    even = per_rank.where("lo = hi").select(*folder)
    return trials.join(even, folder, "left_semi").groupBy(*folder, "n").agg(F.max(value).alias("slowest"))


def truncated_slowest(df: DataFrame, folder: list[str], rank: str, order: list[str], value: str, warmup: int = 0) -> DataFrame:
    """slowest_by_trial over as many trials as the shortest rank has, less the first warmup ones."""
    trials = ordinal(df, [*folder, rank], order)
    shortest = trials.groupBy(*folder, rank).agg(F.max("n").alias("c")).groupBy(*folder).agg(F.min("c").alias("shortest"))
    kept = trials.join(shortest, folder).where((F.col("n") <= F.col("shortest")) & (F.col("n") > warmup))
    return kept.groupBy(*folder, "n").agg(F.max(value).alias("slowest"))


def summary(df: DataFrame, keys: list[str], value: str, sample: bool = False) -> DataFrame:
    """mean, std (population, or of a sample: null for one row) and repeats."""
    std = F.stddev_samp if sample else F.stddev_pop
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), std(value).alias("std"), F.count(value).alias("repeats"))


def last_value(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias("last"))


def whole_groups(df: DataFrame, group: list[str], unit: str, value: str) -> DataFrame:
    """A group with a unit that has no measurement is bad: it keeps its row, with a count of 0 and no mean."""
    units = df.groupBy(*group, unit).agg(F.count(value).alias("c"), F.sum(value).alias("s"))
    bad = F.min("c") == 0
    return units.groupBy(*group).agg(
        F.when(bad, F.lit(0)).otherwise(F.sum("c")).alias("repeats"), F.when(~bad, F.sum("s") / F.sum("c")).alias("mean")
    )


def step_durations(df: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """took: the time since the row before in its group; null for the first, and beside a null time."""
    before = scan(df, keys, order, lasts={"_before": F.struct(ts)})
    return before.withColumn("took", F.col(ts) - F.col(f"_before.{ts}")).drop("_before")


def accuracy(df: DataFrame, predicted: str, label: str):
    return df.agg((100 * F.avg((F.col(predicted) == F.col(label)).cast("int"))).alias("accuracy"))


def accuracy_until(df: DataFrame, order: str, predicted: str, label: str, batch: int, most: int) -> DataFrame:
    """Accuracy over batches of rows in order, up to the first batch before which more than most rows were seen, which isn't read.

    The rows that count are a fixed number, found by a top-k; nothing else is sorted.
    """
    first = df.orderBy(order).limit((most // batch + 1) * batch)
    return accuracy(first, predicted, label)


def mean_of_means(df: DataFrame, keys: list[str], file: str, value: str) -> DataFrame:
    """The mean of each file's mean, so that a file with many measurements counts no more than another."""
    return df.groupBy(*keys, file).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean"), F.count("m").alias("files"))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """place: the 1-based position of each row in the order. Range-partitioned and sorted within partitions; one count a partition is added up."""
    ranged = written(df.sparkSession, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranged.join(before, "_part").withColumn("place", place).drop("_part", "_before")


def mapped(df: DataFrame, column: str, cases: dict[str, str], out: str) -> DataFrame:
    """out: what the column's value maps to; another value raises."""
    value = F.col(column)
    case = F.raise_error(F.concat(F.lit("unknown: "), F.coalesce(value, F.lit("null")))).cast("string")
    for key, name in cases.items():
        case = F.when(value == key, F.lit(name)).otherwise(case)
    return df.withColumn(out, case)


def ranked(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """place: the position of a value in a list of categories; null for others, which sort last."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0))
    return df.withColumn("place", place).orderBy(F.col("place").asc_nulls_last(), column)

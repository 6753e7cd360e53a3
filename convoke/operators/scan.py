"""Running totals and carried values in order within groups, none of which has to fit one task.

Rows are range-partitioned by group and order, so a group of any size is spread over as many partitions as its rows fill.
Within a partition a window does the work; what the earlier partitions of the same group contribute is one row a partition.
Only the groups at a partition's ends can go on in another: there are at most two of them a partition, and only they are
aggregated again. That bounds what is broadcast, two rows a partition, so that the rows of a hot group are never dealt by it.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoke.sources.workspace import written


def scan(df: DataFrame, keys: list[str], order: list[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds columns to df: for each row of a group (keys), in ascending order, nulls first,

    - sums: the running total up to and with the row (a null counts as 0),
    - lasts: the last value that isn't null before the row, the row left out; null if there is none,
    - totals: the total over the whole group.

    order should tell a group's rows apart: rows equal in keys and order stay in one partition, in any order among themselves.
    No keys make one group of all rows; null keys are a group. Values are of the type that sum gives. An empty table gives no rows.
    """
    sums, lasts, totals = dict(sums or {}), dict(lasts or {}), dict(totals or {})
    given = df.columns
    made = {f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()} | {f"_t_{n}": c for n, c in totals.items()}
    rows = df.select("*", *[c.alias(n) for n, c in made.items()]).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    rows = written(df.sparkSession, rows, "scan")
    group = F.struct(F.lit(0).alias("_all"), *keys)  # a struct is never null, and null fields of it are equal
    keyed = rows.withColumn("_g", group)
    several = rows.agg(F.count_distinct("_part")).first()[0] > 1  # in one partition no group goes on in another
    joined = keyed.join(F.broadcast(carried(keyed, order, sums, lasts, totals)), ["_g", "_part"], "left") if several else keyed
    own = Window.partitionBy("_part", *keys)
    run = own.orderBy(*order)
    upto, back = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = (lambda c: F.col(f"_c{c}")) if several else (lambda c: F.lit(None))
    return joined.select(
        *[F.col(f"`{c}`") for c in given],
        *[(zero(before(f"_s_{n}")) + zero(F.sum(f"_s_{n}").over(upto))).alias(n) for n in sums],
        *[F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(back), before(f"_l_{n}")).alias(n) for n in lasts],
        *[F.coalesce(before(f"_t_{n}"), F.sum(f"_t_{n}").over(own)).alias(n) for n in totals],
    )


def carried(keyed: DataFrame, order: list[str], sums: Mapping, lasts: Mapping, totals: Mapping) -> DataFrame:
    """(_g, _part, ...): for each group that several partitions have a part of, and each of these, what the parts before contribute, and the totals."""
    place = F.struct(F.lit(0).alias("_all"), *order)
    ends = keyed.groupBy("_part").agg(F.min("_g").alias("lo"), F.max("_g").alias("hi"))
    shared = ends.select("_part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_g")).groupBy("_g").agg(F.count("*").alias("c")).where("c > 1").select("_g")
    parts = keyed.join(F.broadcast(shared), "_g", "left_semi").groupBy("_g", "_part").agg(
        F.count("*").alias("_n"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max_by(F.col(f"_l_{n}"), F.when(F.col(f"_l_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in lasts],
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in totals],
    )
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        "_g", "_part",
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_l_{n}") for n in lasts],
        *[F.sum(f"_t_{n}").over(Window.partitionBy("_g")).alias(f"_c_t_{n}") for n in totals],
    )

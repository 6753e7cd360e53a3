"""Element-wise reductions over sets of vectors.

A reduction is a lazy DataFrame: vectors are exploded by position and summed on (reduction, position), so that Spark's
partial aggregation adds within each task before the shuffle, whatever the number of members. A hot reduction costs
(tasks x length) shuffled rows, not (members x length).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoke.operators.exact import exact_sum
from convoke.operators.scan import scan

OPS = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product}


def distinct_members(members: DataFrame) -> DataFrame:
    """Each object counts once in a reduction."""
    return members.dropDuplicates(["reduction_id", "object_id"])


def positions(vectors: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return vectors.select(*keys, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def reduce_cells(vectors: DataFrame, keys: list[str], vec: str = "vec", op: str = "sum", exact: bool = False) -> DataFrame:
    """One row for each key and position: (keys, pos, value double). Sums are in double whatever the input's type; exact ones are rounded once, so their bits are the same for any partitioning."""
    if op not in OPS or exact and op != "sum":
        raise ValueError(f"no such reduction: {op}")
    if exact:
        return exact_sum(positions(vectors, keys, vec), [*keys, "pos"], "x")
    return positions(vectors, keys, vec).groupBy(*keys, "pos").agg(OPS[op]("x").alias("value"))


def assemble(cells: DataFrame, keys: list[str], out: str = "vec") -> DataFrame:
    """Cells back to one vector for each key, in order of position."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["value"]).alias(out))


def reduce_vectors(objects: DataFrame, members: DataFrame, op: str = "sum") -> DataFrame:
    """(reduction_id, vec, contributors): the reduced vector and the sorted ids that went into it.

    An empty list of members raises when built from a list (see reduction()); vectors of unequal length raise at run time.
    """
    joined = distinct_members(members).join(objects, "object_id")
    keys = ["reduction_id"]
    checked = joined.groupBy(*keys).agg(
        F.array_sort(F.collect_set("object_id")).alias("contributors"),
        F.min(F.size("vec")).alias("shortest"),
        F.max(F.size("vec")).alias("longest"),
    )
    checked = checked.select(
        *keys,
        F.when(F.col("shortest") == F.col("longest"), F.col("contributors"))
        .otherwise(F.raise_error(F.lit("the objects of a reduction differ in length")))
        .alias("contributors"),
    )
    return assemble(reduce_cells(joined, keys, op=op), keys).join(checked, keys)


def reduction(spark, object_ids: list, reduction_id: str) -> DataFrame:
    """members of one reduction in list order; an empty list raises."""
    if not object_ids:
        raise ValueError("a reduction needs at least one object")
    rows = [(reduction_id, x, i) for i, x in enumerate(object_ids)]
    return spark.createDataFrame(rows, ["reduction_id", "object_id", "ord"])


def arrivals(objects: DataFrame, members: DataFrame, by: list[str], failed: Column | None = None) -> DataFrame:
    """Members that have arrived, numbered in order of arrival (rn), without the failed ones; a later arrival takes a failed one's place."""
    there = distinct_members(members).join(objects.drop("vec"), "object_id")  # vectors aren't sorted along
    if failed is not None:
        there = there.where(~failed)
    return there.withColumn("rn", F.row_number().over(Window.partitionBy("reduction_id").orderBy(*by)))


def first_k(objects: DataFrame, members: DataFrame, k: Column | int, by: list[str], failed: Column | None = None) -> DataFrame:
    """arrivals() with vectors, and used: whether a row is one of the first k; the others are backups."""
    k = k if isinstance(k, Column) else F.lit(k)
    numbered = arrivals(objects, members, by, failed).withColumn("used", F.col("rn") <= k)
    return numbered.join(objects.select("object_id", "vec"), "object_id") if "vec" in objects.columns else numbered


def backups(objects: DataFrame, members: DataFrame, k: int, by: list[str], failed: Column | None = None) -> DataFrame:
    """Members that arrived after the first k, numbered in order of arrival (rn) by a scan: a reduction that has most of the members is spread over tasks. by tells arrivals apart."""
    there = distinct_members(members).join(objects.drop("vec"), "object_id")
    return scan(there if failed is None else there.where(~failed), ["reduction_id"], by, {"rn": F.lit(1)}).where(F.col("rn") > k)


def in_creation_order(objects: DataFrame, members: DataFrame, created: Column, local_small: Column | None = None) -> DataFrame:
    """arrivals() as a directory feeds them: objects there when the reduction was created count in the order of its list (ord), later ones as they arrive.

    objects have arrival; created is a reduction's time on members; a caller's own small objects (local_small) go to the end of the list.
    """
    there = distinct_members(members).join(objects.drop("vec"), "object_id")
    early = F.col("arrival") <= created
    last = F.coalesce(local_small, F.lit(False)) if local_small is not None else F.lit(False)
    order = [(~early).cast("int"), F.when(early, last.cast("int")), F.when(early, F.col("ord")).otherwise(F.col("arrival")), F.col("object_id")]
    return there.withColumn("rn", F.row_number().over(Window.partitionBy("reduction_id").orderBy(*order)))


def reduce_local(objects: DataFrame, members: DataFrame) -> DataFrame:
    """(reduction_id, vec): one task holds a whole reduction, copies its first object in list order and adds the others; unequal lengths raise. For reductions that fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "object_id", "vec")))
    rows = distinct_members(members).join(objects.select("object_id", "vec"), "object_id").groupBy("reduction_id").agg(F.transform(ordered, lambda o: o["vec"].cast("array<double>")).alias("vs"))
    add = lambda s, v: F.when(F.size(s) == F.size(v), F.zip_with(s, v, lambda a, b: a + b)).otherwise(F.raise_error(F.lit("the objects of a reduction differ in length")).cast("array<double>"))
    return rows.select("reduction_id", F.aggregate(F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0))), F.col("vs")[0], add).alias("vec"))


def by_contributor(contributors: DataFrame, owners: DataFrame) -> DataFrame:
    """The inverse of a result's list of ids: (reduction_id, object_id, owner) for owners(object_id, owner)."""
    return contributors.select("reduction_id", F.explode("contributors").alias("object_id")).join(owners, "object_id")


def shortest(chains: DataFrame, keys: list[str], length: str, chain: str) -> DataFrame:
    """The shortest chain of each key; the smallest chain wins ties."""
    return chains.groupBy(*keys).agg(F.min(F.struct(length, chain)).alias("s")).select(*keys, f"s.{chain}", f"s.{length}")


def subset_reduce(objects: DataFrame, members: DataFrame, k: int, by: list[str], failed: Column | None = None) -> DataFrame:
    """The reduction of the first k to arrive; raises if there are fewer, where a store would wait for ever."""
    if k < 1:
        raise ValueError("k is at least 1")
    used = first_k(objects, members, k, by, failed).where("used")
    short = F.count("*") < k
    enough = used.groupBy("reduction_id").agg(
        F.when(short, F.raise_error(F.lit(f"fewer than {k} objects"))).otherwise(F.array_sort(F.collect_set("object_id"))).alias("contributors")
    )
    return assemble(reduce_cells(used, ["reduction_id"]), ["reduction_id"]).join(enough, "reduction_id")

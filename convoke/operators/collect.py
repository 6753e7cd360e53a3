"""Broadcast, gather, allgather, allreduce and checks of their results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoke.operators.reduce import reduce_cells
from convoke.sources.workspace import written


def broadcast_objects(objects: DataFrame, ranks: DataFrame) -> DataFrame:
    """Every rank gets every object; which side is broadcast, if any, Spark decides by its size."""
    return ranks.crossJoin(objects)


def gather(objects: DataFrame, keys: list[str], order: str, vec: str = "vec") -> DataFrame:
    """(keys, vecs): the vectors of a group in order, not concatenated. A group is one row, as for the rank that gathers it."""
    ordered = F.array_sort(F.collect_list(F.struct(order, vec)))
    return objects.groupBy(*keys).agg(F.transform(ordered, lambda o: o[vec]).alias("vecs"))


def gather_concat(objects: DataFrame, keys: list[str], order: str, vec: str = "vec") -> DataFrame:
    return gather(objects, keys, order, vec).select(*keys, F.flatten("vecs").alias("vec"))


def allgather(objects: DataFrame, keys: list[str], order: str, ranks: DataFrame, vec: str = "vec") -> DataFrame:
    return gather(objects, keys, order, vec).crossJoin(ranks)


def allreduce(objects: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Every member of a group gets each cell of the group's sum: (object_id, keys, pos, value)."""
    return objects.select("object_id", *keys).join(reduce_cells(objects, keys, vec), keys)


def roundtrip(objects: DataFrame, payload: str) -> DataFrame:
    """A to B to A: the objects are written with their hashes, read, written and read again, and hashed anew; same tells whether both agree."""
    spark = objects.sparkSession
    sent = objects.withColumn("hash_sent", F.sha2(F.col(payload).cast("binary"), 256))
    back = written(spark, written(spark, sent, "there"), "back")
    return back.withColumn("hash_back", F.sha2(F.col(payload).cast("binary"), 256)).withColumn("same", F.col("hash_sent") == F.col("hash_back"))


def wrapping_checksum(df: DataFrame, hashed: str) -> DataFrame:
    """The sum of 64-bit hashes modulo 2^32; added as decimals, which don't overflow for any number of rows."""
    low = F.col(hashed).bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)")
    return df.agg(F.sum(low).alias("s")).select(F.pmod("s", F.lit(1 << 32).cast("decimal(20,0)")).cast("long").alias("checksum"))

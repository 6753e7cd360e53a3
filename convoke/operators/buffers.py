"""A group's vectors as one buffer in blocks: (keys, block, first, data), of which no row is larger than a block.

The place of a vector is a running total of lengths, by a scan over ranges; vectors are cut at the blocks' ends, and a block is put together from
its cuts. What is read at an offset comes from the blocks that it meets, by an equi-join: the group itself is never one row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoke.operators.scan import scan

#: Elements of a block.
BLOCK = 1 << 20


def equal(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"_{c}"])
    return out


def meeting(first: Column, n: Column, block: int) -> Column:
    """The numbers of the blocks that [first, first + n) meets; none if n is 0."""
    number = lambda at: F.floor(at / block).cast("long")
    return F.when(n > 0, F.sequence(number(first), number(first + n - 1))).otherwise(F.array().cast("array<long>"))


def blocked(objects: DataFrame, keys: list[str], order: str, vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(keys, block, first, data): the vectors of each group in order, one after another, cut into blocks; the last is shorter.

    order tells a group's vectors apart. Null and empty vectors take no room; a group of such has no block.
    """
    size = F.coalesce(F.size(vec).cast("long"), F.lit(0))
    light = objects.select(*keys, order, size.alias("_n")).where("_n > 0")
    placed = scan(light, keys, [order], {"_upto": F.col("_n")}).select(*[F.col(c).alias(f"_{c}") for c in [*keys, order]], (F.col("_upto") - F.col("_n")).alias("_at"))
    rows = objects.where(size > 0).join(placed, equal(objects, placed, [*keys, order])).select(*keys, F.col(vec).alias("_v"), "_at")
    cut = rows.withColumn("block", F.explode(meeting(F.col("_at"), F.size("_v").cast("long"), block)))
    begin = F.greatest(F.col("block") * block - F.col("_at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("_at"), F.size("_v").cast("long"))
    part = F.struct((F.col("_at") + begin).alias("at"), F.slice("_v", (begin + 1).cast("int"), (end - begin).cast("int")).alias("v"))
    made = cut.select(*keys, "block", part.alias("p")).groupBy(*keys, "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return made.select(*keys, "block", (F.col("block") * block).alias("first"), F.flatten(F.transform("p", lambda p: p["v"])).alias("data"))


def read(blocks: DataFrame, wanted: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(wanted's columns, at, data): for wanted(keys, first, n, ...) the elements [first, first + n) of its group's buffer, in pieces of a block at most, each with its offset in the buffer. What lies beyond the buffer is left out."""
    met = wanted.withColumn("_b", F.explode(meeting(F.col("first"), F.col("n"), block)))
    held = blocks.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("block").alias("_block"), F.col("first").alias("_first"), F.col("data").alias("_data"))
    found = met.join(held, equal(met, held, keys) & (met["_b"] == held["_block"]))
    at = F.greatest("first", "_first")
    end = F.least(F.col("first") + F.col("n"), F.col("_first") + F.size("_data"))
    out = found.where(end > at).select(*[F.col(f"`{c}`") for c in wanted.columns], at.alias("at"), F.slice("_data", (at - F.col("_first") + 1).cast("int"), (end - at).cast("int")).alias("data"))
    return out

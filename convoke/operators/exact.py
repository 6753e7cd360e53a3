"""Sums of doubles that are exact until they are rounded once, so that their bits don't depend on partitioning.

A double is cut into whole multiples of units 2^(32 k), each less than 2^33; these are added up in columns, as longs, by the highest
unit, which is associative and goes map-side, one row in and none more. A group then has at most as many units as doubles have exponents
for, 66, and their total is rounded to the nearest double, ties to even, for each group in its task.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bits of a unit's step, and units that a double can have multiples of, with one to spare on either side.
STEP, UNITS = 32, 5


def rounded(units: list[tuple[int, int]]) -> float:
    """The sum of n * 2^(STEP * k) as the nearest double; infinite where that is too large."""
    low = min((k for k, _ in units), default=0)
    total = sum(n << STEP * (k - low) for k, n in units)
    try:
        return float(total << STEP * low) if low >= 0 else total / (1 << -STEP * low)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def pieces(x: Column) -> tuple[Column, list[Column]]:
    """The highest unit k of a finite double, and its multiples of the units k, k - 1 and so on, each by itself: a remainder and a division by a power of two are exact."""
    power = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    # a factor of 2^512 is taken out first, so that no unit is beyond a double's range
    large, small = F.abs(x) >= 2.0**500, F.abs(x) < 2.0**-500
    scaled = F.when(large, x * 2.0**-512).when(small, x * 2.0**512).otherwise(x)
    shift = F.when(x == 0, 0).when(large, 512 // STEP).when(small, -512 // STEP).otherwise(0)
    # one above what the logarithm says, which may be off by one where a unit begins
    top = F.when(x == 0, 0).otherwise(F.floor(F.log2(F.abs(scaled)) / STEP) + 1).cast("int")
    return (top + shift).cast("int"), [((scaled % power((top + 1 - i) * STEP)) / power((top - i) * STEP)).cast("long") for i in range(UNITS)]


def exact_sum(df: DataFrame, keys: list[str], value: str, out: str = "value") -> DataFrame:
    """(keys, out): the sum of a double column for each group, rounded once. Nulls don't count, and a group of nulls has null.

    A NaN, or infinities of both signs, give NaN; other infinities themselves. A sum of zeros is 0.0. An empty table gives no rows, or without keys one of null.
    """
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("_x")).withColumn("_f", F.when(F.col("_x").isNotNull(), ~F.isnan("_x") & (F.abs("_x") < float("inf"))))
    top, multiples = pieces(F.when(F.col("_f"), F.col("_x")))
    cells = rows.select(*keys, F.when(F.col("_f"), 0.0).otherwise(F.col("_x")).alias("_odd"), top.alias("_k"), *[n.alias(f"_n{i}") for i, n in enumerate(multiples)])
    # 16 bits of a multiple and the rest are added up apart, so that longs hold the sums of 2^45 rows
    halves = [F.sum(h(F.col(f"_n{i}"))).alias(f"_{c}{i}") for i in range(UNITS) for c, h in (("l", lambda n: n.bitwiseAND(F.lit(0xFFFF).cast("long"))), ("h", lambda n: F.shiftright(n, 16)))]
    units = cells.groupBy(*keys, "_k").agg(*halves, F.sum("_odd").alias("_odd"))
    held = F.struct(F.col("_k").alias("k"), F.array(*[f"_l{i}" for i in range(UNITS)]).alias("low"), F.array(*[f"_h{i}" for i in range(UNITS)]).alias("high"))
    listed = units.groupBy(*keys).agg(F.collect_list(F.when(F.col("_k").isNotNull(), held)).alias("_u"), F.sum("_odd").alias("_odd"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ([(u["k"] - i, low + (high << 16)) for u in us for i, (low, high) in enumerate(zip(u["low"], u["high"], strict=True)) if low or high] for us in b.column("_u").to_pylist())
            sums = [None if odd is None else rounded(us) + odd for us, odd in zip(found, b.column("_odd").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(sums, pa.float64())], names=[*keys, out])

    schema = StructType([*(listed.schema[k] for k in keys), StructField(out, DoubleType())])
    return listed.mapInArrow(close, schema)

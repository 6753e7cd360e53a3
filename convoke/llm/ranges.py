"""Ranges of documents in the order of their ids, of about equal size and the same in every run.

The ids' span is cut into equal cells, ROWS documents each on average. One aggregation gives the cells' sizes, and their
running total in order gives each cell its range. A cell that is larger than a range - a repeated id, no id, or ids that lie
close together - is cut again, into SUB parts a range's size: by id between its least and largest, or, of one id, by the hash
of the texts; and so on while there are such cells. Documents are joined with the table of cells, which Spark broadcasts while it is small; nothing comes to
the driver but the span. Neither the order of rows nor their partitioning changes a range.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoke.llm.scratch import Scratch

#: Documents of a cell on average, parts of a large cell for each range it fills, cells whose running total one task sorts, times a cell is cut at most.
ROWS, SUB, RUN, LEVELS = 64, 16, 4096, 8


def ordered(documents: DataFrame) -> DataFrame:
    """(doc_id, text, digest) of documents(doc_id, text, ...): a null text is empty; rows of equal doc_id are in order of digest."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("digest", F.xxhash64("text"))


def part(value: Column, low: Column, high: Column, count: Column) -> Column:
    """Which of count equal parts of [low, high] the value lies in; never falls as the value rises. Differences are exact: longs that lie close together are told apart, however large."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = (wide(value) - wide(low)).cast("double") / F.greatest((wide(high) - wide(low)).cast("double"), F.lit(1.0)) * count
    return F.greatest(F.lit(0).cast("long"), F.least(count.cast("long") - 1, F.floor(share)))


def running(cells: DataFrame, path: list[str], size: int) -> DataFrame:
    """(path, bucket): the bytes of all cells before, in order of the path, in units of size. A task sorts the cells of RUN first-level ones; their sums are added up after."""
    cells = cells.withColumn("run", F.floor(F.col(path[0]) / RUN))
    runs = cells.groupBy("run").agg(F.sum("bytes").alias("b"))
    runs = runs.select("run", (F.sum("b").over(Window.orderBy("run")) - F.col("b")).alias("base"))
    own = F.sum("bytes").over(Window.partitionBy("run").orderBy(*path)) - F.col("bytes")
    return cells.withColumn("own", own).join(runs, "run").select(*path, F.floor((F.col("base") + F.col("own")) / size).alias("bucket"))


def ordered_ranges(spark: SparkSession, documents: DataFrame, size: int) -> DataFrame:
    """Adds bucket to documents(doc_id long, text, digest, ...): ranges of (doc_id, digest), numbered in order, of about size bytes of text each; numbers may be left out.

    A null doc_id comes first. A range is larger only by one cell, for a single text, or for rows that are equal in doc_id and text.
    """
    scratch = Scratch(spark, "ranges")
    known = documents.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("rows")).first()
    n = max(1, known["rows"] // ROWS)
    low, high = (F.lit(known[c] or 0).cast("long") for c in ("low", "high"))
    first = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(part(F.col("doc_id"), low, high, F.lit(n)))
    rows, path = documents.withColumn("cell0", first), ["cell0"]
    sizes = [F.sum((F.octet_length("text") + 1).cast("long")).alias("bytes"), *(f(c).alias(f"{name}_{c}") for c in ("doc_id", "digest") for name, f in (("low", F.min), ("high", F.max)))]
    cells = scratch.write(rows.groupBy(*path).agg(*sizes), "cells")
    while len(path) < LEVELS:
        large = (F.col("bytes") > size) & (F.coalesce(F.col("low_doc_id") < F.col("high_doc_id"), F.lit(False)) | (F.col("low_digest") < F.col("high_digest")))
        cut = cells.where(large)
        if cut.isEmpty():
            break
        new, parts = f"cell{len(path)}", F.col("parts")
        rows = rows.join(cut.select(*path, "low_doc_id", "high_doc_id", "low_digest", "high_digest", (F.ceil(F.col("bytes") / size) * SUB).alias("parts")), path, "left")
        by_id, by_text = (part(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}"), parts) for c in ("doc_id", "digest"))
        place = F.when(parts.isNull(), F.lit(0).cast("long")).when(F.col("low_doc_id") < F.col("high_doc_id"), by_id).otherwise(by_text)
        rows = rows.withColumn(new, place)
        fine = rows.where(parts.isNotNull()).groupBy(*path, new).agg(*sizes)
        rows = rows.drop("low_doc_id", "high_doc_id", "low_digest", "high_digest", "parts")
        cells = cells.where(~large).withColumn(new, F.lit(0).cast("long")).unionByName(fine)
        path = [*path, new]
        cells = scratch.write(cells, f"cells{len(path)}")
    return rows.join(scratch.write(running(cells, path, size), "ranges"), path).drop(*path)

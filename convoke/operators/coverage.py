"""Grids of experiments and the ones that have not run."""

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.operators.matching import containing


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the axes: literal lists, so the grid is bounded by what the caller wrote."""
    return spark.createDataFrame(list(product(*axes.values())), list(axes))


def missing(cells: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Grid cells whose key is a substring of no name. An empty key is part of any name."""
    found = containing(names, cells, name, key).select("key").distinct()
    return cells.join(found, cells[key] == found["key"], "left_anti")


def combinations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All combinations of the columns' distinct values, null left out. The result is as large as their numbers multiplied; for columns of few values."""
    out = None
    for c in columns:
        axis = df.where(F.col(c).isNotNull()).select(c).distinct()
        out = axis if out is None else out.crossJoin(axis)
    return out


def absent(cells: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """The cells that found has no row of."""
    return cells.join(found.select(columns).distinct(), columns, "left_anti")

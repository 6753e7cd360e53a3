"""Which keys occur in which names, as substrings, without comparing every key with every name.

Keys are found by their grams: runs of 8, 4, 2 or 1 characters, the longest that a key has room for. A key is looked up by the one of
its grams that the fewest names have, and what that finds is verified by contains. A key with a gram that no name has is in none;
the empty key's gram is the empty one, which every name has.
Names are made distinct before they are cut into grams; both sides are dealt by gram.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of grams; a name is cut into all of them, at every place.
GRAMS = (8, 4, 2, 1)


def grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of n characters of a text; none if it is shorter."""
    size = F.length(text)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n if isinstance(n, Column) else F.lit(n))))


def containing(names: DataFrame, keys: DataFrame, name: str, key: str) -> DataFrame:
    """(key, name): distinct pairs in which the key, of keys, is a substring of the name, of names; as contains has it, so an empty key is in every name, and nulls are in nothing."""
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    k = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    cut = n.select("name", F.explode(F.flatten(F.array(F.array(F.lit("")), *[grams(F.col("name"), q) for q in GRAMS]))).alias("gram"))
    width = F.coalesce(*[F.when(F.length("key") >= q, q) for q in GRAMS])
    own = k.select("key", F.explode(F.when(F.col("key") == "", F.array(F.lit(""))).otherwise(grams(F.col("key"), width))).alias("gram"))
    often = cut.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("key", "g.gram")
    return rarest.join(cut, "gram").where(F.contains("name", F.col("key"))).select("key", "name")

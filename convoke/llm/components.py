"""Connected components by contraction, on tables only.

Each round points every node at its smallest neighbour, follows the pointers to their roots by doubling, and replaces each
edge's ends by their roots. The number of nodes at least halves, so rounds grow with the logarithm of the input. All steps are
aggregations with map-side minima, and joins against a side with unique keys, whose other side Spark can split when skewed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoke.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """edges(a long, b long) -> (node, root) for every node of an edge; root is the smallest node of its component. Loops, repeats and nulls do no harm."""
    edges = scratch.write(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    found, step = None, 0
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        up = both.groupBy("e.node").agg(F.min("e.other").alias("m")).select("node", F.least("node", "m").alias("root"))
        up = scratch.write(up, f"{name}-{step}-0")
        jump = 0
        while True:
            jump += 1
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = scratch.write(up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), f"{name}-{step}-{jump}")
            up = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        found = up if found is None else scratch.write(
            found.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-{step}-all"
        )
        a, b = (up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = scratch.write(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"{name}-{step}-edges")
        step += 1
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found

"""Parameter-server and allreduce training, and ensembles, on top of reductions."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoke.operators.reduce import assemble, reduce_cells
from convoke.operators.scan import scan
from convoke.sources.workspace import written


def tensor_offsets(tensors: DataFrame, keys: list[str], order: str, vec: str) -> DataFrame:
    """start: elements of the tensors before this one when they are packed into one buffer."""
    size = F.coalesce(F.size(vec).cast("long"), F.lit(0))
    return scan(tensors, keys, [order], {"_upto": size}).withColumn("start", F.col("_upto") - size).drop("_upto")


def pack(tensors: DataFrame, keys: list[str], order: str, vec: str) -> DataFrame:
    """buffer and shapes [(order, start, length)], from which unpack() restores the tensors."""
    rows = tensor_offsets(tensors, keys, order, vec)
    entry = F.struct(F.col(order).alias("ord"), F.col("start"), F.size(vec).alias("length"), F.col(vec).alias("v"))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    shapes = F.transform("t", lambda t: F.struct(t["ord"].alias("ord"), t["start"].alias("start"), t["length"].alias("length")))
    return packed.select(*keys, F.flatten(F.transform("t", lambda t: t["v"])).alias("buffer"), shapes.alias("shapes"))


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    part = F.slice("buffer", F.col("s.start").cast("int") + 1, F.col("s.length"))
    return packed.select(*keys, "buffer", F.explode("shapes").alias("s")).select(*keys, F.col("s.ord").alias("ord"), part.alias("vec"))


def gradient_batches(rows: DataFrame, weights: np.ndarray, gradient: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], owner: str) -> DataFrame:
    """Partial gradients (owner, vec, n), one for each owner and Arrow batch; rows have owner, x array<float>, y."""

    def run(batches):
        for pdf in batches:
            for who, g in pdf.groupby(owner):
                x = np.stack(g["x"].to_numpy()).astype("float64")
                yield pd.DataFrame({"owner": [int(who)], "vec": [gradient(weights, x, g["y"].to_numpy("float64"))], "n": [len(g)]})

    return rows.select(owner, "x", "y").mapInPandas(run, "owner long, vec array<double>, n long")


def synchronous(rows: DataFrame, start: np.ndarray, gradient, steps: int, rate: float, owner: str, use: Callable[[int], list[int]] | None = None) -> np.ndarray:
    """Gradient descent: each step sums the gradients of all owners, or of those that use(step) names (the first to arrive, or those alive).

    Only the weights, of a length that does not depend on the rows, come to the driver at each step.
    """
    w = np.array(start, "float64")
    for step in range(steps):
        there = rows if use is None else rows.where(F.col(owner).isin(use(step)))
        parts = gradient_batches(there, w, gradient, owner)
        cells = reduce_cells(parts, [], "vec").join(F.broadcast(parts.agg(F.sum("n").alias("n")))).orderBy("pos").collect()
        w -= rate * np.array([c["value"] / c["n"] for c in cells])
    return w


def allreduce_training(rows: DataFrame, length: int, gradient, steps: int, rate: float, owner: str) -> DataFrame:
    """(owner, w) after gradient descent without a server: every owner holds weights of its own, from 0, and each step applies to them the mean of all owners' gradients, which is added up once and given to all.

    rows have owner, x array<float>, y. Nothing but the plan comes to the driver: an owner's weights are a row of a table that each step writes.
    """
    spark = rows.sparkSession
    zero = F.array_repeat(F.lit(0.0), length)
    held = written(spark, rows.select(F.col(owner).cast("long").alias("owner")).distinct().select("owner", zero.alias("w")), "weights")

    def gradients(batches):
        for pdf in batches:
            for who, g in pdf.groupby("owner"):
                x = np.stack(g["x"].to_numpy()).astype("float64")
                yield pd.DataFrame({"vec": [gradient(np.asarray(g["w"].iloc[0], "float64"), x, g["y"].to_numpy("float64"))], "n": [len(g)]})

    for _ in range(steps):
        mine = rows.select(F.col(owner).cast("long").alias("owner"), "x", "y").join(held, "owner")
        parts = mine.mapInPandas(gradients, "vec array<double>, n long")
        sums = parts.select("n", F.posexplode("vec").alias("pos", "g")).groupBy("pos").agg((F.sum("g") / F.sum("n")).alias("g"))
        mean = assemble(sums.withColumnRenamed("g", "value"), [], "g")  # one row, as long as the weights
        held = written(spark, held.crossJoin(F.broadcast(mean)).select("owner", F.zip_with("w", "g", lambda w, g: w - rate * g).alias("w")), "weights")
    return held


def asynchronous(rows: DataFrame, start: np.ndarray, gradient, steps: int, rate: float, owner: str, ready: Callable[[int], list[int]], rejoins: Callable[[int], list[int]] | None = None) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A parameter server that doesn't wait: (weights, [(step, owner, staleness)]).

    At each step the owners that ready(step) names have a gradient done, of the weights that they were last given; their mean is
    applied, and only they are given the new weights. One that rejoins(step) after a failure is given the newest before the step.
    Weights and owners are few; the rows stay where they are.
    """
    newest, version = np.array(start, "float64"), 0
    held: dict[int, tuple[int, np.ndarray]] = {}
    first, log = (0, newest.copy()), []
    for step in range(steps):
        for o in rejoins(step) if rejoins else []:
            held[o] = (version, newest.copy())
        now = ready(step)
        at = {o: held.get(o, first) for o in now}
        log += [(step, o, version - at[o][0]) for o in now]
        parts = None
        for v in sorted({at[o][0] for o in now}):  # the owners of one version share a pass
            own = [o for o in now if at[o][0] == v]
            p = gradient_batches(rows.where(F.col(owner).isin(own)), at[own[0]][1], gradient, owner)
            parts = p if parts is None else parts.unionByName(p)
        cells = reduce_cells(parts, [], "vec").join(F.broadcast(parts.agg(F.sum("n").alias("n")))).orderBy("pos").collect()
        newest = newest - rate * np.array([c["value"] / c["n"] for c in cells])
        version += 1
        for o in now:
            held[o] = (version, newest.copy())
    return newest, log


def serving_events(models: DataFrame, failed: DataFrame) -> DataFrame:
    """(step, model, event) for models(step, model): fail where failed(step, model) has it, rejoin at the first step after a failure, ok else."""
    known = models.join(failed.select("step", "model", F.lit(True).alias("f")), ["step", "model"], "left").withColumn("f", F.coalesce("f", F.lit(False)))
    before = F.lag("f").over(Window.partitionBy("model").orderBy("step"))
    return known.select("step", "model", F.when(F.col("f"), "fail").when(before, "rejoin").otherwise("ok").alias("event"))


def linear_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.T @ (x @ w - y)


def ensemble_scores(rows: DataFrame, models: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Sum of linear models' outputs: models(model, cls, weights) -> (keys, cls, score). models is a bounded literal table."""
    scored = rows.select(*keys, vec).crossJoin(F.broadcast(models))
    out = F.aggregate(F.zip_with(vec, "weights", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return scored.withColumn("out", out).groupBy(*keys, "cls").agg(F.sum("out").alias("score"))


def ensemble_argmax(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The class with the largest summed score; the smallest class wins ties."""
    return scores.groupBy(*keys).agg(F.min_by("cls", F.struct(-F.col("score"), F.col("cls"))).alias("predicted"))

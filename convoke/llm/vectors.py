"""Near-duplicate vectors by Euclidean p-stable hashing.

Equal vectors of a label are one representative. A unit vector u has in each of TABLES tables the key floor((a_k u + b_k) / W)
for k in 1..PROJECTIONS, with normal a_k; vectors with an equal key share a bucket and are compared exactly, in double
precision. At cosine 0.98 (distance 0.2) a pair shares a key in one table with probability 0.21, in some of 48 with 0.99999.

A pair counts in the first table in which it collides, so each vector's links are summed from the buckets without listing
pairs. A vector goes only to its buckets that hold others too, as it was given (floats stay floats) and with the keys of such
buckets in earlier tables. A bucket of more than BLOCK vectors is compared in blocks of it, each pair of blocks on its own; of the links found there a
spanning forest goes on. Of a large bucket, the most vectors that share one bucket of an earlier table have met there: they are compared
with the rest only. A group of near copies thus costs rows in proportion to its size times its number of blocks in one table, and to its size in the others.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import text as T
from convoke.llm.components import components
from convoke.llm.scratch import Scratch, partitions

COSINE, TABLES, PROJECTIONS, W, BLOCK, SEED = 0.98, 48, 8, 0.9, 1024, 11
#: Places of vectors in buckets that one group of rows compares, on average.
TASK = 20_000


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table_keys(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """uint64 keys (rows, TABLES) of unit vectors; vectors of unlike labels or lengths don't share one."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], TABLES * PROJECTIONS)), rng.uniform(0, W, TABLES * PROJECTIONS)
    q = np.floor((x @ a + b) / W).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
    h = T.mix(label.astype(np.int64).view(np.uint64) * T.JOINT + np.uint64(x.shape[1]))[:, None] + T.mix(np.arange(1, TABLES + 1, dtype=np.uint64))
    for k in range(PROJECTIONS):
        h = T.mix(h ^ (q[:, :, k] + T.JOINT))
    return h


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, label, embedding) -> (rep, key): the keys of all tables. label is the hash of a label."""
    for batch in batches:
        vectors, label = batch.column("embedding").to_pylist(), batch.column("label").to_numpy()
        lengths = np.array([len(v) for v in vectors])
        keys = np.zeros((batch.num_rows, TABLES), np.uint64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            keys[at] = table_keys(unit([vectors[i] for i in at]), label[at])
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["rep", "key"])


def met_before(earlier: pa.Array) -> Iterator[np.ndarray]:
    """The rows that have an earlier key in common, for each such key."""
    key, row = earlier.flatten().to_numpy(), np.repeat(np.arange(len(earlier)), pa.compute.list_value_length(earlier).to_numpy())
    by = np.argsort(key, kind="stable")
    key, row = key[by], row[by]
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            yield row[a:b]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) edges that connect what a symmetric boolean matrix links."""
    left, out = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i] = False
        reach, new = linked[i] & left, linked[i] & left
        while new.any():
            left &= ~new
            new = linked[new].any(axis=0) & left
            reach |= new
        out += [(int(j), i) for j in np.flatnonzero(reach)]
    return out


def compare(cosine: float):
    """Rows of several blocks -> (rep, links) partial sums, and edges (rep, other) with links 0."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("k", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("rep", "ascending")]).combine_chunks()
        k, lo, hi, block, rep, copies = (rows[c].to_numpy() for c in ("k", "lo", "hi", "block", "rep", "copies"))
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        edge = np.append(np.flatnonzero(new), len(k))
        ids, links, others = [], [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a < 2:
                continue
            part = rows.slice(a, b - a)
            x = unit(part["embedding"].to_pylist())
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if lo[a] != hi[a]:  # two blocks: only pairs between them
                near &= block[a:b][:, None] != block[a:b][None, :]
            if near.any():
                for same in met_before(part["earlier"].combine_chunks()):
                    near[np.ix_(same, same)] = False
            c = near @ copies[a:b]
            hit = np.flatnonzero(c)
            ids += rep[a:b][hit].tolist()
            links += c[hit].tolist()
            others += rep[a:b][hit].tolist()
            for i, j in forest(near[np.ix_(hit, hit)]):
                ids.append(int(rep[a + hit[i]]))
                links.append(0)
                others.append(int(rep[a + hit[j]]))
        return pa.table({"rep": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(others, pa.int64())})

    return run


def sided(places: DataFrame, made: DataFrame) -> DataFrame:
    """(rep, t, k, new, old, met) for places(rep, t, k) in large buckets: met are those that share one bucket of an earlier table, the one that most of this bucket do, and so have all met there. new and old are the numbers of blocks of the others and of these."""
    with_keys = places.join(made, "rep")
    keys = with_keys.select("k", "t", F.posexplode("key").alias("earlier", "x")).where("earlier < t")
    most = keys.groupBy("k", "earlier", "x").agg(F.count("*").alias("c")).groupBy("k").agg(F.max(F.struct("c", "earlier", "x")).alias("m"))  # counted map-side; vectors aren't sent
    sizes = places.groupBy("k").agg(F.count("*").alias("n")).join(most, "k", "left").withColumn("c", F.coalesce("m.c", F.lit(0)))
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    met = F.coalesce(F.element_at("key", F.col("m.earlier") + 1) == F.col("m.x"), F.lit(False))
    return with_keys.join(sizes, "k").select("rep", "t", "k", blocks(F.col("n") - F.col("c")).alias("new"), blocks(F.col("c")).alias("old"), met.alias("met"))


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label, ...).

    Vectors are compared within a label. A vector that is null, empty or zero, or has null, infinite or NaN components, or a
    null label or vec_id, links with nothing; vectors of different lengths don't link. Rows of equal vec_id are vectors of their
    own under one id. Labels are of any type that can be grouped, and equal as Spark has it: 0.2 is not 0.7. A row with a null vec_id has a null component and isn't kept.
    """
    scratch = Scratch(spark, "vectors")
    kind = vectors.schema["embedding"].dataType.simpleString()
    given = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", given)
    e = F.col("embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & ~F.exists(e, odd) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = scratch.write(rows.select("vec_id", "label", "embedding", good.alias("good")), "rows")
    reps = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.write(reps, "reps")
    repeat = not reps.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    if repeat:  # representatives are numbered, and their numbers stand for vec_id until the end
        reps = scratch.write(reps.withColumnRenamed("rep", "least_id").withColumn("rep", F.monotonically_increasing_id()), "numbered")
    made = scratch.write(reps.select("rep", F.xxhash64("label").alias("label"), "embedding").mapInArrow(keyed, "rep long, key array<long>"), "keys")
    spots = made.select("rep", F.posexplode("key").alias("t", "k"))  # a key is mixed with its table's number
    sizes = spots.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK)
    placed = scratch.write(spots.join(sizes, "k").select("rep", "t", "k", blocks.alias("new"), F.lit(0).cast("long").alias("old"), F.lit(False).alias("met")), "placed")
    if not placed.where("new > 1").isEmpty():
        large = scratch.write(sided(placed.where("new > 1").select("rep", "t", "k"), made), "large")
        placed = scratch.write(placed.where("new = 1").unionByName(large), "sided")
    own = placed.groupBy("rep").agg(F.collect_list(F.struct("t", "k", "new", "old", "met")).alias("places"))  # TABLES of them at most
    spread = own.join(reps.select("rep", "copies", "embedding"), "rep").select("*", F.explode("places").alias("p"))
    earlier = F.transform(F.filter("places", lambda x: x["t"] < F.col("p")["t"]), lambda x: x["k"])
    new, old = F.col("p")["new"], F.col("p")["old"]
    block = F.when(F.col("p")["met"], new + F.pmod(F.xxhash64("rep"), F.greatest(old, F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest(new, F.lit(1))))
    others = F.when(F.col("p")["met"], new).otherwise(new + old)
    others = F.when(others > 0, F.sequence(F.lit(0).cast("long"), others - 1)).otherwise(F.array().cast("array<long>"))
    met = spread.select("rep", "copies", "embedding", F.col("p")["k"].alias("k"), earlier.alias("earlier"), block.alias("block"), F.explode(others).alias("o"))
    met = met.select("rep", "copies", "embedding", "k", "earlier", "block", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"))
    tasks = max(4 * partitions(spark), -(-placed.count() // TASK))
    task = F.pmod(F.xxhash64("k", "lo", "hi"), F.lit(tasks).cast("long"))
    found = met.withColumn("task", task).groupBy("task").applyInArrow(compare(cosine), "rep long, links long, other long")
    found = scratch.write(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(scratch, found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")), "roots")
    known = reps.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    if repeat:
        known = scratch.write(known, "known")
        known = known.drop("least_id").join(known.groupBy("root").agg(F.min("least_id").alias("least_id")), "root").withColumn("root", F.col("least_id"))
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_id"))
    joined = rows.where("good").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

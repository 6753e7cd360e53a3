"""Arrival-driven reductions: a reduction fires once its quota of distinct objects has arrived; later ones are backups.

State of a reduction before it fires: the ids seen and the running sum (not the vectors), so it is bounded by the quota and
the vector's length; afterwards the ids that went into it, so that one of them coming again is no backup.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convoke.sources.workspace import shared_folder

OUT = "reduction_id string, status string, vec array<double>, contributors array<long>"


def subset_reduce_stream(arrived: DataFrame, k: int) -> DataFrame:
    """arrived(reduction_id string, object_id long, arrival long, vec array<float>) as a stream -> rows 'fired' (the sum and the ids in it) and 'backup' (a late object's id).

    Rows of one micro-batch count in order of (arrival, object_id). A repeated object counts once; null vectors are skipped;
    another length than the first raises.
    """
    if k < 1:
        raise ValueError("k is at least 1")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, fired = (list(state.get[0]), np.array(state.get[1]), state.get[2]) if state.exists else ([], None, False)
        known = set(seen)
        rows = pd.concat(list(batches)).sort_values(["arrival", "object_id"], kind="stable")
        out = []
        for i, v in zip(rows["object_id"], rows["vec"], strict=True):
            if v is None or int(i) in known:
                continue
            if fired:
                out.append((key[0], "backup", None, [int(i)]))
                continue
            v = np.asarray(v, "float64")
            if total is not None and len(total) != len(v):
                raise ValueError("the objects of a reduction differ in length")
            total = v if total is None else total + v
            seen.append(int(i))
            known.add(int(i))
            if len(seen) == k:
                fired = True
                out.append((key[0], "fired", total.tolist(), sorted(seen)))
        state.update((seen, [] if fired or total is None else total.tolist(), fired))
        if out:
            yield pd.DataFrame(out, columns=["reduction_id", "status", "vec", "contributors"])

    return arrived.groupBy("reduction_id").applyInPandasWithState(step, OUT, "seen array<long>, total array<double>, fired boolean", "append", GroupStateTimeout.NoTimeout)


SERVED = "object_id long, request long, served_at long, waited boolean"


def waiters_stream(events: DataFrame) -> DataFrame:
    """events(object_id long, seq long, kind 'request' or 'ready') as a stream -> a row for each request once its object is ready.

    A request before that waits in its object's queue, first come first served; later ones are served at once. Of several ready
    events the first counts. State: the queue's numbers, and after that one number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, ready = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        out = []
        for seq, kind in pd.concat(list(batches)).sort_values("seq", kind="stable")[["seq", "kind"]].itertuples(index=False):
            if kind == "request" and ready is None:
                queue.append(int(seq))
            elif kind == "request":
                out.append((key[0], int(seq), int(seq), False))
            elif ready is None:
                ready = int(seq)
                out += [(key[0], q, ready, True) for q in queue]
                queue = []
        state.update((queue, ready))
        if out:
            yield pd.DataFrame(out, columns=["object_id", "request", "served_at", "waited"])

    return events.groupBy("object_id").applyInPandasWithState(step, SERVED, "queue array<long>, ready long", "append", GroupStateTimeout.NoTimeout)


def run_once(spark, path: str, stream, name: str) -> DataFrame:
    """Drives stream(rows of the parquet files at path) over what they hold now, into files, and returns these. path is a glob pattern, so that it may name one file or a folder."""
    schema, folder = spark.read.parquet(path).schema, shared_folder(spark, name)
    made = stream(spark.readStream.schema(schema).parquet(path))
    query = made.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")

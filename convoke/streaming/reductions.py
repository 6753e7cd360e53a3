"""Reductions of what arrives, with tasks, objects and failures as one stream of events in any order.

Events are (kind, reduction_id, object_id, k, seq): 'member' says that a reduction, which wants k objects, has the object on its list; 'arrived' and
'failed' say what happened to an object, whichever reductions it is in; seq is the order of what happened. A first stage, by object, keeps who
wants an object and whether it is there, and tells each reduction of it, whether the task or the object came first. A second one, by
reduction, keeps the k first of its objects that haven't failed, and the others as backups, and gives a log of changes: when a
contributor fails it is taken back and the first backup is promoted; an object that comes late but has an earlier seq takes the
place of the last. So what is used in the end depends on the events only, not on the order in which they came or on their batches.

State: an object's reductions, two numbers an object, and for a reduction the ids on its list that arrived. Vectors are
not kept; they are added up from the contributors' ids. The stages are two queries with a table of files between, each of which starts again from its checkpoint.
"""

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "kind string, reduction_id string, object_id long, k int, seq long"
ROUTED = "reduction_id string, object_id long, k int, seq long, kind string"
CHANGED = "reduction_id string, version long, object_id long, change int, status string, filled boolean"
#: The state store that keeps each value, list entry and map entry on its own.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Routes(StatefulProcessor):
    """By object: events -> ROUTED."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getValueState("there", "seq long, failed boolean, at long")
        self.tasks = handle.getMapState("tasks", "reduction_id string", "k int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, failed, at = self.there.get() if self.there.exists() else (None, False, None)
        was_there, had_failed, old, new = seq is not None, failed, None, {}
        for kind, task, k, when in (r for df in rows for r in df[["kind", "reduction_id", "k", "seq"]].itertuples(index=False)):
            if kind == "member":
                new.setdefault(task, int(k))
            elif kind == "arrived":
                seq = int(when) if seq is None else min(seq, int(when)) if not was_there else seq
            elif kind == "failed" and not failed:
                failed, at = True, int(when)
        new = {t: k for t, k in new.items() if not self.tasks.containsKey((t,))}
        out = []
        arrives, fails = seq is not None and not was_there and not failed, failed and not had_failed and was_there
        if arrives or fails:
            old = [(t, k) for (t,), (k,) in self.tasks.iterator()] if self.tasks.exists() else []
            out += [(t, key[0], k, seq if arrives else at, "arrived" if arrives else "failed") for t, k in old]
        if seq is not None and not failed:
            out += [(t, key[0], k, seq, "arrived") for t, k in new.items()]
        for t, k in new.items():
            self.tasks.updateValue((t,), (k,))
        self.there.update((seq, failed, at))
        if out:
            yield pd.DataFrame(out, columns=["reduction_id", "object_id", "k", "seq", "kind"])


class Quota(StatefulProcessor):
    """By reduction: ROUTED -> CHANGED."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", "k int, version long")
        self.used = handle.getMapState("used", "object_id long", "seq long")
        self.spare = handle.getMapState("spare", "object_id long", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(seq), int(o), kind, int(k)) for df in rows for o, k, seq, kind in df[["object_id", "k", "seq", "kind"]].itertuples(index=False))
        k, version = self.task.get() if self.task.exists() else (events[0][3], 0)
        used = {o: s for (o,), (s,) in self.used.iterator()} if self.used.exists() else {}  # k of them at most
        before, heap, out = dict(used), None, []

        def say(o: int, change: int, status: str) -> None:
            nonlocal version
            version += 1
            out.append((key[0], version, o, change, status, len(used) == k))

        def put_aside(o: int, s: int) -> None:
            self.spare.updateValue((o,), (s,))
            if heap is not None:
                heapq.heappush(heap, (s, o))

        for seq, o, kind, _ in events:
            if kind == "arrived":
                last = max(((s, u) for u, s in used.items()), default=None) if len(used) == k else None
                if last is None:
                    used[o] = seq
                    say(o, 1, "used")
                elif (seq, o) < last:
                    del used[last[1]]
                    put_aside(last[1], last[0])
                    say(last[1], -1, "backup")
                    used[o] = seq
                    say(o, 1, "used")
                else:
                    put_aside(o, seq)
                    say(o, 0, "backup")
            elif o in used:
                del used[o]
                say(o, -1, "failed")
                if heap is None:
                    heap = [(s, u) for (u,), (s,) in self.spare.iterator()] if self.spare.exists() else []
                    heapq.heapify(heap)
                while heap and not self.spare.containsKey((heap[0][1],)):  # failed since
                    heapq.heappop(heap)
                if heap:
                    s, u = heapq.heappop(heap)
                    self.spare.removeKey((u,))
                    used[u] = s
                    say(u, 1, "used")
            elif self.spare.containsKey((o,)):
                self.spare.removeKey((o,))
                say(o, 0, "failed")
        for o in before.keys() - used.keys():
            self.used.removeKey((o,))
        for o, s in used.items():
            if before.get(o) != s:
                self.used.updateValue((o,), (s,))
        self.task.update((k, version))
        yield pd.DataFrame(out, columns=["reduction_id", "version", "object_id", "change", "status", "filled"])


def task_events(tasks: DataFrame) -> DataFrame:
    """'member' events of tasks(reduction_id, members array<long>, k, seq); a quota below 1 raises."""
    k = F.when(F.col("k") >= 1, F.col("k")).otherwise(F.raise_error(F.lit("k is at least 1")).cast("int"))
    return tasks.select(F.lit("member").alias("kind"), F.col("reduction_id").cast("string").alias("reduction_id"), F.explode(F.col("members").cast("array<long>")).alias("object_id"), k.cast("int").alias("k"), F.col("seq").cast("long").alias("seq"))


def object_events(objects: DataFrame, kind: str) -> DataFrame:
    """'arrived' or 'failed' events of objects(object_id, seq)."""
    return objects.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("reduction_id"), F.col("object_id").cast("long").alias("object_id"), F.lit(None).cast("int").alias("k"), F.col("seq").cast("long").alias("seq"))


def run(spark: SparkSession, events: str, folder: str, files: int | None = None) -> DataFrame:
    """Takes in the files of events that came to the folder events since the last run, files at a time, and returns all changes so far: CHANGED.

    What was taken in and all state are in folder, from which the next run goes on, after a failure too.
    """
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(EVENT)
        given = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(events)
        finish(given.groupBy("object_id").transformWithStateInPandas(Routes(), ROUTED, "append", "none"), f"{folder}/routed")
        routed = spark.readStream.schema(ROUTED).parquet(f"{folder}/routed/rows")
        finish(routed.groupBy("reduction_id").transformWithStateInPandas(Quota(), CHANGED, "append", "none"), f"{folder}/changed")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(CHANGED).parquet(f"{folder}/changed/rows")


def finish(made: DataFrame, folder: str) -> None:
    query = made.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def contributors(changes: DataFrame) -> DataFrame:
    """(reduction_id, object_id, filled): what each reduction uses after all changes, and whether that fills its quota."""
    last = changes.groupBy("reduction_id", "object_id").agg(F.max_by("status", "version").alias("status")).where("status = 'used'")
    filled = changes.groupBy("reduction_id").agg(F.max_by("filled", "version").alias("filled"))
    return last.join(filled, "reduction_id").select("reduction_id", "object_id", "filled")

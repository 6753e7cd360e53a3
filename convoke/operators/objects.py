"""Objects: immutable float vectors keyed by id, and reductions: named sets of ids with a quota.

objects(object_id, vec, ...) and members(reduction_id, object_id, ord). An id may be of any type that can be joined.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType

from convoke.functions import ids
from convoke.sources.workspace import written

#: Objects up to this many bytes take the small path of a directory; results never depend on it.
INBAND_BYTES = 65536


def put(spark: SparkSession, vectors: Sequence[Sequence[float]], object_ids: Sequence[bytes] | None = None) -> DataFrame:
    """Objects from vectors; random ids if none are given; a repeated id raises."""
    if object_ids is None:
        df = spark.createDataFrame([(list(map(float, v)),) for v in vectors], "vec array<float>")
        return df.select(ids.random_id().alias("object_id"), "vec")
    if len(set(object_ids)) != len(object_ids):
        raise ValueError("an object is immutable: its id was put before")
    if any(len(x) != ids.ID_BYTES for x in object_ids):
        raise ValueError(f"an id has {ids.ID_BYTES} bytes")
    rows = [(bytearray(i), list(map(float, v))) for i, v in zip(object_ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "object_id binary, vec array<float>")


def from_buffer(spark: SparkSession, buffers: Sequence, object_ids: Sequence[bytes] | None = None) -> DataFrame:
    """Objects from anything with a buffer of 32-bit floats: bytes, memoryviews, numpy arrays, Arrow buffers. They travel as one Arrow table."""
    vectors = [np.frombuffer(b, "<f4") if not isinstance(b, np.ndarray) else np.ascontiguousarray(b, "<f4").reshape(-1) for b in buffers]
    edge = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
    flat = pa.array(np.concatenate(vectors) if vectors else np.zeros(0, "<f4"))
    columns = {"vec": pa.ListArray.from_arrays(pa.array(edge), flat)}
    if object_ids is None:
        return spark.createDataFrame(pa.table(columns)).select(ids.random_id().alias("object_id"), "vec")
    if len(set(object_ids)) != len(object_ids):
        raise ValueError("an object is immutable: its id was put before")
    return spark.createDataFrame(pa.table({"object_id": pa.array(list(object_ids), pa.binary()), **columns}))


def to_buffers(objects: DataFrame, out: str = "buffer") -> DataFrame:
    """(object_id, buffer): each vector as 32-bit floats, little-endian, one after another; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if v is None else np.asarray(v, "<f4").tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["object_id", out])

    return objects.select("object_id", "vec").mapInArrow(run, StructType([objects.schema["object_id"], StructField(out, BinaryType())]))


def from_buffers(buffers: DataFrame, column: str = "buffer") -> DataFrame:
    """(object_id, vec) of a table of such buffers; one whose length is no multiple of 4 raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if x is None else np.frombuffer(x, "<f4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["object_id", "vec"])

    return buffers.select("object_id", column).mapInArrow(run, StructType([buffers.schema["object_id"], StructField("vec", ArrayType(FloatType()))]))


def put_rows(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """The rows with a random object_id each; written, so that an id stays what it is."""
    return written(vectors.sparkSession, vectors.select(ids.random_id().alias("object_id"), "*"), "put")


def sealed(objects: DataFrame, require_finished: bool = True) -> DataFrame:
    """Objects that are finished, by their column sealed; or all, for a reader that takes unfinished ones too."""
    return objects.where("sealed") if require_finished else objects


def get_or_create(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (object_id, vec), of which those that exist keep what they hold."""
    have = objects.select("object_id", F.col("vec").alias("held"))
    return wanted.join(have, "object_id", "left").select("object_id", F.coalesce("held", "vec").alias("vec"), F.col("held").isNotNull().alias("reused"))


def get(objects: DataFrame, object_id) -> DataFrame:
    """The object; raises KeyError if there is none, where a store would block."""
    found = objects.where(F.col("object_id") == F.lit(object_id))
    if found.isEmpty():
        raise KeyError(object_id)
    return found


def exists(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ids that are there, and their size in bytes."""
    return wanted.join(objects.select("object_id", (F.size("vec").cast("long") * 4).alias("n_bytes")), "object_id", "inner")


def split_by_owner(objects: DataFrame, members: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """Members whose object the owner holds, and the rest."""
    held = objects.where(F.col("owner") == owner).select("object_id")
    return members.join(held, "object_id", "left_semi"), members.join(held, "object_id", "left_anti")


def delete(objects: DataFrame, gone: DataFrame) -> DataFrame:
    return objects.join(gone.select("object_id"), "object_id", "left_anti")


def latest(objects: DataFrame, seq: str = "arrival_seq") -> DataFrame:
    """An upserting store's view: the last write of each id."""
    cols = [c for c in objects.columns if c != "object_id"]
    return objects.groupBy("object_id").agg(F.max_by(F.struct(*cols), seq).alias("o")).select("object_id", "o.*")


def size_class(n_bytes) -> "F.Column":
    return F.when(n_bytes <= INBAND_BYTES, "inband").otherwise("streaming")

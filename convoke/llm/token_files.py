"""Documents to token-id files and back: see rans for the format of a file.

Each range of doc_id is one file, made by one task from texts to bytes, so a lost executor costs its files only. The files are
the binary values of a Parquet table (part, n_ids, file), which Spark writes to and reads from any store it knows.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import rans
from convoke.llm.ranges import ordered, ordered_ranges
from convoke.llm.tokens import encoder
from convoke.operators.scan import scan

#: Bytes of text in a file, and the end id.
FILE, END = 4_000_000, 2


def make_file(tokenizer: str, end: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("digest", "ascending")], null_placement="at_start")
        ids, counts = encoder(tokenizer).flat(rows["text"].combine_chunks(), end)
        raw = rans.write_file(rows["doc_id"].to_pylist(), counts, ids)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([raw], pa.binary())], names=["part", "n_ids", "file"])

    return run


def write_files(spark: SparkSession, documents: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Writes the ids of documents(doc_id, text, ...), in ascending doc_id, each with the end id, as files under path.

    Null texts are empty; a null doc_id comes first; rows of equal doc_id follow in order of their texts' hashes. A text that holds
    a special token's string has that token's id there, as the plain call of the library gives it.
    """
    rows = ordered_ranges(spark, ordered(documents), FILE).select("doc_id", "text", "digest", "bucket")
    files = rows.groupBy("bucket").applyInArrow(make_file(tokenizer, end), "part long, n_ids long, file binary")
    files.write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files: start counts the ids of all documents before."""
    files = spark.read.parquet(path)
    before = scan(files.select("part", "n_ids"), [], ["part"], {"upto": F.col("n_ids")}).select("part", (F.col("upto") - F.col("n_ids")).alias("before"))
    return files.select("part", "file").join(before, "part").select("before", "file").mapInArrow(documents_of, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, raw in zip(batch.column("before").to_pylist(), batch.column("file"), strict=True):
            docs, counts, ids = rans.read_file(raw.as_py())
            data, edge = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            own = [data[4 * a : 4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(edge[:-1] + before), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
            )

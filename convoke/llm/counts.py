"""Token counts as rollups that are maintained by signed deltas.

A batch of changes to documents - inserts, deletes and revisions - becomes signed counts by source, language and tokenizer
version, which are added to the totals. Totals are the sum of the newest snapshot and of the deltas committed since, so that
reading them doesn't grow with the history. A batch is committed by writing its delta to a folder of the attempt's own and
renaming that to the batch's: a repeated commit finds the batch and changes nothing, of two writers one wins, and a task or driver
that is lost leaves no trace. The first level of aggregation is map-side, so a hot source costs one row a task.
"""

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import text as T
from convoke.llm.tokens import encoder

#: Bytes of text that are encoded at a time.
SLICE = 4_000_000
KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = ["n_docs", "n_chars", "n_tokens"]
SPACE = r"[\x20\x09-\x0D]+"


def words_v1(text: Column) -> Column:
    """Tokens are runs of characters other than space and the controls 9 to 13."""
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def words_v2(text: Column) -> Column:
    """As words_v1, with each of , . ; : ! ? counted as a token of its own: characters that are one of them, and words that have any other."""
    marks = F.length(text) - F.length(F.translate(text, ",.;:!?", ""))
    return (marks + words_v1(F.translate(text, ",.;:!?", "      "))).cast("long")


WORDS = {"words_v1": words_v1, "words_v2": words_v2}
COUNTED = "doc_id long, source string, lang string, tokenizer_version string, n_docs long, n_chars long, n_tokens long"


def counted(documents: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """(doc_id, keys, totals) for each row of documents(doc_id, text, source, lang, ...).

    Tokens are those of the tokenizers library's file at path, without special tokens; without a path, version names one of
    WORDS. A null text counts as empty; null sources and languages are groups of their own; repeated rows and rows with a null
    doc_id each count.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version")]
    totals = [F.lit(1).cast("long").alias("n_docs"), F.length(text).cast("long").alias("n_chars")]
    if path is None:
        return documents.select(*keys, *totals, WORDS[version](text).alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in T.slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE):
                n = encoder(path).flat(texts.slice(a, b - a))[1]
                part = batch.slice(a, b - a).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*part.schema.names, "n_tokens"])

    return documents.select(*keys, *totals, text).mapInArrow(run, COUNTED)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*KEYS, *[(F.col(c) * sign).alias(c) for c in TOTALS])


def delta(inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Signed counts by key; a revision is a delete of the old counts and an insert of the new ones."""
    parts = [signed(df, s) for df, s in ((inserts, 1), (deletes, -1)) if df is not None]
    if not parts:
        raise ValueError("a batch needs inserts or deletes")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])


SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_chars long, n_tokens long"


class Rollup:
    """A folder of committed deltas (batch=<id>/data) and of snapshots (snapshot=<number>/data/totals, .../batches).

    Both are written to a hidden folder of the attempt's own and renamed to data. A rename that comes second finds data there and
    ends up hidden inside it, which readers skip, so that the first writer of an id wins; this needs a store whose rename of a folder
    is atomic, as HDFS and local disks have.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, kind: str) -> list[str]:
        """What follows kind= in the names of the complete folders of that kind."""
        if not self.fs.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self._at("")) if x.isDirectory()]
        return sorted(n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}=") and self.fs.exists(self._at(f"{n}/data")))

    def _publish(self, name: str, attempt: str) -> bool:
        """Renames the attempt to data; whether it was the first."""
        if self.fs.exists(self._at(f"{name}/data")):
            self.fs.delete(self._at(f"{name}/{attempt}"), True)
            return False
        self.fs.rename(self._at(f"{name}/{attempt}"), self._at(f"{name}/data"))
        return not self.fs.exists(self._at(f"{name}/data/{attempt}"))

    def committed(self) -> list[str]:
        return self._names("batch")

    def commit(self, batch: str, change: DataFrame) -> bool:
        """Adds the batch's delta; False, and nothing done, if that id is committed already."""
        if not batch.isidentifier():
            raise ValueError(f"not a batch id: {batch}")
        if batch in self.committed():
            return False
        attempt = f"_attempt-{uuid.uuid4().hex}"
        change.write.parquet(f"{self.path}/batch={batch}/{attempt}")
        return self._publish(f"batch={batch}", attempt)

    def _newest(self) -> tuple[str | None, set[str]]:
        """(folder of the newest snapshot, the batches that it holds)."""
        numbers = [int(n) for n in self._names("snapshot")]
        if not numbers:
            return None, set()
        folder = f"{self.path}/snapshot={max(numbers)}/data"
        return folder, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{folder}/batches").collect()}

    def _summed(self, folder: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batch={b}/data" for b in batches] + ([f"{folder}/totals"] if folder else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])
        return summed.where(" or ".join(f"{c} <> 0" for c in TOTALS))

    def totals(self) -> DataFrame:
        """The current totals; keys whose documents are all gone have no row."""
        folder, held = self._newest()
        return self._summed(folder, [b for b in self.committed() if b not in held])

    def compact(self) -> bool:
        """Adds the deltas committed since the newest snapshot to it, as a new one; False if there are none. Deltas stay, so that their ids are known."""
        folder, held = self._newest()
        new = [b for b in self.committed() if b not in held]
        if not new:
            return False
        number = int(folder.split("snapshot=")[1].split("/")[0]) + 1 if folder else 1
        attempt = f"_attempt-{uuid.uuid4().hex}"
        base = f"{self.path}/snapshot={number}/{attempt}"
        self._summed(folder, new).write.parquet(f"{base}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(held | set(new))], "batch string").coalesce(1).write.parquet(f"{base}/batches")
        return self._publish(f"snapshot={number}", attempt)

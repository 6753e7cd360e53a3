"""A corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's input."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import jaccard, language, packing, quality, repeats
from convoke.llm.scratch import Scratch


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(columns(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of good quality stay.

    Null and empty texts are judged like any other; rows without a doc_id stay; rows of equal doc_id go together if one of them is
    rejected. Where nothing can be learnt, what the score for all is worth decides: 0.5, or the base rate. Columns keep their names
    and values, whatever they are called, and an empty table gives an empty one.
    """
    scores = quality.quality_scores(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scores.where("predicted = 0"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages stay; texts without letters, and those less like each language than labelled texts of as many n-grams are, go.

    Null and empty texts have no letters and go. Rows without a doc_id stay; rows of equal doc_id go together. Columns keep their
    names and values, and an empty table gives an empty one.
    """
    found = Scratch(spark, "language").write(language.sized_languages(spark, docs), "found")
    return without(docs, found.where((F.col("lang_pred") == language.UND) | (F.col("score") < language.floor_of(found))))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays.

    Texts without words are in no group and stay, as do rows without a doc_id. Rows of equal doc_id are one document: all stay or
    all go. Columns keep their names and values, and an empty table gives an empty one.
    """
    return without(docs, jaccard.jaccard_components(spark, docs).where("doc_id <> component_id"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go.

    Texts without such a passage stay as they are, null and empty ones too; n_chars, if there is such a column, follows the new text.
    Rows without a doc_id are later than all others; rows of equal doc_id are not earlier than each other. Other columns keep their
    names and values, and an empty table gives an empty one.
    """
    out = repeats.remove_repeats(spark, docs).where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    kept = []
    for field in docs.schema.fields:
        value = F.col("rest").getField(field.name)
        changed = new[field.name].cast(field.dataType) if field.name in new else None
        kept.append((value if changed is None else F.when(cut, changed).otherwise(value)).alias(field.name))
    return out.select(kept)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; null and empty texts are their end id, and an empty table gives no pieces."""
    return packing.packed(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("packing", pack)]

#: Trained models and exact set joins have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if i + 1 == len(STAGES) else scratch.write(made, name)
    return docs

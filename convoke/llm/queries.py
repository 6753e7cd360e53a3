"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import alignment, conversations, counts, fingerprints, jaccard, language, mixing, packing, quality, repeats, token_files, transducer, vectors
from convoke.llm.scratch import Scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(spark, documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
MARKS = "length(coalesce(text, '')) - length(translate(coalesce(text, ''), ',.;:!?', ''))"
SQL["word_counts"] = f"""
with d as (select *, length(coalesce(text, '')) as chars, len({WORDS}) as v1,
    {MARKS} + len({WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), ',.;:!?', '      ')")}) as v2 from documents),
r as (select source, lang, 'words_v1' as tokenizer_version, chars, v1 as tokens from d where doc_id % 10 not in (3, 7)
    union all select source, lang, 'words_v2', chars, v2 from d where doc_id % 10 = 7)
select source, lang, tokenizer_version, count(*) as n_docs, sum(chars)::bigint as n_chars, sum(tokens)::bigint as n_tokens from r group by all
"""


def revised_counts(spark: SparkSession, docs: DataFrame, one: tuple, two: tuple) -> DataFrame:
    """All documents are inserted, counted by version one; then those whose id ends in 3 are deleted, and those that end in 7 are counted anew by version two; that second batch is committed twice, and a snapshot made between."""
    rollup = counts.Rollup(spark, f"{Scratch(spark, 'counts').base}/rollup")
    rollup.commit("load", counts.delta(inserts=counts.counted(docs, *one)))
    change = counts.delta(inserts=counts.counted(docs.where("doc_id % 10 = 7"), *two), deletes=counts.counted(docs.where("doc_id % 10 in (3, 7)"), *one))
    for _ in range(2):
        rollup.commit("revision", change)
        rollup.compact()
    return rollup.totals()


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two public tokenizers: see revised_counts."""
    versions = [(name, public_tokenizers.path(f"{name}.json")) for name in ("byte_bpe_50k", "word_bpe_49k")]
    return revised_counts(spark, documents(spark, sf_dir), *versions)


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup by two versions of words, which SQL can count: see revised_counts."""
    return revised_counts(spark, documents(spark, sf_dir), ("words_v1",), ("words_v2",))


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, documents(spark, sf_dir))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(spark, documents(spark, sf_dir))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark, table(spark, sf_dir, "embeddings"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(spark, documents(spark, sf_dir))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').base}/files"
    token_files.write_files(spark, documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_files(spark, path).drop("ids")


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = transducer.decoded(transducer.encoded(documents(spark, sf_dir), model), model)
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


SQL["op12_mixing"] = f"""
with t as (select doc_id, source, ('0x' || md5(coalesce(text, ''))[1:15])::bigint as digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
c as (select *, row_number() over (partition by doc_id, source, digest, size) - 1 as n, greatest(1, least({mixing.COPIES}, {mixing.TOGETHER} // greatest(size, 1))) as most from t),
d as (select *, n // most as chunk, n % most as copy from c),
p as (select *, ('0x' || md5(coalesce(doc_id::varchar, 'null') || ':' || digest || ':' || chunk)[1:15])::bigint as spot from d),
s as (select source, sum(size)::bigint as source_size, [{", ".join(map(str, mixing.WEIGHTS))}][1 + (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}] as weight from t group by source),
o as (select *, row_number() over (order by source_size / weight, source nulls last) as i, sum(source_size) over () as words, sum(weight) over () as weights from s),
l as (select *, ({mixing.SHARE} * words - {mixing.MOST} * coalesce(sum(source_size) over (order by i rows between unbounded preceding and 1 preceding), 0)) / (weights - coalesce(sum(weight) over (order by i rows between unbounded preceding and 1 preceding), 0)) as level from o),
v as (select case when max(words) = 0 then 0.0 else arg_min(level, i) filter (weight * level < {float(mixing.MOST)} * source_size) end as level from l),
g as (select source, source_size, least({float(mixing.MOST)} * source_size, v.level * weight)::double as target from s, v),
q as (select p.*, source_size, target, floor(target)::bigint as words, sum(size) over (partition by p.source order by spot, doc_id nulls first, digest, size, chunk, copy rows unbounded preceding) - size as start
    from p join g on p.source is not distinct from g.source)
select doc_id, size, source_size, target, (case when size = 0 then 0 else words // source_size * size + greatest(0, least(start + size, words % source_size) - start) end)::bigint as taken from q
"""


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, documents(spark, sf_dir))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked_counts(spark, documents(spark, sf_dir), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(spark, table(spark, sf_dir, "conversations"))

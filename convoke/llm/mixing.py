"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot i of the schedule has the point i * g modulo 2^64, for g the golden ratio's fraction in 64 bits. The sources' targets, one
after another, cut the unit interval into shares, and a point belongs to the source whose share it falls in, so that any run of
slots holds each source in about its proportion. The slots of a source are ranked in order, and slot number r takes block r of
that source, round after round. A source's words lie one after another with its documents shuffled by a hash, and a block
has BLOCK of them; the last block that a target reaches is taken in part, so that a source gives its target to the word.
The points leave a source a few slots too many or too few, as their discrepancy grows with the logarithm of their number:
those too many are left out, those too few come at the end of the schedule.

The place of a document in a source is a running total over ranges of the hash: no source, however hot, is sorted as a whole.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm.scratch import Scratch
from convoke.operators.scan import scan

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, copies of a row and words of these that stay together.
BLOCK, COPIES, TOGETHER = 2048, 65536, 1 << 26
#: The golden ratio's fraction in 64 bits; bits of a hash that order a source's documents.
GOLDEN, BITS = 0x9E3779B97F4A7C15, 60


def bits(text: Column) -> Column:
    """The first 60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def kinds(documents: DataFrame) -> DataFrame:
    """(doc_id, source, digest, size, copies): documents that are equal in all of these are one row; they are added up before they are shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), bits(text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("copies"))


def water_level(sources: DataFrame, share: float, most: float) -> float:
    """Words for a unit of weight, where no source gives more than most times its words, and all together share of all words.

    Each pass takes the sources that would give more at their most, and shares what they can't give among the others. The level only rises.
    """
    all_of = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if not all_of["words"]:
        return 0.0
    full, level = -1, share * all_of["words"] / all_of["weight"]
    while True:
        over = sources.where(F.col("weight") * F.lit(level) >= F.lit(float(most)) * F.col("source_size"))
        s = over.agg(F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        if s["n"] == full or s["weight"] == all_of["weight"]:
            return level
        full, level = s["n"], (share * all_of["words"] - most * s["words"]) / (all_of["weight"] - s["weight"])


def targets(scratch: Scratch, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rows, target, words, low, high): of all sources, in order of their code points, null last, weighing weights in turn. words is the target in whole words, [low, high) the source's part of the unit interval."""
    s = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows")).withColumn("last", F.col("source").isNull())
    s = scratch.write(scan(s, [], ["last", "source"], {"place": F.lit(1)}), "sources")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(water_level(s, share, most)) * F.col("weight")))
    s = scan(s.withColumn("words", F.floor("target").cast("long")), [], ["place"], {"upto": F.col("words")}, totals={"every": F.col("words")})
    part = lambda x: x / F.greatest("every", F.lit(1))
    return scratch.write(s.select("source", "source_size", "rows", "target", "words", part(F.col("upto") - F.col("words")).alias("low"), part(F.col("upto")).alias("high")), "targets")


def schedule(scratch: Scratch, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, block, limit): which block of which source comes when, and how far into the source's words it may go.

    A source of w words, of s there are, has as many slots as it needs blocks: whole rounds of s words, and in the last round
    those up to its limit. A point's source is the last whose share begins before it, carried along the points in order.
    """
    blocks = F.ceil(F.col("source_size") / block)
    use = sources.where("words > 0").withColumns({"blocks": blocks, "rounds": F.floor(F.col("words") / F.col("source_size")), "rest": F.col("words") % F.col("source_size")})
    use = use.withColumn("need", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block))
    n = use.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    number, turn = F.col("id").cast("decimal(18,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    points = scratch.spark.range(n).select((F.pmod(number, turn).cast("double") / float(1 << 64)).alias("point"), F.col("id").alias("slot"), F.lit(None).cast("struct<source: string>").alias("of"))
    begins = use.select(F.col("low").alias("point"), F.lit(-1).cast("long").alias("slot"), F.struct("source").alias("of"))
    dealt = scan(points.unionByName(begins), [], ["point", "slot"], lasts={"whose": F.col("of")}).where("slot >= 0").select("slot", "whose.source")
    ranked = scan(dealt, ["source"], ["slot"], {"rank": F.lit(1)})
    have = ranked.groupBy("source").agg(F.count("*").alias("have"))
    wanted = use.select("source", "source_size", "blocks", "rounds", "rest", "need")
    known = wanted.join(have, wanted["source"].eqNullSafe(have["source"]), "left").drop(have["source"]).withColumn("have", F.coalesce("have", F.lit(0)))
    late = known.where("need > have").select("source", "source_size", "blocks", "rounds", "rest", F.explode(F.sequence(F.col("have") + 1, F.col("need"))).alias("rank"))
    late = late.withColumn("slot", F.lit(n) + F.col("rank"))
    timely = ranked.join(wanted, ranked["source"].eqNullSafe(wanted["source"])).drop(wanted["source"]).where("rank <= need").drop("need")
    r = F.col("rank") - 1
    limit = F.when(F.floor(r / F.col("blocks")) < F.col("rounds"), F.col("source_size")).otherwise(F.col("rest"))
    return timely.unionByName(late).select("slot", "source", (r % F.col("blocks")).alias("block"), limit.alias("limit"))


def pieces(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents cut at the ends of their source's blocks: (doc_id, source, digest, size, chunk, copy, block, start, first, last).

    start is the document's place in its source's words, [first, last) the piece's. A document without words has one piece, in block -1.
    Copies are dealt in chunks, each of which has a place of its own, so that a text that is repeated a billion times is no task's.
    """
    most = F.greatest(F.lit(1), F.least(F.lit(COPIES), F.floor(F.lit(TOGETHER) / F.greatest("size", F.lit(1))))).cast("long")
    rows = docs.withColumn("most", most).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.col("most")).cast("long"))))
    rows = rows.withColumn("copies", F.least("most", F.col("copies") - F.col("chunk") * F.col("most"))).drop("most")
    rows = rows.withColumn("spot", bits(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", "chunk")))
    full, none = rows.where("size > 0"), rows.where("size = 0")
    full = scan(full, ["source"], ["spot", "doc_id", "digest", "size", "chunk"], {"upto": F.col("size") * F.col("copies")})
    full = full.withColumn("start", F.col("upto") - F.col("size") * F.col("copies"))
    one = lambda df: df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    full = one(full).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    full = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    full = full.withColumns({"first": F.greatest("start", F.col("block") * block), "last": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)})
    nothing = {c: F.lit(v).cast("long") for c, v in {"start": 0, "block": -1, "first": 0, "last": 0}.items()}
    columns = ["doc_id", "source", "digest", "size", "chunk", "copy", "block", "start", "first", "last"]
    return full.select(columns).unionByName(one(none).withColumns(nothing).select(columns))


def mixture(slots: DataFrame, cut: DataFrame, how: str = "inner") -> DataFrame:
    """The mix: the pieces, each with its slot, and the words [begin, end) of its document that come there. A block comes once a round. With how 'left', pieces that the mix leaves out stay, without a slot."""
    s = slots.select("slot", F.col("source").alias("of"), F.col("block").alias("at"), "limit")
    met = cut.join(s, cut["source"].eqNullSafe(s["of"]) & (cut["block"] == s["at"]), how).drop("of", "at")
    end = F.least("last", "limit")
    return met.withColumns({"begin": F.col("first") - F.col("start"), "end": F.greatest("first", end) - F.col("start")}).drop("limit")


def mixed(spark: SparkSession, documents: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of documents(doc_id, text, source, ...).

    A null or empty text has no words and gives none; a null source comes after all others. Rows of equal or null doc_id are documents
    of their own. Sources without words have a target of 0, and what they would have given is shared by the others. taken
    adds up to the target's whole words in each source, and is at most most times the document's size, rounded up. An empty table gives no rows. The
    mix depends on the rows only, not on their order or partitions.
    """
    scratch = Scratch(spark, "mixing")
    docs = scratch.write(kinds(documents), "documents")
    sources = targets(scratch, docs, weights, share, most)
    slots = scratch.write(schedule(scratch, sources, block), "slots")
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("end") - F.col("begin")).otherwise(0))
    out = mixture(slots, pieces(docs, block), "left").groupBy("doc_id", "source", "digest", "size", "chunk", "copy").agg(taken.alias("taken"))
    s = sources.select(F.col("source").alias("of"), "source_size", "target")
    return out.join(s, out["source"].eqNullSafe(s["of"])).select("doc_id", "size", "source_size", "target", "taken")

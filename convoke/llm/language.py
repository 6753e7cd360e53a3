"""Language identification by hyperdimensional profiles.

A letter (and the space between words) has a random vector of DIM signs. An n-gram binds its letters' vectors, each permuted
by its place, by multiplication. A text's vector bundles (adds) the vectors of all its n-grams, and a language's prototype
those of all its texts. A text has the language whose prototype has the largest cosine with it.

Bundling is linear, so a batch's share of a prototype is made from the batch's n-gram counts. What comes to the driver is one vector a language.
"""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import text as T

#: Signs of a vector, letters of an n-gram, characters of texts in hand at a time (a short text counts as SHORT), n-grams whose vectors are.
DIM, GRAM, SLICE, SHORT, BLOCK = 1024, 3, 1_000_000, 256, 8192
#: floors(): sizes for each doubling of the n-grams, and how many in all; texts that a size needs; the quantile of their scores, and the part of it that is the floor.
SIZES_EACH, SIZES, ENOUGH, LOW, PART = 2, 64, 20, 0.01, 0.6
UND = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(i))[0] == "L" if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)])
    return _letters


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of DIM signs for each code point, the same in every process."""
    bits = T.mix(points.astype(np.uint64)[:, None] * np.uint64(0x2545F4914F6CDD1D) + np.arange(DIM // 64, dtype=np.uint64))
    return (np.unpackbits(T.mix(bits).view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * 2) - 1


class Grams:
    """n-grams of a run of texts: for each text which it has, how often. Vectors are made for BLOCK distinct ones at a time, whatever the script."""

    def __init__(self, texts: list[str]):
        parts = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
        flat = np.concatenate([np.concatenate([p, [32]]) for p in parts]) if parts else np.zeros(0, np.uint32)
        of = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
        letter = letters()[flat]
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (of[1:] == of[:-1])  # one space after each word
        start = np.append(True, of[1:] != of[:-1])[keep.nonzero()[0]] if len(flat) else np.zeros(0, bool)
        points = np.where(letter, flat, 32)[keep]
        of = of[keep]
        self.alphabet, code = np.unique(points, return_inverse=True)
        size = len(self.alphabet)
        # a space before each text's first word
        edge = np.append(True, of[1:] != of[:-1]) if len(of) else start
        space = int(np.searchsorted(self.alphabet, 32))
        at = np.flatnonzero(edge)
        code, of = np.insert(code, at, space), np.insert(of, at, of[at])
        gram = np.zeros(max(0, len(code) - GRAM + 1), np.int64)
        for k in range(GRAM):
            gram = gram * size + code[k : len(code) - GRAM + 1 + k]
        inside = of[GRAM - 1 :] == of[: len(gram)]
        gram, of = gram[inside], of[: len(gram)][inside]
        cut = np.searchsorted(of, np.arange(len(parts) + 1))
        self.own = [np.unique(gram[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.grams = np.unique(np.concatenate([g for g, _ in self.own])) if self.own else gram
        self.base = letter_vectors(self.alphabet) if size else np.ones((1, DIM), np.int8)
        self.has_letter = np.array([len(g) > 0 for g, _ in self.own], bool)

    def vectors(self, a: int, b: int) -> np.ndarray:
        """The vectors of the distinct n-grams number a to b."""
        rest, size = self.grams[a:b], max(1, len(self.alphabet))
        v = np.ones((len(rest), DIM), np.int8)
        for k in range(GRAM):
            v *= np.roll(self.base, k, axis=1)[rest % size]
            rest = rest // size
        return v.astype(np.float32)

    def bundles(self) -> np.ndarray:
        """The vector of each text."""
        out = np.zeros((len(self.own), DIM), np.float32)
        for a in range(0, len(self.grams), BLOCK):
            v = self.vectors(a, a + BLOCK)
            lowest, highest = self.grams[a], self.grams[min(a + BLOCK, len(self.grams)) - 1]
            for i, (g, c) in enumerate(self.own):
                x, y = np.searchsorted(g, lowest), np.searchsorted(g, highest, side="right")
                if x < y:
                    out[i] += c[x:y].astype(np.float32) @ v[np.searchsorted(self.grams[a : a + BLOCK], g[x:y])]
        return out

    def bundle_all(self, which: list[int]) -> np.ndarray:
        total = np.zeros(len(self.grams), np.int64)
        for i in which:
            g, c = self.own[i]
            total[np.searchsorted(self.grams, g)] += c
        out = np.zeros(DIM, np.float64)
        for a in range(0, len(self.grams), BLOCK):
            out += total[a : a + BLOCK].astype(np.float64) @ self.vectors(a, a + BLOCK)
        return np.rint(out).astype(np.int64)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in T.slices(np.array([max(SHORT, len(t)) for t in texts], np.int64), SLICE):
            yield batch.slice(a, b - a), Grams(texts[a:b])


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (lang, vector): what these texts add to each prototype; one row a language for each input partition."""
    total: dict[str, np.ndarray] = {}
    for batch, grams in sliced(batches):
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            v = grams.bundle_all([i for i, x in enumerate(langs) if x == lang])
            total[lang] = total.get(lang, 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "vec"])


def predict(shared, sized: bool = False):
    """Batches of (doc_id, text) -> (doc_id, lang_pred, score); if sized, (doc_id, text, lang) -> also lang and the number of distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        for batch, grams in sliced(batches):
            lang, score, bundles = [], [], grams.bundles()
            for i in range(batch.num_rows):
                if not grams.has_letter[i] or not names:
                    lang.append(UND)
                    score.append(0.0)
                    continue
                v = bundles[i]
                cos = unit @ v / max(float(np.linalg.norm(v)), 1e-9)
                k = int(np.argmax(cos))
                lang.append(names[k])
                score.append(float(min(1.0, max(0.0, cos[k]))))
            columns = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            if sized:
                columns |= {"lang": batch.column("lang"), "n_grams": pa.array([len(g) for g, _ in grams.own], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def held_out(ids: Column) -> Column:
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors of the languages of the rows that aren't held out and have a language."""
    learnt = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    parts = learnt.mapInArrow(shares, "lang string, vec array<long>").select("lang", F.posexplode("vec").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = sorted((r["lang"], [c["x"] for c in r["v"]]) for r in sums.collect())
    unit = np.array([v for _, v in rows], np.float64).reshape(len(rows), DIM) if rows else np.zeros((0, DIM))
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    ok = norm[:, 0] > 0
    return [n for (n, _), good in zip(rows, ok, strict=True) if good], (unit[ok] / norm[ok]).astype(np.float32)


def languages(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of documents(doc_id, text, lang, ...).

    A text that is null or has no letter is und with score 0, as is every text if nothing could be learnt. The first name
    wins ties. Rows with a null doc_id aren't held out.
    """
    shared = spark.sparkContext.broadcast(prototypes(documents))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(predict(shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def sized_languages(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, lang, n_grams) for each row of documents(doc_id, text, lang, ...): as languages(), with the row's label and how many distinct n-grams the text has."""
    shared = spark.sparkContext.broadcast(prototypes(documents))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return docs.mapInArrow(predict(shared, sized=True), "doc_id long, lang_pred string, score double, lang string, n_grams long")


def floor_of(found: DataFrame) -> Column:
    """The least score of a text in a known language, by its number of distinct n-grams, for rows of sized_languages().

    The more n-grams, the nearer a text is to its language; one that repeats a word has few distinct ones. So the floor of each
    size is PART of the LOW quantile of the scores of the labelled texts that aren't held out, and at least three standard
    deviations of a cosine's noise below it; a few wrongly labelled texts don't set it. A size with fewer than ENOUGH texts has the floor of the next smaller one, and 0, which rejects nothing, where
    there is none. One number a size comes to the driver.
    """
    size = F.least(F.lit(SIZES - 1), F.floor(SIZES_EACH * F.log2(F.greatest(F.col("n_grams"), F.lit(1)))).cast("int"))
    genuine = found.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != UND))
    low = {r["size"]: max(0.0, min(PART * r["low"], r["low"] - 3 / DIM**0.5)) for r in genuine.groupBy(size.alias("size")).agg(F.count("*").alias("c"), F.percentile_approx("score", LOW).alias("low")).where(F.col("c") >= ENOUGH).collect()}
    floors = [0.0]
    for k in range(SIZES):
        floors.append(low.get(k, floors[-1]))
    return F.element_at(F.array(*[F.lit(x) for x in floors[1:]]), size + 1)

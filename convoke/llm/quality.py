"""Quality classifier: a sparse ensemble of rules over statistics of a text.

1. One pass over the whole texts makes a row of statistics a document.
2. Small trees are grown on random parts of the labelled sample; each path from a root to a node is a rule, a conjunction of
   comparisons. A logistic model with an L1 penalty on the rules' 0/1 columns keeps a few of them.
3. The kept rules are compiled into one Spark column expression over the statistics.

The sample is at most SAMPLE labelled rows, those with the smallest hash of doc_id, and only the statistics (a few doubles a
row) of about twice as many come to the driver. Labels and ids are not inputs of a score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import text as T
from convoke.llm.scratch import Scratch

SAMPLE, TREES, DEPTH, PENALTY, SEED = 20_000, 40, 3, 2e-3, 7
SLICE = 2 << 20

CLASS = np.zeros(256, np.uint8)
CLASS[65:91] = 1
CLASS[97:123] = 2
CLASS[128:] = 2
CLASS[48:58] = 3
CLASS[[*b"#$%&*@^~=<>\\"]] = 4
CLASS[ord("!")] = 5
CLASS[[*b"|{}[]"]] = 6
CLASS[[*b".,;:?'\"()-"]] = 7
STATS = ["n_words", "word_len", "upper", "digit", "symbol", "bang", "bar", "mark", "alpha", "distinct", "top", "repeat", "symbol_end", "upper_first", "short", "long", "line_words", "lines_same"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text; all 0 for one without words."""
    out = []
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in T.slices(lengths, SLICE):
        w = T.words(texts.slice(a, b - a))
        n = w.count()
        one = np.maximum(n, 1)
        cum = {}
        kind = CLASS[w.data]
        edges = [np.append(w.start, len(w.data))[w.doc[:-1]], np.append(0, w.end)[w.doc[1:]]]
        edges[1] = np.maximum(edges[0], edges[1])
        for k in range(1, 8):
            c = np.zeros(len(kind) + 1, np.int64)
            np.cumsum(kind == k, out=c[1:])
            cum[k] = c[edges[1]] - c[edges[0]]
        word_len = w.end - w.start
        size = np.maximum(1, sum_by(word_len, w.doc))
        ends = np.isin(kind[w.end - 1], [4, 5])
        tops, distinct = np.zeros(b - a), np.zeros(b - a)
        for i in range(b - a):
            if n[i]:
                _, c = np.unique(w.hash[w.doc[i] : w.doc[i + 1]], return_counts=True)
                tops[i], distinct[i] = c.max() / n[i], len(c) / n[i]
        same = np.zeros(len(w.hash))
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[w.doc[:-1][n > 0]] = 0
        newline = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(w.data == 10, out=newline[1:])
        lines = newline[edges[1]] - newline[edges[0]] + 1
        rows = [
            np.log1p(n), size / one, cum[1] / size, cum[3] / size, cum[4] / size, cum[5] / one, cum[6] / one, cum[7] / one, (cum[1] + cum[2]) / size, distinct, tops, sum_by(same, w.doc) / one,
            sum_by(ends, w.doc) / one, sum_by(kind[w.start] == 1, w.doc) / one, sum_by(word_len <= 2, w.doc) / one, sum_by(word_len >= 20, w.doc) / one, np.log1p(n / lines), lines_same(w, b - a),
        ]
        out.append(np.where(n > 0, np.stack(rows), 0.0).T)
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def sum_by(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1)
    np.cumsum(x, out=c[1:])
    return c[doc[1:]] - c[doc[:-1]]


def lines_same(w: T.Words, docs: int) -> np.ndarray:
    """The share of a document's lines of words that it has more than once."""
    out = np.zeros(docs)
    if not len(w.hash):
        return out
    line = np.cumsum(w.data == 10)[w.start]
    of = np.searchsorted(w.doc, np.arange(len(w.hash)), side="right") - 1
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (of[1:] != of[:-1])))
    code = T.run_hashes(w.hash, np.diff(np.append(first, len(w.hash)))) ^ T.mix(of[first].astype(np.uint64))
    _, back, c = np.unique(code, return_inverse=True, return_counts=True)
    again = np.bincount(of[first], c[back] > 1, docs)
    return again / np.maximum(1, np.bincount(of[first], minlength=docs))


def with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(len(STATS)))], names=["doc_id", *STATS])


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Rules:
    """score = logistic(base + sum of the weights of the rules that hold); a rule's terms are (statistic, above, cut)."""

    base: float
    rules: list[Rule]
    weights: list[float]

    def expression(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for stat, above, cut in rule:
                holds = holds & (F.col(STATS[stat]) > cut if above else F.col(STATS[stat]) <= cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for stat, above, cut in rule:
        ok &= x[:, stat] > cut if above else x[:, stat] <= cut
    return ok


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], stats: np.ndarray, depth: int, path: Rule, found: set[Rule]) -> None:
    """Adds the paths of a tree that splits by Gini impurity, among the given statistics and cuts."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = None
    for s in stats:
        c = cuts[s]
        if not len(c):
            continue
        place = np.searchsorted(c, x[:, s])
        total, ones = np.bincount(place, minlength=len(c) + 1).cumsum()[:-1], np.bincount(place, y, len(c) + 1).cumsum()[:-1]
        left, right = total, len(y) - total
        ok = (left >= 5) & (right >= 5)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ones**2 / left + (left - ones) ** 2 / left + (y.sum() - ones) ** 2 / right + (right - y.sum() + ones) ** 2 / right
        if ok.any():
            k = int(np.argmax(np.where(ok, gain, -1)))
            if best is None or gain[k] > best[0]:
                best = (gain[k], s, float(c[k]))
    if best is None:
        return
    _, s, cut = best
    for above in (False, True):
        rule = (*path, (int(s), above, cut))
        found.add(tuple(sorted(rule)))
        side = (x[:, s] > cut) == above
        grow(x[side], y[side], cuts, stats, depth - 1, rule, found)


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Fits rules to statistics and 0/1 labels; of one label only, a constant; where no rule splits them, the base rate. A fixed seed: equal samples give equal models."""
    if not len(y) or y.min() == y.max():
        return Rules(0.0 if not len(y) else (4.0 if y[0] else -4.0), [], [])
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0.02, 0.98, 49))) for s in range(x.shape[1])]
    found: set[Rule] = set()
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), 4000))
        grow(x[rows], y[rows].astype(float), cuts, rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False), DEPTH, (), found)
    rules = sorted(found)
    z = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    keep = np.flatnonzero((z.mean(0) > 0.002) & (z.mean(0) < 0.998))
    z, rules = z[:, keep], [rules[k] for k in keep]
    w, base = np.zeros(z.shape[1], np.float64), float(np.log(y.mean() / (1 - y.mean())))
    if not rules:  # too few rows for a split, or statistics that don't differ
        return Rules(base, [], [])
    step, v, vb, t = 4.0 / (np.linalg.norm(z.T @ z / len(y), 2) + 1), w.copy(), base, 1.0
    for _ in range(400):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(z @ v + vb)))
        g = (p - y) / len(y)
        new = v - step * (z.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_base = vb - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, t = new + (t - 1) / t2 * (new - w), new_base + (t - 1) / t2 * (new_base - base), t2
        w, base = new, new_base
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(float(base), [rules[k] for k in used], [float(w[k]) for k in used])


def held_out(ids: Column) -> Column:
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def least_hashes(stats: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """(y, *STATS) of the sample rows with the smallest hash of doc_id that stats(doc_id, *STATS) and known(doc_id, y) share.

    Both sides are cut to the share of all hashes that should hold twice the sample, before they meet, so that what is joined and
    collected stays at that size whatever the number of labels. A share that holds too few is widened, up to all hashes: the rows
    are the same as those of sorting all of them.
    """
    share = min(1.0, 2 * sample / max(1, known.count()))
    while True:
        within = F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63)))
        both = stats.where(within).join(known.where(within), "doc_id")
        if share == 1 or both.count() >= sample:
            return both.orderBy(F.xxhash64("doc_id"), *STATS).limit(sample).select("y", *STATS)
        share = min(1.0, 4 * share)


def quality_scores(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of documents(doc_id, text, ...); labels(doc_id, quality, ...).

    Learns from labelled rows that aren't held out. Texts that are null, empty or without words have statistics of 0 and a
    score like any other. Documents with several different labels, null labels or null ids aren't learnt from. Without usable labels
    all scores are 0.5; of one label only, all near it; where no rule can be learnt (too few rows, constant statistics), all are the base rate.
    """
    scratch = Scratch(spark, "quality")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = scratch.write(docs.mapInArrow(with_statistics, "doc_id long, " + ", ".join(f"{s} double" for s in STATS)), "statistics")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").drop("y2")
    picked = least_hashes(stats.where(~held_out(F.col("doc_id"))), known.where(~held_out(F.col("doc_id"))), sample).toPandas()
    model = fit(picked[STATS].to_numpy("float64"), picked["y"].to_numpy("int64"))
    score = model.expression()
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

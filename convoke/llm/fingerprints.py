"""Fingerprints of documents: a homomorphic multiset hash of their paragraphs.

A paragraph (a line that is not blank, without blanks at its ends) hashes to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, each element modulo a power of two. Sums don't depend on order, and a paragraph is inserted
or deleted by adding or subtracting its vector. Two parts:

* EXACT elements of 64 bits, independent parts of the whole paragraph's BLAKE2b digest: equal multisets of paragraphs have
  equal parts, others differ but for a chance of 2^-64 an element. One more element, of the text as it is, tells texts apart that differ only in blanks
  or the order of paragraphs; equality of multisets ignores it.
* LIKE elements of 32 bits, hashed from the paragraph's runs of RUN words, each run adding +1 or -1 to one element: sums of
  this part estimate how much two documents share, also inside a changed paragraph.

Likeness is the cosine of the LIKE parts, as signed numbers, cut to 0..1, and 1 for equal exact parts.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoke.llm import text as T
from convoke.llm.ranges import ordered, ordered_ranges
from convoke.llm.scratch import Scratch

EXACT, LIKE, RUN = 8, 128, 3
#: Bytes of text in a range of documents.
RANGE = 4_000_000


class Fingerprint:
    """exact: uint64[EXACT], like: uint32[LIKE], whole: 64 bits of the text itself (0 for a multiset that is not a text)."""

    __slots__ = ("exact", "like", "whole")

    def __init__(self, exact=None, like=None, whole: int = 0):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.like = np.zeros(LIKE, np.uint32) if like is None else like
        self.whole = whole

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.exact - other.exact, self.like - other.like)

    def same_paragraphs(self, other: "Fingerprint") -> bool:
        return bool((self.exact == other.exact).all())

    def likeness(self, other: "Fingerprint") -> float:
        if self.same_paragraphs(other):
            return 1.0
        a, b = (f.like.view(np.int32).astype(np.float64) for f in (self, other))
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, a @ b / size))) if size else 0.0

    def text(self) -> str:
        return base64.b64encode(self.whole.to_bytes(8, "little") + self.exact.astype("<u8").tobytes() + self.like.astype("<u4").tobytes()).decode()

    @classmethod
    def of_text(cls, s: str) -> "Fingerprint":
        raw = base64.b64decode(s)
        return cls(np.frombuffer(raw, "<u8", EXACT, 8).copy(), np.frombuffer(raw, "<u4", LIKE, 8 + 8 * EXACT).copy(), int.from_bytes(raw[:8], "little"))


def fingerprints(texts: list[bytes]) -> Iterator[Fingerprint]:
    """The fingerprint of each UTF-8 text; an empty one has no paragraphs."""
    for a, b in T.slices(np.array([len(t) for t in texts], np.int64), T.SEGMENT):
        lines = [[x.strip() for x in t.split(b"\n")] for t in texts[a:b]]
        lines = [[x for x in own if x] for own in lines]
        of = np.repeat(np.arange(b - a), [len(x) for x in lines])
        flat = pa.array([x for own in lines for x in own], pa.large_binary())
        exact = np.zeros((b - a, EXACT), np.uint64)
        like = np.zeros((b - a) * LIKE, np.int64)
        if len(flat):
            digests = b"".join([hashlib.blake2b(x, digest_size=8 * EXACT).digest() for own in lines for x in own])
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            exact[of[first]] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, EXACT), first)
            w = T.words(flat)
            at, runs = T.windows(w, RUN)
            owner = np.repeat(np.arange(len(flat)), w.count())
            own = of[owner[at]]
            short = np.flatnonzero((w.count() > 0) & (w.count() < RUN))  # a paragraph of fewer words is one run
            in_short = np.isin(owner, short)
            runs = np.concatenate([runs, T.run_hashes(w.hash[in_short], w.count()[short])])
            own = np.concatenate([own, of[short]])
            sign = np.where(runs >> np.uint64(63), 1.0, -1.0)
            like = np.bincount(own * LIKE + (runs % np.uint64(LIKE)).astype(np.int64), sign, (b - a) * LIKE).astype(np.int64)
        like = like.astype(np.uint32).reshape(b - a, LIKE)
        for i, t in enumerate(texts[a:b]):
            yield Fingerprint(exact[i], like[i], int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") if t else 0)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_range(key: tuple, rows: pa.Table) -> pa.Table:
    """A range's rows in descending order, with the row that follows its last (halo): each text's fingerprint, and that of its edited text."""
    rows = rows.sort_by([("halo", "ascending"), ("doc_id", "descending"), ("digest", "descending")])  # nulls come last
    ids, texts, halo = rows["doc_id"].to_pylist(), [t or "" for t in rows["text"].to_pylist()], rows["halo"].to_pylist()
    n = halo.count(False)
    edited = []
    for i in range(n):
        s, nxt = texts[i], texts[i + 1] if i + 1 < len(texts) else texts[0]
        m = len(s) // 2
        edited.append((s[: len(s) - m] + nxt[:m]).encode())
    own = list(fingerprints([t.encode() for t in texts]))
    new = list(fingerprints(edited))
    follow = [own[i + 1] if i + 1 < len(own) else own[0] for i in range(n)]
    cols = [
        ids[:n], [len(t) for t in texts[:n]], [hashlib.sha256(e).hexdigest() for e in edited], [f.text() for f in own[:n]], [f.text() for f in new],
        [f.likeness(g) for f, g in zip(own, new, strict=False)], [f.likeness(g) for f, g in zip(own, follow, strict=False)],
    ]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """For each row of documents(doc_id, text, ...) the fingerprints of its text and of its edited text, whose second half (floor(n / 2) code points) is replaced by the first as many of the next document's in descending doc_id; after the last comes the first.

    A null text is empty; a null doc_id is smaller than all; rows of equal doc_id follow in descending order of their texts'
    hashes, and equal rows one another. A table of one row is its own next; an empty one gives no rows. Each range of doc_id
    is one group, sent with the one row that follows it.
    """
    scratch = Scratch(spark, "fingerprints")
    rows = ordered_ranges(spark, ordered(documents), RANGE)
    # the first row of each range in descending order, which follows the next higher range: one row a range, with its text
    key = F.struct("doc_id", "digest")  # a null is the smallest
    first = rows.groupBy("bucket").agg(F.max_by("text", key).alias("text"), F.max(key).alias("k"))
    first = scratch.write(first.select("bucket", "text", "k.doc_id", "k.digest"), "first")
    order = first.select("bucket", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.partitionBy())).alias("before"))
    halo = first.join(order, "bucket").select("doc_id", "text", "digest", F.col("before").alias("bucket"), F.lit(True).alias("halo"))
    both = rows.select("doc_id", "text", "digest", "bucket", F.lit(False).alias("halo")).unionByName(halo)
    return both.groupBy("bucket").applyInArrow(edit_range, OUT)

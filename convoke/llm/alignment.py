"""Alignment of two tokenizers by a sweep over the ends of their tokens.

Each side gives events: where a token ends, in bytes from the text's start, and its id. A row holds the events of one document,
side and block of SPAN bytes: where the first of its tokens begins, and the ids, from whose bytes the ends follow. The rows of both sides are put together, dealt by document and sorted by block within their
partitions; a machine then streams through them. Where tokens of both sides end, a group closes. The machine keeps what
was not closed yet, a digest's state and the document's distinct pairs; everything else goes out as documents end.

An id pair's number of documents is added up over the corpus from the distinct pairs of each part, a part being what one task
swept; each part then gets the counts of its own pairs back, not those of all documents one by one.
"""

import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import text as T
from convoke.llm.scratch import Scratch, partitions
from convoke.llm.tokens import Encoder, edges, lists

#: Bytes of text in a row of events, in hand at a time, and in a part; links of a group that are listed one by one.
SPAN, SLICE, PART, DENSE = 1 << 18, 2_000_000, 32_000_000, 4096
#: Bits of an offset within a document, beside its number among those in hand.
OFFSET = 44
EVENTS = "row long, doc_id long, block long, side int, start long, ids binary"
SWEPT = "part long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair}>, times array<int>, a array<array<int>>, b array<array<int>>"


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes its bytes in: printable ones as they are, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class Side:
    """A vocabulary's bytes, one token after another."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.edge = edges(self.size)
        self.id_type = "<u2" if len(tokens) <= 1 << 16 else "<u4"

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return lists(self.data, self.edge, ids.astype(np.int64))


class ByteSide(Side):
    """A byte-level tokenizer of the tokenizers library; special tokens' strings in a text are plain text, and a space is put before it."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain=True)
        letters, tokens = byte_letters(), self.encoder.tokenizer.get_vocab(with_added_tokens=False)
        raw = [b""] * (max(self.encoder.vocabulary.values()) + 1)
        for token, i in tokens.items():
            raw[i] = bytes([letters[c] for c in token if c in letters])
        super().__init__(raw)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.flat(texts, lead=True)


class PieceSide(Side):
    """A SentencePiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        self.path, model = path, sentencepiece.SentencePieceProcessor(model_file=path)
        byte = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)])
        super().__init__([byte(i) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())])

    @cached_property
    def model(self):
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = self.model.encode(texts.to_pylist(), num_threads=1)
        counts = np.array([len(r) for r in rows], np.int64)
        return np.fromiter((i for r in rows for i in r), np.int64, int(counts.sum())), counts


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return PieceSide(path) if path.endswith(".model") else ByteSide(path)


def per_document(values: np.ndarray, counts: np.ndarray, ufunc=np.add) -> np.ndarray:
    """Sums (or the ufunc's reduction) of as many consecutive values as each count says; 0 for none."""
    full, out = np.flatnonzero(counts), np.zeros(len(counts), np.int64)
    if len(full):
        out[full] = ufunc.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def spelt_alike(s: Side, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which documents' tokens, joined, are their bytes."""
    good = per_document(s.size[ids], counts) == size
    token, byte = np.repeat(good, counts), np.repeat(good, size)
    unlike = (s.joined(ids[token]) != data[byte]).astype(np.int64)
    good[good] = per_document(unlike, size[good]) == 0
    return good


def events(documents: DataFrame, a: str, b: str) -> DataFrame:
    """EVENTS of documents(doc_id, text, ...), of both sides.

    A document without tokens - a null or empty text, or one whose tokens of a side don't join to it - has one row without events.
    row tells documents apart, whatever their doc_id; a task that runs again gives the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, n = (side(a), side(b)), TaskContext.get().partitionId() << 36
        for batch in batches:
            for x, y in T.slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), SLICE):
                part = batch.slice(x, y - x)
                texts = part.column(1).cast(pa.large_string()).fill_null("")
                data, edge = T.text_buffer(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
                size = np.diff(edge)
                coded = [s.encode(texts) for s in sides]
                good = size > 1
                for s, (ids, counts) in zip(sides, coded, strict=True):
                    good &= spelt_alike(s, ids, counts, data, size)
                yield from packed(part.column(0).to_pylist(), n, good, [(s, ids, edges(counts)) for s, (ids, counts) in zip(sides, coded, strict=True)])
                n += y - x
                pa.default_memory_pool().release_unused()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, EVENTS)


def packed(docs: list, first: int, good: np.ndarray, coded: list) -> Iterator[pa.RecordBatch]:
    out = []
    for i, (doc, ok) in enumerate(zip(docs, good.tolist(), strict=True)):
        if not ok:
            out.append((first + i, doc, 0, 0, 0, b""))
            continue
        for k, (s, ids, edge) in enumerate(coded):
            own = ids[edge[i] : edge[i + 1]]
            size = s.size[own]
            end = np.cumsum(size)
            cut = np.searchsorted(end, np.arange(SPAN, int(end[-1]), SPAN), side="right") if end[-1] > SPAN else np.zeros(0, np.int64)
            for block, (x, y) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(own)], strict=True)):
                out.append((first + i, doc, block, k, int(end[x] - size[x]) if x < y else 0, own[x:y].astype(s.id_type).tobytes()))
    if out:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "doc_id", "block", "side", "start", "ids"])


class Sweep:
    """Streams through rows in order of (row, block, side); gives a row for each document as it ends."""

    def __init__(self, sides: tuple[Side, Side], part: int, keep: bool):
        self.sides, self.part, self.keep = sides, part, keep
        self.wide = len(sides[1].size)
        longest = max(len(s.size) for s in sides)
        spelt = [f"{i}{c}".encode() for c in ",|;" for i in range(longest)]
        self.spelt, self.spelt_edge, self.longest = np.frombuffer(b"".join(spelt), np.uint8), edges(np.array([len(x) for x in spelt])), longest
        self.open: dict | None = None

    def fresh(self, row: int, doc: int | None) -> dict:
        return {"row": row, "doc": doc, "left": [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2, "sha": hashlib.sha256(), "n": [0, 0, 0, 0], "pairs": [], "groups": ([], [])}

    def ended(self, d: dict) -> tuple:
        pairs, times = d["pairs"][0] if d["pairs"] else (np.zeros(0, np.int64),) * 2
        if len(d["pairs"]) > 1:
            pairs, back = np.unique(np.concatenate([p for p, _ in d["pairs"]]), return_inverse=True)
            times = np.bincount(back, np.concatenate([t for _, t in d["pairs"]]), len(pairs)).astype(np.int64)
        return (self.part, d["row"], d["doc"], *d["n"], d["sha"].hexdigest() if d["n"][2] else "", pairs, times, *(d["groups"] if self.keep else (None, None)))

    def take(self, rows: list[tuple], last: bool) -> list[tuple]:
        """Rows of whole blocks -> the documents that end with them; the last of them stays open unless last."""
        docs, number, of = [], {}, []
        if self.open is not None:
            number[self.open["row"]] = 0
            docs.append(self.open)
        for r in rows:
            if r[0] not in number:
                number[r[0]] = len(docs)
                docs.append(self.fresh(r[0], r[1]))
            of.append(number[r[0]])
        if docs:
            self.sweep(docs, rows, of)
        self.open = None if last or not docs else docs.pop()
        return [self.ended(d) for d in docs]

    def sweep(self, docs: list[dict], rows: list[tuple], of: list[int]) -> None:
        ids, ends = [], []
        for k, s in enumerate(self.sides):
            own = [(d, r) for d, r in zip(of, rows, strict=True) if r[3] == k and r[5]]
            i = np.frombuffer(b"".join([r[5] for _, r in own]), s.id_type).astype(np.int64)
            size = s.size[i]
            n = np.array([len(r[5]) // np.dtype(s.id_type).itemsize for _, r in own], np.int64)
            total = per_document(size, n)
            base = np.array([(d << OFFSET) + r[4] for d, r in own], np.int64) - (np.cumsum(total) - total)
            left = docs[0]["left"][k]
            ids.append(np.concatenate([left[0], i]))
            ends.append(np.concatenate([left[1], np.cumsum(size) + np.repeat(base, n)]))
        docs[0]["left"] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        at = np.searchsorted(ends[1], ends[0])
        both = ends[0][np.append(ends[1], -1)[at] == ends[0]]
        group = [np.searchsorted(both, e) for e in ends]
        n = [np.bincount(g, minlength=len(both) + 1)[: len(both)] for g in group]
        closed = [int(x.sum()) for x in n]
        for d, (x, y) in ((len(docs) - 1, (0, 1)),):  # what was not closed belongs to the last document; its number will be 0
            docs[d]["left"] = [(ids[k][closed[k] :], ends[k][closed[k] :] - (d << OFFSET)) for k in (x, y)]
        ids, group = [i[:c] for i, c in zip(ids, closed, strict=True)], [g[:c] for g, c in zip(group, closed, strict=True)]
        if not len(both):
            return
        of_group = both >> OFFSET
        groups = np.bincount(of_group, minlength=len(docs))
        links = n[0] * n[1]
        figures = [per_document(x, groups) for x in (n[0], n[1], np.ones(len(both), np.int64), links)]
        text, text_edge = self.written(ids, group, n)
        text_edge = text_edge[edges(groups)]
        of_pair, pairs, times = self.pairs(ids, group, n, links, of_group)
        pair_edge = edges(np.bincount(of_pair, minlength=len(docs)))
        group_edge, token_edge = edges(groups), [edges(x) for x in n]
        for d in np.flatnonzero(groups).tolist():
            doc, (x, y) = docs[d], text_edge[d : d + 2].tolist()
            if doc["n"][2]:
                doc["sha"].update(b";")
            doc["sha"].update(text[x : y - 1])
            doc["n"] = [v + int(f[d]) for v, f in zip(doc["n"], figures, strict=True)]
            doc["pairs"].append((pairs[pair_edge[d] : pair_edge[d + 1]], times[pair_edge[d] : pair_edge[d + 1]]))
            if self.keep:
                for k in (0, 1):
                    e = token_edge[k]
                    doc["groups"][k].extend(ids[k][e[g] : e[g + 1]].tolist() for g in range(group_edge[d], group_edge[d + 1]))

    def written(self, ids: list, group: list, n: list) -> tuple[bytes, np.ndarray]:
        """The groups as text, and where each begins: a1,a2|b1;"""
        before = [np.cumsum(x) - x for x in n]
        size = n[0] + n[1]
        start = np.cumsum(size) - size
        use = np.empty(int(size.sum()), np.int64)
        for k, shift in ((0, 0), (1, n[0])):
            place = np.arange(len(ids[k])) - before[k][group[k]]
            final = place == n[k][group[k]] - 1
            use[(start + shift)[group[k]] + place] = ids[k] + np.where(final, (1 + k) * self.longest, 0)
        width = np.diff(self.spelt_edge)[use]
        return lists(self.spelt, self.spelt_edge, use).tobytes(), edges(per_document(width, size))

    def pairs(self, ids: list, group: list, n: list, links: np.ndarray, of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times linked) of distinct pairs, in order. Groups of many links go by their distinct ids, so that no pairs of all are listed."""
        few = links <= DENSE
        one = few[group[0]]
        times = n[1][group[0][one]]
        first = np.repeat(ids[0][one], times)
        place = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times) + np.repeat((np.cumsum(n[1]) - n[1])[group[0][one]], times)
        keys = [np.repeat(of_group[group[0][one]], times) * (len(self.sides[0].size) * self.wide) + first * self.wide + ids[1][place]]
        counts = [np.ones(len(first), np.int64)]
        for g in np.flatnonzero(~few).tolist():
            (u, c), (v, e) = (np.unique(ids[k][np.searchsorted(group[k], g) : np.searchsorted(group[k], g, "right")], return_counts=True) for k in (0, 1))
            keys.append((of_group[g] * (len(self.sides[0].size) * self.wide) + u[:, None] * self.wide + v[None, :]).reshape(-1))
            counts.append((c[:, None] * e[None, :]).reshape(-1))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        every = len(self.sides[0].size) * self.wide
        return key // every, key % every, total


def swept(a: str, b: str, keep: bool):
    """Rows in order of (row, block, side) -> SWEPT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = pair_type(side(a), side(b)) == "long"
        machine, held, weight = Sweep((side(a), side(b)), TaskContext.get().partitionId(), keep), [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if weight > SLICE and (r[0], r[2]) != (held[-1][0], held[-1][2]):
                    yield from table(machine.take(held, False), wide)
                    held, weight = [], 0
                held.append(r)
                weight += 2 * len(r[5])
        yield from table(machine.take(held, True), wide)

    return run


def pair_type(a: Side, b: Side) -> str:
    return "int" if len(a.size) * len(b.size) < 1 << 31 else "long"


def table(rows: list[tuple], wide: bool) -> Iterator[pa.RecordBatch]:
    if rows:
        *plain, pairs, times, a, b = zip(*rows, strict=True)
        kinds = [*[pa.int64()] * 7, pa.string()]
        flat = lambda x, t: pa.ListArray.from_arrays(pa.array(edges(np.array([len(v) for v in x])), pa.int32()), pa.array(np.concatenate(x).astype(t)))
        nested = pa.list_(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, kinds, strict=True)), flat(pairs, np.int64 if wide else np.int32), flat(times, np.int32), pa.array(a, nested), pa.array(b, nested)], names=[f.split()[0] for f in SWEPT.split(", ")])


def aligned(spark: SparkSession, documents: DataFrame, a: str, b: str, keep: bool = False) -> DataFrame:
    """A row for each of documents(doc_id, text, ...): SWEPT, written. pairs are the distinct linked ids (a * size of b's vocabulary + b), times how often each is linked; with keep, the groups' ids are there too.

    Texts that are null, empty, or not what a side's tokens join to have no groups, zeros and an empty digest. Rows of equal or null doc_id are documents of
    their own; an empty table gives no rows. A very long text goes through in blocks.
    """
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // PART))
    swept_rows = events(documents, a, b).repartition(parts, "row").sortWithinPartitions("row", "block", "side").mapInArrow(swept(a, b, keep), SWEPT.format(pair=pair_type(side(a), side(b))))
    return Scratch(spark, "alignment").write(swept_rows, "swept")


def pair_counts(found: DataFrame, wide: int) -> DataFrame:
    """(part, pair, docs, best): for each part's pairs, in how many documents of all they are linked, and whether no other pair of the same id of a is in more."""
    asked = found.select("part", F.explode("pairs").alias("pair")).select("part", F.col("pair").cast("long").alias("pair")).groupBy("part", "pair").agg(F.count("*").alias("docs"))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = counts.withColumn("first", F.floor(F.col("pair") / wide))
    most = counts.groupBy("first").agg(F.max("docs").alias("most"))
    known = counts.join(most, "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return asked.select("part", "pair").join(known, "pair").select(F.col("part").alias("part"), "pair", "docs", "best")


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def score(docs: pa.Table, known: pa.Table) -> pa.Table:
    """A part's documents, with the counts of the pairs in it."""
    known = known.sort_by("pair")
    pair, count, best = known["pair"].to_numpy(), known["docs"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
    pairs, times = docs["pairs"].combine_chunks(), docs["times"].combine_chunks()
    n = pairs.value_lengths().to_numpy(zero_copy_only=False)
    at, t = np.searchsorted(pair, pairs.flatten().to_numpy().astype(np.int64)), times.flatten().to_numpy().astype(np.int64)
    made = {"count_sum": per_document(t * count[at], n), "n_best": per_document(np.where(best[at], t, 0), n)}
    names = [f.split()[0] for f in SCORED.split(", ")]
    return pa.table([pa.array(made[c]) if c in made else docs[c] for c in names], names=names)


def linked_counts(spark: SparkSession, documents: DataFrame, a: str, b: str) -> DataFrame:
    """SCORED for each row of documents: see aligned. n_best counts links whose pair is in as many documents as any pair of its a id, count_sum adds up the pairs' documents over the links."""
    found = aligned(spark, documents, a, b)
    known = pair_counts(found, len(side(b).size))
    return found.select("part", *[f.split()[0] for f in SCORED.split(", ") if f.split()[0] not in ("n_best", "count_sum")], "pairs", "times").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(score, SCORED)

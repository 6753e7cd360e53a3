"""Removal of repeated passages, by sharded automata of repeated phrases.

A window of WINDOW words that an earlier document (smaller doc_id) has too is a repeat; each word that a repeat covers goes.

1. Documents are dealt into chunks. A window's anchor is the least hash of its runs of ANCHOR words, so that equal windows have
   equal anchors. A chunk sends its distinct anchors, a few bytes each, to buckets; a bucket answers each chunk with those
   that another document has too, and tells which are hot, that is in more than HOT chunks. Passages without such an anchor
   repeat nowhere.
2. Runs of windows with the same recurring anchor are passages; a chunk sends each distinct passage once, with the smallest
   and largest doc_id that has it there, to the anchor's shard. A hot anchor's windows go one by one to shards by their own
   hashes, so that no shard gets all that surrounds a common phrase.
3. A shard confirms, word by word, the windows that two documents have, with the first of these. Runs of them that have one
   first document are phrases, and go back to each chunk that has them in a later document.
4. A chunk compiles its phrases into Aho-Corasick automata over spelt word numbers, and streams all its documents, whole, through
   them. Each hit locates a phrase in a document; if the phrase's first document is an earlier one, the words of the hit go.
   Words are numbered by comparing them, so that no hash decides what goes.

What one bucket or shard gets of a hot passage is a row for each chunk, not for each document. All words of all texts are
read; nothing is sampled or capped.
"""

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from convoke.llm import text as T
from convoke.llm.blobs import pack, unpack, unpacked
from convoke.llm.scratch import partitions

WINDOW, ANCHOR = 13, 6
#: Bytes of text in a chunk, bytes hashed at a time, bytes of passages that a shard confirms at a time, words of phrases in one automaton.
CHUNK, SLICE, CONFIRM, WORDS = 4_000_000, 1 << 20, 8 << 20, 1 << 18
#: Chunks that have a hot anchor; windows of a phrase, and words streamed at a time (with a phrase's length more).
HOT, PHRASE, STREAM = 64, 32, 100_000
#: Digits of a word's number at least.
WIDTH = 3
LAST = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchored(w: T.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and anchor of each window."""
    at, h = T.windows(w, window)
    if not len(at):
        return at, h, h
    return at, h, sliding_min(T.sequence_hashes(w.hash, anchor), window - anchor + 1)[at]


def parts_of(texts: pa.Array) -> Iterator[tuple[int, int, T.Words]]:
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in T.slices(lengths, SLICE):
        yield a, b, T.words(texts.slice(a, b - a))


def columns(docs: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """doc_id (null: later than any) and texts."""
    ids = pc.fill_null(docs.column("doc_id"), LAST).to_numpy()
    texts = docs.column("text").combine_chunks()
    return ids, pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts


def owner(w: T.Words, at: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.searchsorted(w.doc, at, side="right") - 1


def grouped_range(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each is first in order, and the least and largest id that has it."""
    by = np.argsort(values, kind="stable")
    v = values[by]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    if not len(v):
        return v, by, ids, ids
    return v[first], by[first], np.minimum.reduceat(ids[by], first), np.maximum.reduceat(ids[by], first)


def send_anchors(window: int, anchor: int, buckets: int):
    """A chunk -> (bucket, chunk, anchors): its distinct anchors; the lowest bit tells whether two of its documents have it."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        ids, texts = columns(docs)
        found = []
        for a, b, w in parts_of(texts):
            at, _, anc = anchored(w, window, anchor)
            v, _, lo, hi = grouped_range(anc | np.uint64(1), ids[a:b][owner(w, at)])
            found.append((v, lo, hi))
        v, lo, hi = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        u, _, lo2, _ = grouped_range(v, lo)
        _, _, _, hi2 = grouped_range(v, hi)
        u = np.where(lo2 < hi2, u, u ^ np.uint64(1)) if len(u) else u.astype(np.uint64)
        home = ((u >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        blobs = [u[by[cut[k] : cut[k + 1]]].tobytes() for k in full]
        return pa.table({"bucket": pa.array(full, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "anchors": pa.array(blobs, pa.binary())})

    return run


def answer_anchors(hot: int):
    """A bucket's rows -> for each chunk its anchors that recur; the lowest bit is 0 for hot ones."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("anchors")]
        every = np.concatenate(blobs)
        v, chunks = np.unique(every | np.uint64(1), return_counts=True)
        recurs = chunks > 1
        recurs[np.searchsorted(v, every[every & np.uint64(1) == 1])] = True
        told = v ^ (chunks > hot).astype(np.uint64)
        out = []
        for b in blobs:
            at = np.searchsorted(v, b | np.uint64(1))
            out.append(told[at[recurs[at]]].tobytes())
        return pa.table({"chunk": rows.column("chunk"), "anchors": pa.array(out, pa.binary())})

    return run


def dealt(rows: pa.Table, home: np.ndarray, count: int) -> tuple[np.ndarray, list[bytes]]:
    """(homes that get rows, their rows packed)."""
    by = np.argsort(home, kind="stable")
    rows = rows.take(pa.array(by))
    cut = np.searchsorted(home[by], np.arange(count + 1))
    full = np.flatnonzero(np.diff(cut))
    return full, [pack(rows.slice(cut[s], cut[s + 1] - cut[s])) for s in full]


def distinct_texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's text, the first row of each number), by comparing texts."""
    number = t["text"].combine_chunks().dictionary_encode().indices.to_numpy()
    return number, np.unique(number, return_index=True)[1]


def send_passages(window: int, anchor: int, shards: int):
    """A chunk and its recurring anchors -> (shard, chunk, passages): each distinct passage once, with its key (its anchor, or its only window's hash) and the least and largest doc_id."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        told = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in answers.column("anchors")] or [np.zeros(0, np.uint64)]))
        recurring, is_hot = told | np.uint64(1), told & np.uint64(1) == 0
        tables = []
        if len(recurring) and docs.num_rows:
            ids, texts = columns(docs)
            for a, b, w in parts_of(texts):
                at, h, anc = anchored(w, window, anchor)
                anc = anc | np.uint64(1)
                k = np.minimum(np.searchsorted(recurring, anc), len(recurring) - 1)
                hit = recurring[k] == anc
                at, h, anc, hot = at[hit], h[hit], anc[hit], is_hot[k[hit]]
                if not len(at):
                    continue
                of = owner(w, at)
                new = np.append(True, (at[1:] != at[:-1] + 1) | (anc[1:] != anc[:-1]) | (of[1:] != of[:-1])) | hot
                start = np.flatnonzero(new)
                end = np.append(start[1:], len(at)) - 1
                raw = w.data.tobytes()
                text = [raw[x:y] for x, y in zip(w.start[at[start]].tolist(), w.end[at[end] + window - 1].tolist(), strict=True)]
                part = pa.table({"key": np.where(hot, h, anc)[start], "lo": ids[a:b][of[start]], "text": pa.array(text, pa.large_binary())})
                number, first = distinct_texts(part)
                _, _, lo, hi = grouped_range(number, part["lo"].to_numpy())
                tables.append(part.take(pa.array(first)).set_column(1, "lo", pa.array(lo)).append_column("hi", pa.array(hi)))
        if not tables:
            return pa.table({"shard": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "passages": pa.array([], pa.binary())})
        t = pa.concat_tables(tables)
        number, first = distinct_texts(t)
        _, _, lo, _ = grouped_range(number, t["lo"].to_numpy())
        _, _, _, hi = grouped_range(number, t["hi"].to_numpy())
        t = t.take(pa.array(first)).select(["key", "text"]).append_column("lo", pa.array(lo)).append_column("hi", pa.array(hi))
        full, blobs = dealt(t, (T.mix(t["key"].to_numpy()) % np.uint64(shards)).astype(np.int64), shards)
        return pa.table({"shard": pa.array(full, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "passages": pa.array(blobs, pa.binary())})

    return run


def key_batches(key: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of passages, sorted by key, of about most bytes; a key's passages stay together."""
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    for a, b in T.slices(np.add.reduceat(sizes, edge[:-1]) if len(key) else sizes, most):
        yield edge[a], edge[b]


def confirm(window: int):
    """A shard's passages -> (chunk, phrases): for each chunk the texts of runs of confirmed windows, and the first document that has them, where a later one is in the chunk."""

    def run(rows: pa.Table) -> pa.Table:
        tables = [unpacked(b) for b in rows.column("passages").to_pylist()]
        from_row = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
        t = pa.concat_tables(tables)
        by = np.argsort(t["key"].to_numpy(), kind="stable")
        from_row, t = from_row[by], t.take(pa.array(by)).combine_chunks()
        key, lo, hi, text = t["key"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy(), t["text"].combine_chunks()
        found = []
        for a, b in key_batches(key, pc.binary_length(text).to_numpy(zero_copy_only=False), CONFIRM):
            w = T.words(text.slice(a, b - a))
            at, h = T.windows(w, window)
            of = owner(w, at) + a
            group, n = T.exact_groups(h, T.word_numbers(w), at, window)
            if not n:
                continue
            _, _, least, _ = grouped_range(group, lo[of])
            known = np.unique(group)
            first = least[np.searchsorted(known, group)]
            ok = first < hi[of]
            at, of, first = at[ok], of[ok], first[ok]
            if not len(at):
                continue
            new = np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]) | (first[1:] != first[:-1]))
            run_of = np.flatnonzero(new)
            place = T.places(np.diff(np.append(run_of, len(at))))
            start = np.flatnonzero(place % PHRASE == 0)  # long runs, as of one word again and again, are cut
            end = np.append(start[1:], len(at)) - 1
            raw = w.data.tobytes()
            phrase = [raw[x:y] for x, y in zip(w.start[at[start]].tolist(), w.end[at[end] + window - 1].tolist(), strict=True)]
            found.append(pa.table({"row": from_row[of[start]], "first": first[start], "text": pa.array(phrase, pa.large_binary())}))
        if not found:
            return pa.table({"chunk": pa.array([], pa.int64()), "phrases": pa.array([], pa.binary())})
        t = pa.concat_tables(found)
        full, blobs = dealt(t.select(["first", "text"]), t["row"].to_numpy(), len(tables))
        return pa.table({"chunk": rows.column("chunk").combine_chunks().take(pa.array(full)), "phrases": pa.array(blobs, pa.binary())})

    return run


class Shard:
    """The phrases of a chunk, and their automata.

    A child of a trie's node is found by looking through them all, so a word is spelt in WIDTH or more digits, each place with
    digits of its own: no node has more than a place's digits as children, and no hit begins inside a word. A word of no phrase
    is spelt in digits of no place. All are Latin-1 characters, which the library takes as they are.
    """

    def __init__(self, phrases: pa.Table):
        number, at = distinct_texts(phrases)
        self.first = grouped_range(number, phrases["first"].to_numpy())[2]
        w = T.words(phrases["text"].combine_chunks().take(pa.array(at)))
        coded = T.word_array(w).dictionary_encode()
        self.vocabulary, self.doc = coded.dictionary, w.doc
        count = len(self.vocabulary)
        self.width = next(k for k in range(WIDTH, 64) if (255 // k) ** k >= count)
        base = next(b for b in range(1, 256) if b**self.width >= count)
        place = np.arange(self.width)
        digits = np.arange(count)[:, None] // base**place % base + base * place
        self.spelling = np.concatenate([np.full((1, self.width), 255), digits]).astype(np.uint8)
        self.number = coded.indices.to_numpy() + 1
        self.longest = int(w.count().max()) if len(self.first) else 0

    def spelt(self, numbers: np.ndarray) -> str:
        return self.spelling[numbers].tobytes().decode("latin-1")

    def numbers(self, w: T.Words) -> np.ndarray:
        return pc.index_in(T.word_array(w), value_set=self.vocabulary).fill_null(-1).to_numpy() + 1

    def automata(self) -> Iterator[ahocorasick.Automaton]:
        """Automata of at most about WORDS words of phrases each; a hit gives (words, first document)."""
        for a, b in T.slices(np.diff(self.doc), WORDS):
            automaton = ahocorasick.Automaton()
            edge = (self.doc[a : b + 1] - self.doc[a]).tolist()
            spelt = self.spelt(self.number[self.doc[a] : self.doc[b]])
            for x, y, first in zip(edge[:-1], edge[1:], self.first[a:b].tolist(), strict=True):
                phrase = spelt[x * self.width : y * self.width]
                have = automaton.get(phrase, None)  # the same words with other blanks between them
                automaton.add_word(phrase, (y - x, first if have is None else min(first, have[1])))
            automaton.make_automaton()
            yield automaton

    def mark(self, automaton: ahocorasick.Automaton, numbers: np.ndarray, w: T.Words, ids: np.ndarray, gone: np.ndarray) -> None:
        """Streams each document whole; the words of hits of phrases that an earlier document has are marked in gone."""
        spans: list[tuple[int, int]] = []
        for own, x, y in zip(ids.tolist(), w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
            for part in range(x, y, STREAM):  # a very long text in overlapping parts
                begin = max(x, part - self.longest + 1)
                for end, (size, first) in automaton.iter(self.spelt(numbers[begin : min(y, part + STREAM)])):
                    if first < own:
                        last = begin + end // self.width + 1
                        spans.append((last - size, last))
        if spans:
            edge = np.array(spans)
            change = np.bincount(edge[:, 0], minlength=len(gone) + 1) - np.bincount(edge[:, 1], minlength=len(gone) + 1)
            gone |= np.cumsum(change[:-1]) > 0


def held(texts: pa.Array) -> Callable[[], Iterator[tuple[int, int, T.Words]]]:
    """parts_of(texts) as often as asked; kept in memory unless the texts are much longer than a chunk is meant to be."""
    if texts.nbytes > 4 * CHUNK:
        return lambda: parts_of(texts)
    kept = list(parts_of(texts))
    return lambda: iter(kept)


def remove(window: int, schema: pa.Schema):
    """A chunk and its phrases -> its rows with kept text, counts and the spans of removed words."""

    def run(key: tuple, docs: pa.Table, phrases: pa.Table) -> pa.Table:
        ids, texts = columns(docs)
        slices = held(texts)
        gone = [np.zeros(len(w.hash), bool) for _, _, w in slices()]
        if phrases.num_rows:
            shard = Shard(unpack(phrases.column("phrases")))
            for automaton in shard.automata():
                for (a, b, w), flat in zip(slices(), gone, strict=True):
                    shard.mark(automaton, shard.numbers(w), w, ids[a:b], flat)
        kept, n_words, n_removed, spans = [], [], [], []
        for (a, b, w), flat in zip(slices(), gone, strict=True):
            raw = w.data.tobytes()
            total = np.concatenate([[0], np.cumsum(flat)])
            n_words += w.count().tolist()
            n_removed += (total[w.doc[1:]] - total[w.doc[:-1]]).tolist()
            for x, y, lost in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), n_removed[a:], strict=True):
                s = raw[w.start[x] : w.end[y - 1]].split() if y > x else []
                if not lost:
                    kept.append(b" ".join(s))
                    spans.append([])
                else:
                    out = flat[x:y]
                    kept.append(b" ".join([q for q, r in zip(s, out.tolist(), strict=True) if not r]))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                    spans.append(edge.reshape(-1, 2).tolist())
        made = {"n_words": n_words, "n_removed": n_removed, "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": spans}
        return pa.table([docs.column(f.name) if f.name in ("doc_id", "rest") else pa.array(made[f.name], f.type) if isinstance(made[f.name], list) else made[f.name] for f in schema], schema=schema)

    return run


def chunk_of(chunks: int) -> Column:
    """By id and text: neither many rows of one id, or without one, nor many texts of one length share a chunk."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long"))


def remove_repeats(spark: SparkSession, documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(doc_id, rest, n_words, n_removed, kept_text, spans) for each row of documents(doc_id long, text, ...).

    rest holds all input columns unchanged; kept_text the words that stay, joined by one space; spans the [first, end) word
    ranges that went. Null or empty texts have no words and an empty kept_text. Rows with a null doc_id come after all others
    and are earlier than none. Rows of equal doc_id aren't earlier than each other. Texts of fewer than window words, and
    an empty table, lose nothing.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor is a part of a window")
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = partitions(spark)
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks = max(parts, -(-size // CHUNK))
    # their numbers follow the input, so that one of them doesn't grow with it
    buckets, shards = max(2 * parts, chunks), max(4 * parts, 2 * chunks)
    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("rest")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest)
    rows = rows.withColumn("chunk", chunk_of(chunks))
    docs = rows.select("doc_id", "text", "chunk") if set(documents.columns) <= {"doc_id", "text"} else rows
    slim = docs.groupBy("chunk")
    sent = slim.applyInArrow(send_anchors(window, anchor, buckets), "bucket long, chunk long, anchors binary")
    answers = sent.groupBy("bucket").applyInArrow(answer_anchors(hot), "chunk long, anchors binary")
    passages = slim.cogroup(answers.groupBy("chunk")).applyInArrow(send_passages(window, anchor, shards), "shard long, chunk long, passages binary")
    phrases = passages.groupBy("shard").applyInArrow(confirm(window), "chunk long, phrases binary")
    fields = [f for f in docs.schema.fields if f.name in ("doc_id", "rest")]
    schema = Ty.StructType([*fields, *Ty._parse_datatype_string("n_words long, n_removed long, kept_text string, spans array<array<int>>").fields])
    return slim.cogroup(phrases.groupBy("chunk")).applyInArrow(remove(window, to_arrow_schema(schema)), schema)

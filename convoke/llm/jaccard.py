"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

1. One pass makes each document's set of distinct shingle hashes, and from it the set's hash, a few minimum hashes, a parity
   bitmap, and the tokens that a batch has more than once (a shared passage), whose counts are summed over all batches.
2. Documents of equal sets are one representative. Representatives with a minimum hash in common are compared with the
   smallest of them and two that are chosen anew for each hash; verified links, contracted, partition similar documents into
   clusters. Documents without a link are put together by their first minimum hash. Both are cut into groups of about GROUP
   members.
3. Each representative's rarest n - ceil(t n) + 1 tokens make the matrix of tokens by groups: a token's row holds the
   groups in whose union it is. Of a query document q and a similar member y, which share at least
   a = ceil(t (nq + ny) / (1 + t)) tokens, the rarest shared one has a - 1 more after it in the order of each. So a group is
   opened only by a token after which both q and some member of the group have so many left, for sizes that the group has. A
   group that isn't a linked cluster's is opened for its own members likewise.
4. What a group shares with a query is counted: the union of all tokens of each group that may open is stored, and a group opens only if
   at least ceil(t nq) of the query's tokens are in it, as many as any similar member has. Tokens are 20 bits of their hashes
   there, of which unlike ones can only add to the count.
5. Members of opened groups are checked by their bitmaps (the parity bitmaps of two sets differ in no more bits than the sets
   do in elements), then exactly, on the texts.

A pair within a cluster is connected already, so that no group of copies is expanded into its pairs. All filters are exact; the
order of tokens and the clusters only steer how much is compared. Steps 1 and 3 read every whole text, step 4 those of
queries and groups that step 3 leaves.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm import text as T
from convoke.llm.blobs import pack, unpacked
from convoke.llm.components import components
from convoke.llm.scratch import Scratch, partitions

WORDS, PERCENT = 5, 75
HASHES, BITS, GROUP = 8, 2048, 32
#: A token is noted as frequent if so many of a batch's documents have it; about HOT_MOST of them at most, the most frequent, go into the order of tokens. Neither changes a result.
HOT_LEAST, HOT_MOST = 2, 1 << 19
#: Steps of counts for each doubling, by which the most frequent tokens are found.
STEPS = 16
#: Shingles of all sets for each bucket of the matrix, whose prefixes are about a quarter of them.
BUCKET = 2_000_000
#: Bytes of a token in a prefix, and bits of one in the sets whose overlap is counted.
WIDTH, COUNTED = 6, 20
#: Documents whose sets, and bytes of text that, are in hand at a time.
BATCH, SLICE = 4096, 2 << 20

SALTS = T.mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))
SHORT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one, a text without words none."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in T.slices(lengths, SLICE):
        w = T.words(column.slice(a, b - a), lower=True)
        at, h = T.windows(w, size)
        cut, n = np.searchsorted(at, w.doc), w.count()
        for i in range(b - a):
            if n[i] >= size:
                yield np.unique(h[cut[i] : cut[i + 1]])
            elif n[i]:
                yield T.run_hashes(w.hash[w.doc[i] : w.doc[i + 1]], n[i : i + 1]) ^ SHORT
            else:
                yield np.zeros(0, np.uint64)


def least(n, percent: int):
    """Tokens that a set of n must share with a similar one: ceil(percent n / 100)."""
    return -(-percent * n // 100)


PROFILE = "doc_id long, n long, s1 long, s2 long, sig array<long>, bits binary, token long, seen long"


def profile(size: int):
    """Batches of (doc_id, text) -> a row for each document, and rows (token, seen) of the batch's frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            ids, rows, tokens = batch.column(0), [], []
            for s in shingle_sets(batch.column(1), size):
                if len(s) == 0:
                    rows.append((0, 0, 0, None, None))
                    continue
                bits = np.bincount((s >> np.uint64(8)) % np.uint64(BITS), minlength=BITS) & 1
                sig = [int(T.mix(s ^ x).min().view(np.int64)) for x in SALTS]
                rows.append((len(s), int(T.mix(s).sum().view(np.int64)), int(T.mix(s ^ SHORT).sum().view(np.int64)), sig, np.packbits(bits.astype(bool)).tobytes()))
                tokens.append(s)
            token, seen = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            hot = seen >= HOT_LEAST
            k = int(hot.sum())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x, pa.nulls(k, t)]) for x, t in [(ids.cast(pa.int64()), pa.int64()), *((pa.array(c, t), t) for c, t in zip(columns, types, strict=True))]]
                + [pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(x[hot].view(np.int64), pa.int64())]) for x in (token, seen)],
                names=["doc_id", "n", "s1", "s2", "sig", "bits", "token", "seen"],
            )

    return run


def shared(w: T.Words, number: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], x: int, y: int, size: int) -> tuple[int, int]:
    """(intersection, union) of the shingle sets of texts x and y; what two hashes have in common counts only if its words are equal."""
    n = w.count()
    if min(n[x], n[y]) < size:  # a short text has one shingle, which no longer one equals
        a, b = (number[w.doc[i] : w.doc[i + 1]] for i in (x, y))
        same = int(len(a) == len(b) > 0 and (a == b).all())
        sizes = [len(np.unique(windows[i][1])) if n[i] >= size else min(1, n[i]) for i in (x, y)]
        return same, sum(sizes) - same
    (ax, hx), (ay, hy) = ((at[k], u) for at, (u, k) in ((windows[i][0], np.unique(windows[i][1], return_index=True)) for i in (x, y)))
    _, p, q = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    word = np.arange(size)
    same = int((number[ax[p][:, None] + word] == number[ay[q][:, None] + word]).all(axis=1).sum())
    return same, len(hx) + len(hy) - same


def verify(size: int, percent: int):
    """Batches of (a, b, ta, tb) -> the pairs (a, b) that are similar, by the words of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, sides = [], [batch.column(k).cast(pa.large_binary()) for k in (2, 3)]
            lengths = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False) for t in sides)
            for a, b in T.slices(lengths, SLICE):
                w = T.words(pa.concat_arrays([t.slice(a, b - a) for t in sides]), lower=True)
                number, (at, h) = T.word_numbers(w), T.windows(w, size)
                cut = np.searchsorted(at, w.doc)
                windows = [(at[x:y], h[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                for i in range(b - a):
                    both, either = shared(w, number, windows, i, b - a + i, size)
                    ok.append(both > 0 and 100 * both >= percent * either)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def within_bits(percent: int):
    """Batches of (a, b, na, nb, ba, bb) -> (a, b) whose bitmaps differ in no more bits than similar sets of these sizes can in elements: (100 - p) / (100 + p) of the sum of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            ok = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (100 + percent) <= (100 - percent) * n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


PREFIX = "doc_id long, n long, prefix binary"


def prefixes(size: int, percent: int, hot):
    """Batches of (doc_id, text) -> (doc_id, n, prefix): the rarest tokens in order, WIDTH bytes of each. Texts stay where they are; these, about a third of their size, meet the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = hot.value
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            sizes, made = [], []
            for s in shingle_sets(batch.column(1), size):
                n = len(s)
                if len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    s = s[np.argsort(np.where(token[at] == s, count[at], 0), kind="stable")]
                sizes.append(n)
                made.append(s[: min(n, n - least(n, percent) + 1)].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n", "prefix"])

    return run


def prefix_tokens(buckets: int):
    """Batches of (doc_id, n, prefix, grp, cluster, csize, linked) -> a row (bucket, rows) for each batch and bucket; rows hold the prefixes' tokens as a blob.

    Within a bucket 32 bits tell tokens apart, of which unlike ones can only open more. A group of one is its document's id and an
    unlinked one's cluster isn't asked for, so neither is sent; ids are sent as differences, and places in the order of tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            if not batch.num_rows:
                continue
            doc, n, grp, cluster, csize, linked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "grp", "cluster", "csize", "linked"))
            lengths = pc.binary_length(batch.column("prefix")).to_numpy() // WIDTH
            raw = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint8).reshape(-1, WIDTH)
            t = np.zeros((len(raw), 8), np.uint8)
            t[:, :WIDTH] = raw
            t = t.view("<u8")[:, 0]
            order = np.argsort(doc, kind="stable")
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc))
            i = np.repeat(np.arange(len(doc)), lengths)
            place = np.arange(len(t)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            home = (t % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((rank[i], home))
            edges = np.searchsorted(home[by], np.arange(buckets + 1))
            grp, cluster = np.where(csize > 1, grp, 0), np.where(linked, cluster, 0)
            full, blobs = np.flatnonzero(np.diff(edges)), []
            for b in full:
                k = by[edges[b] : edges[b + 1]]
                d = i[k]
                columns = {"t": (t[k] // np.uint64(buckets)).astype("<u4"), "n": n[d].astype("<u4"), "at": place[k].astype("<u4"), "d": np.diff(doc[d], prepend=0), "grp": grp[d], "cluster": cluster[d], "csize": csize[d], "linked": linked[d]}
                blobs.append(pack(pa.table(columns)))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    return run


def bucket_rows(blobs: pa.ChunkedArray) -> list[np.ndarray]:
    """t, n, left, doc_id, grp, cluster, csize, linked of a bucket's tokens, from its blobs."""
    parts = []
    for blob in blobs.to_pylist():
        t, n, at, d, grp, cluster, csize, linked = (unpacked(blob).column(c).to_numpy() for c in ("t", "n", "at", "d", "grp", "cluster", "csize", "linked"))
        n, doc = n.astype(np.int64), np.cumsum(d)
        parts.append((t, n, n - at, doc, np.where(csize > 1, grp, doc), cluster, csize, linked))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


OPENED = ["q", "nq", "grp"]


def matrix_rows(percent: int, most: int = 2_000_000):
    """A bucket's rows -> (q, nq, grp): which other groups a document opens, of which it isn't known to be linked with all. The document of the smaller family asks. At most about most cells are in hand at a time."""

    def run(bucket: pa.Table) -> pa.Table:
        t, n, left, doc, grp, cluster, csize, linked = bucket_rows(bucket.column("rows"))
        by = np.lexsort((grp, t))
        t, n, left, doc, grp, cluster, csize, linked = (x[by] for x in (t, n, left, doc, grp, cluster, csize, linked))
        # cells of the matrix: a token and a group, with the sizes of the group's members that have it, and the most tokens that one has from there on
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (grp[1:] != grp[:-1])
        cell = np.flatnonzero(new)
        low, high, room = (np.minimum.reduceat(n, cell), np.maximum.reduceat(n, cell), np.maximum.reduceat(left, cell)) if len(cell) else (n, n, n)
        row = np.ones(len(cell), bool)
        row[1:] = t[cell[1:]] != t[cell[:-1]]
        row_start = np.append(np.flatnonzero(row), len(cell))
        row_of = (np.cumsum(row) - 1)[np.cumsum(new) - 1] if len(cell) else np.zeros(0, np.int64)  # of each entry
        width = np.diff(row_start)[row_of] if len(cell) else np.zeros(0, np.int64)
        members = np.diff(np.append(cell, len(t)))
        own = members[np.cumsum(new) - 1] if len(cell) else width  # members of the entry's own group that have the token
        parts = []
        asks = np.flatnonzero((width > 1) | (own > 1))
        for a, b in T.slices(width[asks], most):
            e = asks[a:b]
            q = np.repeat(e, width[e])
            first = np.cumsum(width[e]) - width[e]
            c = np.repeat(row_start[row_of[e]] - first, width[e]) + np.arange(len(q))
            g = cell[c]
            ok = (csize[q] < csize[g]) | ((csize[q] == csize[g]) & (grp[q] < grp[g])) | ((grp[q] == grp[g]) & (members[c] > 1))
            ok &= ~(linked[q] & linked[g] & (cluster[q] == cluster[g]))
            ok &= (100 * high[c] >= percent * n[q]) & (100 * n[q] >= percent * low[c])
            share = -(-percent * (n[q] + np.maximum(low[c], least(n[q], percent))) // (100 + percent))
            ok &= (left[q] >= share) & (room[c] >= share)
            pairs = pa.table({"q": doc[q[ok]], "nq": n[q[ok]], "grp": grp[g[ok]]})
            parts.append(pairs.group_by(OPENED).aggregate([]))
        out = pa.concat_tables(parts).group_by(OPENED).aggregate([]) if parts else pa.table({"q": doc[:0], "nq": n[:0], "grp": grp[:0]})
        return pa.table({c: out[c].cast(pa.int64()) for c in OPENED})

    return run


def coded(s: np.ndarray) -> bytes:
    """Sorted distinct numbers of COUNTED bits as differences, whose low bytes come before the rest: about 14 bits each for sets of some hundreds."""
    step = np.diff(s.astype(np.int64), prepend=0)
    raw = (step & 255).astype("<u1").tobytes() + (step >> 8).astype("<u2").tobytes()
    return len(s).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def decoded(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    raw = pa.decompress(blob[4:], 3 * n, codec="zstd", asbytes=True) if n else b""
    return np.cumsum(np.frombuffer(raw, "<u1", n) + (np.frombuffer(raw, "<u2", n, n).astype(np.int64) << 8)) if n else np.zeros(0, np.int64)


def short_sets(size: int):
    """Batches of (id, text) -> (id, tokens): the distinct low COUNTED bits of the set's hashes, coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            made = [coded(np.unique(s & np.uint64((1 << COUNTED) - 1))) for s in shingle_sets(batch.column(1), size)]
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "tokens"])

    return run


def union_of(rows: pa.Table) -> pa.Table:
    """(id, tokens) of a group's members -> the group's."""
    every = np.unique(np.concatenate([decoded(x) for x in rows["tokens"].to_pylist()]))
    return pa.table({"id": rows["id"][:1], "tokens": pa.array([coded(every)], pa.binary())})


def covered(percent: int):
    """Batches of (q, nq, grp, own, every) -> those (q, nq, grp) of which the group's union has enough of the query's tokens. Two of a query's tokens of equal low bits count as one, and so much less is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b = None, None
        for batch in batches:
            ok = []
            for n, own, every in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if every != last:  # a group's queries come one after the other
                    last, b = every, decoded(every)
                a = decoded(own)
                at = np.searchsorted(b, a)
                ok.append(int((b[np.minimum(at, len(b) - 1)] == a).sum()) >= least(n, percent) - (n - len(a)))
            yield batch.select(OPENED).filter(pa.array(ok, pa.bool_()))

    return run


def qualifying(scratch: Scratch, opened: DataFrame, grouped: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows (q, nq, grp) of opened whose query has at least ceil(percent nq / 100) tokens in the group's union, which is stored as a table.

    Sets are made once for each document that asks or is asked for; which these are is a table first, so that texts stay where they are while it is small.
    """
    sets = "id long, tokens binary"
    wanted = scratch.write(grouped.join(opened.select("grp").distinct(), "grp", "left_semi").select(F.col("rep").alias("id"), "grp"), "wanted")
    ids = scratch.write(wanted.select(F.col("id").alias("doc_id")).union(opened.select("q")).distinct(), "sets-ids")
    made = texts.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(short_sets(size), sets)
    made = scratch.write(made, "sets")
    unions = scratch.write(made.join(wanted, "id").select(F.col("grp").alias("id"), "tokens").groupBy("id").applyInArrow(union_of, sets), "unions")
    # the query's own set first: a union, which is larger, is then dealt once, not once for each query
    met = opened.join(made.select(F.col("id").alias("q"), F.col("tokens").alias("own")), "q").join(unions.select(F.col("id").alias("grp"), F.col("tokens").alias("every")), "grp")
    return scratch.write(met.select(*OPENED, "own", "every").mapInArrow(covered(percent), "q long, nq long, grp long"), "qualifying")


def sized_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Each pair (a, b, na, nb) once, the larger id first, whose sizes allow that they are similar."""
    fits = pairs.where(f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    turn = F.col("a") < F.col("b")
    return fits.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(turn, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turn, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()


def similar_pairs(pairs: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, name: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) that are similar: by sizes, by bitmaps, then exactly."""
    one, two = (reps.select(F.col("rep").alias(c), F.col("bits").alias(f"b{c}")) for c in "ab")
    near = sized_pairs(pairs, percent).join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(within_bits(percent), "a long, b long")
    near = scratch.write(near, f"{name}-near")
    ids = scratch.write(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    texts = scratch.write(docs.join(ids, "doc_id", "left_semi"), f"{name}-texts")
    ta, tb = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    links = near.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(verify(size, percent), "a long, b long")
    links = scratch.write(links, f"{name}-links")
    scratch.drop(f"{name}-texts")
    return links


def jaccard_components(spark: SparkSession, documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents(doc_id, text, ...).

    Words are lower-cased (A-Z). Texts that are null, empty or without words have no shingles, link with nothing and are
    their own component, as are rows with a null doc_id (component null). Rows of equal doc_id are one document if their sets are
    equal, and otherwise each is compared but all bear the smallest component of them. An empty table gives no rows. Links are
    decided by words; sets are taken for equal, and sizes counted, by 64-bit hashes of shingles and 128 bits of sets.
    """
    scratch = Scratch(spark, "jaccard")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = None
    if documents_repeat(docs):  # rows are numbered, and their numbers stand for doc_id until the end
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        rows = scratch.write(docs.withColumn("row", number), "rows")
        docs = rows.select(F.col("row").alias("doc_id"), "text")
    made = scratch.write(docs.mapInArrow(profile(size), PROFILE), "profile")
    own = made.where("n is not null")
    counted = scratch.write(made.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")), "tokens")
    hot = counted.where(most_frequent(counted, HOT_MOST)).toArrow()
    key, count = hot["token"].to_numpy().view(np.uint64), hot["seen"].to_numpy()
    by = np.argsort(key)
    frequent = spark.sparkContext.broadcast((key[by], count[by]))

    reps = own.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    reps = scratch.write(reps, "reps")
    texts = docs.where("doc_id is not null")
    # 2: clusters
    seen = reps.select("rep", "n", F.posexplode("sig").alias("j", "h"))
    by = F.xxhash64("rep", "j")  # another order for each minimum hash, so that a family has many leaders
    chosen = [F.min_by, F.max_by]
    leaders = seen.groupBy("j", "h").agg(
        F.count("*").alias("c"), F.min("rep").alias("r0"), F.min_by("n", "rep").alias("n0"), *[f(c, by).alias(f"{c[0]}{k}") for k, f in enumerate(chosen, 1) for c in ("rep", "n")]
    )
    leaders = leaders.where("c > 1").select("j", "h", F.array(*[F.struct(F.col(f"r{k}").alias("b"), F.col(f"n{k}").alias("nb")) for k in range(1 + len(chosen))]).alias("led"))
    pairs = seen.join(leaders, ["j", "h"]).select(F.col("rep").alias("a"), F.col("n").alias("na"), F.inline("led"))
    links = similar_pairs(pairs, reps, texts, scratch, "led", size, percent)
    roots = components(scratch, links, "led")
    # sizes are tables of their own, so that Spark knows how large they are, and broadcasts small ones instead of moving a large cluster to one task
    sizes = scratch.write(roots.groupBy("root").agg(F.count("*").alias("csize")), "sizes")
    linked = scratch.write(roots.join(sizes, "root").select(F.col("node").alias("rep"), "root", "csize"), "linked")
    family = reps.select("rep", "n", F.col("sig")[0].alias("h")).join(linked, "rep", "left")
    loose = family.where("root is null").select("rep", "n", F.lit(False).alias("linked"), F.col("rep").alias("root"), F.col("h").alias("cluster"))
    alike = scratch.write(loose.groupBy("cluster").agg(F.count("*").alias("csize")).where("csize > 1"), "alike")
    loose = loose.join(alike, "cluster", "left").withColumn("csize", F.coalesce("csize", F.lit(1).cast("long")))
    tied = family.where("root is not null").select("rep", "n", F.lit(True).alias("linked"), "root", F.xxhash64("root").alias("cluster"), "csize")
    family = tied.unionByName(loose)
    blocks = F.ceil(F.col("csize") / GROUP)
    grouped = family.select("rep", "n", "root", "linked", "cluster", "csize", F.when(F.col("csize") > 1, F.xxhash64("linked", "cluster", F.pmod(F.xxhash64("rep"), blocks))).otherwise(F.col("rep")).alias("grp"))
    grouped = scratch.write(grouped, "groups")
    # 3: the matrix
    buckets = max(2 * partitions(spark), (reps.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    asked = texts.select("doc_id", "text").mapInArrow(prefixes(size, percent, frequent), PREFIX).where("n > 0")
    asked = asked.join(grouped.select(F.col("rep").alias("doc_id"), "grp", "cluster", "csize", "linked"), "doc_id")
    tokens = asked.mapInArrow(prefix_tokens(buckets), "bucket long, rows binary")
    met = tokens.groupBy("bucket").applyInArrow(matrix_rows(percent), "q long, nq long, grp long")
    opened = scratch.write(met.distinct(), "opened")
    # 4: counted overlap with whole unions
    opened = qualifying(scratch, opened, grouped, texts, size, percent)
    # 5: members of opened groups
    member = grouped.select("grp", F.col("rep").alias("b"), F.col("n").alias("nb"))
    alike = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    pairs = opened.select("grp", F.col("q").alias("a"), F.col("nq").alias("na")).join(member, "grp").where(alike)
    pairs = pairs.drop("grp")
    more = similar_pairs(pairs, reps, texts, scratch, "opened", size, percent)
    of = grouped.select("rep", F.col("root").alias("cluster"))
    joined = more.join(of.select(F.col("rep").alias("a"), F.col("cluster").alias("ca")), "a").join(of.select(F.col("rep").alias("b"), F.col("cluster").alias("cb")), "b")
    top = components(scratch, joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "top")
    final = of.join(top.withColumnRenamed("node", "cluster"), "cluster", "left").select("rep", F.coalesce("root", "cluster").alias("component_id"))
    by_set = reps.select("s1", "s2", "n", "rep").join(final, "rep").drop("rep")
    out = own.select("doc_id", "n", "s1", "s2").join(by_set, ["s1", "s2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out if rows is None else by_id(out, rows, scratch)


def most_frequent(counted: DataFrame, most: int) -> Column:
    """The condition of about most rows of (token, seen) with the largest counts, without sorting them: whole steps of counts, and of the next step a part by hash. A few hundred numbers come to the driver."""
    step = F.floor(STEPS * F.log2("seen"))
    sizes = dict(counted.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect())
    room = most
    for k in sorted(sizes, reverse=True):
        if sizes[k] > room:
            part = F.pmod(F.xxhash64("token"), F.lit(1 << 32)) < F.lit((room << 32) // sizes[k])
            return (step > k) | ((step == k) & part)
        room -= sizes[k]
    return F.lit(True)


def documents_repeat(docs: DataFrame) -> bool:
    return not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def by_id(out: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The result for numbered rows, in terms of their ids: a component has its smallest doc_id, and all rows of a doc_id the smallest component of them."""
    ids = rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"))
    out = scratch.write(out.join(ids, "doc_id", "left").select("id", "n_shingles", "component_id"), "numbered")
    least_id = out.groupBy("component_id").agg(F.min("id").alias("least_id"))
    of_id = out.select("id", "component_id").distinct().join(least_id, "component_id").groupBy("id").agg(F.min("least_id").alias("component_id"))
    return out.drop("component_id").join(of_id, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")

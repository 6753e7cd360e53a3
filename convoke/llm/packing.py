"""Order-preserving packing of token streams into windows, by dynamic programming.

The documents of a range of doc_id form one stream of ids. Windows of at most WINDOW ids may end at a document's end, at a
sentence's end, or, where those are far apart, every GAP ids; the cost of a window is its padding plus the penalty of its end.
With D[i] the least cost up to boundary i at position p[i],

    D[i] = penalty[i] + WINDOW - p[i] + min over p[i] - p[j] <= WINDOW of (D[j] + p[j]),

the minimum being kept by a monotone queue, so that each boundary enters and leaves it once. What remains at the stream's end
is cut into sequences of a power of two, which need no padding.
"""

import zlib
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm.ranges import ordered, ordered_ranges
from convoke.llm.tokens import encoder

#: Ids of a window, the end id, bytes of text in a range of documents.
WINDOW, END, RANGE = 4096, 2, 4_000_000
#: Penalties of a window that ends at a document's end, at a sentence's end, and elsewhere; ids between cuts of the last kind.
DOCUMENT, SENTENCE, ELSEWHERE, GAP = 0, 4, 24, 32

_ends: dict[str, np.ndarray] = {}


def sentence_ends(path: str) -> np.ndarray:
    """Whether an id's token ends with a full stop, an exclamation or a question mark."""
    if path not in _ends:
        vocabulary = {t: i for t, i in encoder(path).vocabulary.items()}
        flags = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            flags[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        _ends[path] = flags
    return _ends[path]


def boundaries(ids: np.ndarray, doc_end: np.ndarray, is_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and their penalties."""
    n = len(ids)
    kind = np.full(n + 1, -1, np.int64)
    kind[1:][is_end[ids]] = SENTENCE
    kind[doc_end] = DOCUMENT
    kind[n] = DOCUMENT
    at = np.flatnonzero(kind >= 0)
    at = at[at > 0]
    before = np.concatenate([[0], at[:-1]])
    gap = min(GAP, window)
    far = np.flatnonzero(at - before > 2 * gap if window > 2 * gap else at - before > gap)
    if len(far):
        count = (at[far] - before[far] - 1) // gap
        more = np.repeat(before[far], count) + gap * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        kind[more] = ELSEWHERE
        at = np.flatnonzero(kind >= 0)
        at = at[at > 0]
    return at, kind[at]


def cuts(position: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Ends of the windows of least cost; the last is the stream's end. Without padding costs of the last window, which is cut anew."""
    p = [0, *position.tolist()]
    extra = [0, *penalty.tolist()]
    score, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])  # boundaries j of ascending p[j] and D[j] + p[j]
    value = [0] * len(p)
    last = len(p) - 1
    for i in range(1, len(p)):
        low = p[i] - window
        while p[queue[0]] < low:
            queue.popleft()
        if i < last:
            j = queue[0]
            score[i] = value[j] + extra[i] + window - p[i]
        else:  # the last window's padding doesn't count
            j = min((k for k in range(bisect_left(p, low), last)), key=score.__getitem__)
            score[i] = score[j] + extra[i]
        back[i] = j
        v = value[i] = score[i] + p[i]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
    out, i = [], last
    while i:
        out.append(p[i])
        i = back[i]
    return out[::-1]


def windows_of(ids: np.ndarray, doc_end: np.ndarray, is_end: np.ndarray, window: int) -> np.ndarray:
    """Starts of all sequences, and the stream's end."""
    if not len(ids):
        return np.zeros(1, np.int64)
    ends = cuts(*boundaries(ids, doc_end, is_end, window), window)
    edge = [0, *ends]
    left = edge[-1] - edge[-2]
    tail = []
    while left:
        size = 1 << (left.bit_length() - 1)
        tail.append(size)
        left -= size
    return np.array([*edge[:-1], *(edge[-2] + np.cumsum(tail))], np.int64)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_pieces long"


def pack_bucket(tokenizer: str, window: int, end: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("digest", "ascending")], null_placement="at_start")
        ids, counts = encoder(tokenizer).flat(rows["text"].combine_chunks(), end)
        data, doc_edge = ids.tobytes(), np.concatenate([[0], np.cumsum(counts)])
        is_end = sentence_ends(tokenizer)
        edge = windows_of(ids, doc_edge[1:], is_end if end < len(is_end) else np.append(is_end, np.zeros(end + 1 - len(is_end), bool)), window)
        at = np.union1d(edge, doc_edge)
        a, b = at[:-1], at[1:]
        doc, seq = np.searchsorted(doc_edge, a, side="right") - 1, np.searchsorted(edge, a, side="right") - 1
        crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return pa.table({
            "doc_id": rows["doc_id"].combine_chunks().take(pa.array(doc)), "start": a - doc_edge[doc], "length": b - a, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": counts[doc],
            "sequence_id": (key[0].as_py() << 32) + seq, "offset": a - edge[seq], "n_pieces": np.bincount(doc, minlength=len(counts))[doc],
        })

    return run


def packed(spark: SparkSession, documents: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_pieces) of documents(doc_id, text, ...).

    Documents follow in ascending doc_id (null first; rows of equal doc_id in order of their texts' hashes), each as its ids and
    the end id; a null text is empty. A sequence is as long as its pieces, and is to be padded to window unless its length
    is a power of two. sequence_id is the range's number times 2^32 plus the sequence's number in it. Equal tables give equal
    pieces, however they are partitioned; an empty one gives none.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window is a power of two")
    rows = ordered_ranges(spark, ordered(documents), RANGE).select("doc_id", "text", "digest", "bucket")
    return rows.groupBy("bucket").applyInArrow(pack_bucket(tokenizer, window, end), OUT)

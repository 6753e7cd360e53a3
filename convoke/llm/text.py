"""Words and their hashes, computed over whole Arrow buffers with numpy rather than word by word.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, within one document. A word's hash is by tabulation: the sum
modulo 2^64 of a mixed value for each byte at its place in the word, mixed with the length. The hash of a run of words joins
those of its parts, each joint mixed; runs of any length sum mixed values of words at their places. No value is a power of a
base, so that words have no algebra in common with their hashes; two unequal words collide with a chance of about 2^-64.
What has to be exact compares word_numbers(), which are equal for equal words only.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the temporary arrays, however long a document is.
SEGMENT = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Values of bytes at the first PLACES places of a word; beyond them they are computed.
PLACES = 64
JOINT = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUE, PLACE_SEED = mix(np.arange(1, 257, dtype=np.uint64)), np.uint64(0xD6E8FEB86659FD93)


def at_place(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix(place.astype(np.uint64) + PLACE_SEED) + values)


TABLE = at_place(np.tile(BYTE_VALUE, PLACES), np.repeat(np.arange(PLACES), 256))


def places(size: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each of the sizes, one after another."""
    end = np.cumsum(size, dtype=np.int64)
    n = int(end[-1]) if len(end) else 0
    kind = np.int32 if n < 1 << 31 else np.int64
    return np.arange(n, dtype=kind) - np.repeat((end - size).astype(kind), size)


def summed(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of as many consecutive values as each size says."""
    full = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(size) - size)[full])
    return mix(out + mix(size.astype(np.uint64)))


def byte_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs of bytes of these sizes."""
    place = places(size)
    if not len(place):
        return summed(np.zeros(0, np.uint64), size)
    if int(size.max()) <= PLACES:
        return summed(TABLE[place * 256 + data], size)
    far = np.flatnonzero(place >= PLACES)
    values = TABLE[np.minimum(place, PLACES - 1) * 256 + data]
    values[far] = at_place(BYTE_VALUE[data[far]], place[far])
    return summed(values, size)


def run_hashes(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs of word hashes of these sizes."""
    return summed(at_place(values, places(size)), size)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * JOINT + b)


def sequence_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every size consecutive values, by doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, part, have = None, 0, values, 1
    while True:
        if size & have:
            out = part[:n] if out is None else join(out, part[at : at + n])
            at += have
        if 2 * have > size:
            return mix(out + np.uint64(size))
        part = join(part[:-have], part[have:])
        have *= 2


@dataclass
class Words:
    """Words of a run of documents: byte ranges in data, their bytes one after another, hashes, and for each document where its words start (documents + 1)."""

    data: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.doc)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (documents + 1) of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if column.offset or column.buffers()[0] is not None:
        column = pa.concat_arrays([column.slice(0, 0), pa.array(column.to_pylist(), pa.large_binary())])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_buffer(column)
    if lower:
        data = LOWER[data]
    starts, ends, letters, hashes = [], [], [], []
    n, at = len(data), 0
    doc_start = offsets[:-1][np.diff(offsets) > 0]
    while at < n:
        stop = n
        if n - at > SEGMENT:  # cut before a space or a document's start, so that no word is split
            stop = at + SEGMENT
            while stop < n:
                seen = data[stop : stop + 4096]
                cuts = np.flatnonzero(SPACE[seen])
                nxt = doc_start[np.searchsorted(doc_start, stop) :][:1]
                cut = min([stop + int(c) for c in cuts[:1]] + [int(x) for x in nxt if x < stop + len(seen)], default=None)
                if cut is not None:
                    stop = cut
                    break
                stop += len(seen)
        part = data[at:stop]
        inside = ~SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = doc_start[np.searchsorted(doc_start, at) : np.searchsorted(doc_start, stop)] - at
        first[own] |= inside[own]
        s = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        e = np.flatnonzero(last) + 1
        starts.append(s + at)
        ends.append(e + at)
        letters.append(part[inside])
        hashes.append(byte_hashes(letters[-1], e - s))
        at = stop
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    start = cat(starts, np.int64)
    return Words(data, cat(letters, np.uint8), start, cat(ends, np.int64), cat(hashes, np.uint64), np.searchsorted(start, offsets))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of size consecutive words within a document."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    room = np.ones(n + size, bool)
    for k in range(1, size):  # a window that would cross the end of a document
        cross = w.doc[1:-1] - k
        room[cross[(cross >= 0) & (cross < n)]] = False
    at = np.flatnonzero(room[:n])
    return at, sequence_hashes(w.hash, size)[at]


def word_array(w: Words) -> pa.Array:
    """The words as an Arrow array."""
    edge = np.concatenate([[0], np.cumsum(w.end - w.start, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(w.letters))])


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word, the same for equal words only; by Arrow's dictionary, which compares bytes."""
    return word_array(w).dictionary_encode().indices.to_numpy()


def exact_groups(h: np.ndarray, number: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(group of each window, how many): windows of size words, at these first words with these hashes, are in one group if their words are equal."""
    by = np.argsort(h, kind="stable")
    new = np.append(True, h[by][1:] != h[by][:-1]) if len(h) else np.zeros(0, bool)
    of = np.cumsum(new) - 1
    leader = at[by][np.flatnonzero(new)][of] if len(h) else at
    unlike = np.zeros(len(h), bool)
    for k in range(size):
        unlike |= number[at[by] + k] != number[leader + k]
    n = int(of[-1]) + 1 if len(h) else 0
    if unlike.any():  # a collision: these windows are told apart by their words
        odd = np.flatnonzero(np.isin(of, of[unlike]))
        _, back = np.unique(number[at[by][odd][:, None] + np.arange(size)], axis=0, return_inverse=True)
        of[odd] = n + back.reshape(-1)
        n += int(back.max()) + 1
    group = np.empty(len(h), np.int64)
    group[by] = of
    return group, n


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose sizes sum to most at the most, or of one document."""
    total, first = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > first and total + s > most:
            yield first, i
            first, total = i, 0
        total += s
    if first < len(sizes):
        yield first, len(sizes)

"""Seeded 64-bit buffer hash (the public MurmurHash64A definition), vectorised over Arrow batches."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash's public definition.
MULTIPLIER = 0xC6A4A7935BD1E995
SHIFT = 47
MASK = (1 << 64) - 1


def murmur64a(data: bytes, seed: int = 0) -> int:
    whole = len(data) // 8 * 8
    with np.errstate(over="ignore"):
        m = np.uint64(MULTIPLIER)
        k = np.frombuffer(data, "<u8", whole // 8) * m
        k = ((k ^ (k >> np.uint64(SHIFT))) * m).tolist()
    h = seed ^ (len(data) * MULTIPLIER & MASK)
    for x in k:
        h = (h ^ x) * MULTIPLIER & MASK
    if tail := data[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * MULTIPLIER & MASK
    h ^= h >> SHIFT
    h = h * MULTIPLIER & MASK
    return h ^ h >> SHIFT


def murmur64a_all(buffers: list[bytes], seed: int = 0) -> np.ndarray:
    """The hashes of many buffers: all of them take a block of 8 bytes at a time together, longest first, so that those that still have one are a prefix."""
    size = np.array([len(b) for b in buffers], np.int64)
    by = np.argsort(-(size // 8), kind="stable")
    blocks = (size // 8)[by]
    m, shift = np.uint64(MULTIPLIER), np.uint64(SHIFT)
    words = np.frombuffer(b"".join([buffers[i][: len(buffers[i]) // 8 * 8] for i in by.tolist()]), "<u8").astype(np.uint64) * m
    words = (words ^ (words >> shift)) * m
    start = np.cumsum(blocks) - blocks
    h = np.uint64(seed & MASK) ^ (size[by].astype(np.uint64) * m)
    left = np.searchsorted(-blocks, -np.arange(int(blocks.max()) if len(blocks) else 0), side="left")  # how many have more than k blocks
    for k, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ words[start[:n] + k]) * m
    tail = np.array([int.from_bytes(buffers[i][len(buffers[i]) // 8 * 8 :], "little") for i in by.tolist()], np.uint64)
    h = np.where(size[by] % 8 > 0, (h ^ tail) * m, h)
    h = (h ^ (h >> shift)) * m
    out = np.empty(len(buffers), np.uint64)
    out[by] = h ^ (h >> shift)
    return out


def buffer_hash64(data: Column, seed: int = 0) -> Column:
    """Signed long with the bits of the unsigned hash; null stays null."""

    @F.pandas_udf("long")
    def hashed(s: pd.Series) -> pd.Series:
        there = s.notna().to_numpy()
        out = pd.array(np.zeros(len(s), np.int64), dtype="Int64")
        out[there] = murmur64a_all([bytes(b) for b in s[there]], seed).view(np.int64)
        out[~there] = pd.NA
        return pd.Series(out)

    return hashed(data)

"""Token-id files: static range asymmetric numeral systems (rANS) over interleaved lanes.

A file holds the ids of a range of documents: a header, the documents' ids and counts, one table of frequencies shared by all
its blocks, and blocks that decode independently. In a block, id number i belongs to lane i % LANES; each lane has its own 64-bit
state, and the lanes' 32-bit words stand in the order in which a decoder wants them. Every CHECK steps a block has a
checkpoint (states and word position), from which decoding can start, and at the end the CRC-32 of its ids.

All lanes of all blocks of a file are coded at once, a numpy step a row of them.

File: MAGIC, then sections of (length u64, bytes): docs (int64 ids, with their count), counts (u32 a document), null flags,
table (symbols u32, frequencies u32), then for each block: n u32, crc u32, steps of its checkpoints u32 ..., as in pack_block.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"CVRANS1\n"
LANES, BLOCK, CHECK = 64, 1 << 16, 256
LOW = 31  # states lie in [2^31, 2^63)
U32, U64 = np.dtype("<u4"), np.dtype("<u8")


@dataclass
class Table:
    """Frequencies of symbols, summing to 2^bits."""

    bits: int
    symbols: np.ndarray
    freq: np.ndarray

    def __post_init__(self):
        self.cum = np.cumsum(self.freq) - self.freq

    @classmethod
    def of(cls, ids: np.ndarray) -> "Table":
        """Of ids below a few millions, as tokenizers have."""
        symbols, count = np.unique(ids, return_counts=True)
        if not len(symbols):
            return cls(0, symbols.astype(np.uint32), count.astype(np.uint64))
        bits = min(24, max(12, int(len(symbols)).bit_length() + 3))
        total = 1 << bits
        freq = np.maximum(1, np.floor(count * (total / count.sum()))).astype(np.int64)
        spare = total - int(freq.sum())
        if spare > 0:
            freq[np.argmax(count)] += spare
        while spare < 0:  # take from the largest, which lose least
            by = np.argsort(-freq, kind="stable")[: max(1, min(-spare, int((freq > 1).sum())))]
            take = np.minimum(freq[by] - 1, max(1, -spare // len(by)))
            take[np.cumsum(take) > -spare] = 0
            if not take.any():
                take[0] = min(freq[by[0]] - 1, -spare)
            freq[by] -= take
            spare += int(take.sum())
        return cls(bits, symbols.astype(np.uint32), freq.astype(np.uint64))


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    n = len(ids)
    if not n:
        return []
    blocks, steps = -(-n // BLOCK), BLOCK // LANES
    place = np.zeros(blocks * BLOCK, np.int32)
    place_of = np.zeros(int(table.symbols[-1]) + 1, np.int32)
    place_of[table.symbols] = np.arange(len(table.symbols), dtype=np.int32)
    place[:n] = place_of[ids]
    place = place.reshape(blocks, steps, LANES)
    sizes = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    live = (np.arange(BLOCK) < sizes[:, None]).reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), 1 << LOW, np.uint64)
    words, wrote = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    saved = {}
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    last = -(-int(sizes.max()) // LANES)
    for s in range(last - 1, -1, -1):
        k, on = place[:, s], live[:, s]
        f, c = table.freq[k], table.cum[k]
        big = on & (state >= f << top)
        words[s], wrote[s] = state.astype(np.uint32), big
        x = np.where(big, state >> np.uint64(32), state)
        q = x // f
        state = np.where(on, (q << bits) + (x - q * f) + c, state)
        if s % CHECK == 0 and s:
            saved[s] = state
    out = []
    for b in range(blocks):
        own = wrote[:, b]
        stream = words[:, b][own]
        before = np.concatenate([[0], np.cumsum(own.sum(axis=1))])
        marks = [s for s in sorted(saved) if s * LANES < sizes[b]]
        part = ids[b * BLOCK : b * BLOCK + int(sizes[b])].astype(U32)
        head = np.array([sizes[b], zlib.crc32(part.tobytes()), len(marks), len(stream)], U32).tobytes()
        points = b"".join(np.array([s, before[s]], U32).tobytes() + saved[s][b].astype(U64).tobytes() for s in marks)
        out.append(head + state[b].astype(U64).tobytes() + points + stream.astype(U32).tobytes())
    return out


@dataclass
class Start:
    """Where decoding of a block can begin."""

    step: int
    word: int
    state: np.ndarray


def parse_block(raw: bytes) -> tuple[int, int, list[Start], np.ndarray]:
    """(ids, crc, starts: the block's own and its checkpoints, words)."""
    n, crc, marks, count = np.frombuffer(raw, U32, 4).tolist()
    at = 16 + 8 * LANES
    starts = [Start(0, 0, np.frombuffer(raw, U64, LANES, 16))]
    for _ in range(marks):
        step, word = np.frombuffer(raw, U32, 2, at).tolist()
        starts.append(Start(step, word, np.frombuffer(raw, U64, LANES, at + 8)))
        at += 8 + 8 * LANES
    return n, crc, starts, np.frombuffer(raw, U32, count, at)


def decode_blocks(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """All blocks' ids, every checkpoint's stretch of them decoded in parallel; raises ValueError if a checksum differs."""
    parsed = [parse_block(b) for b in blocks]
    jobs = [(i, s, min(CHECK, -(-(n - s.step * LANES) // LANES))) for i, (n, _, starts, _) in enumerate(parsed) for s in starts]
    out = [np.zeros(n, np.uint32) for n, _, _, _ in parsed]
    if not jobs:
        return out
    base = np.cumsum([0, *[len(p[3]) for p in parsed]])
    words = np.concatenate([*[p[3] for p in parsed], np.zeros(LANES, np.uint32)]).astype(np.uint64)
    state = np.stack([s.state for _, s, _ in jobs]).astype(np.uint64)
    at = np.array([base[i] + s.word for i, s, _ in jobs])
    left = np.array([parsed[i][0] - s.step * LANES for i, s, _ in jobs])
    got = np.zeros((len(jobs), CHECK, LANES), np.uint32)
    slot = np.repeat(np.arange(len(table.symbols), dtype=np.int32), table.freq.astype(np.int64))
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    lane = np.arange(LANES)
    for s in range(max(c for _, _, c in jobs)):
        on = lane + s * LANES < left[:, None]
        low = state & mask
        k = slot[low.astype(np.int64)]
        got[:, s] = table.symbols[k]
        x = table.freq[k] * (state >> bits) + low - table.cum[k]
        need = on & (x < np.uint64(1 << LOW))
        rank = np.cumsum(need, axis=1)
        nxt = words[np.minimum(at[:, None] + rank - 1, len(words) - 1)]
        state = np.where(on, np.where(need, (x << np.uint64(32)) | nxt, x), state)
        at += rank[:, -1]
    for (i, s, c), ids in zip(jobs, got, strict=True):
        a = s.step * LANES
        b = min(len(out[i]), a + c * LANES)
        out[i][a:b] = ids.reshape(-1)[: b - a]
    for ids, (_, crc, _, _) in zip(out, parsed, strict=True):
        if zlib.crc32(ids.astype(U32).tobytes()) != crc:
            raise ValueError("a block's checksum differs")
    return out


def section(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + raw


def write_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    table = Table.of(ids)
    blocks = encode_blocks(ids, table)
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), counts.astype(U32).tobytes(), np.array([d is None for d in doc_ids], bool).tobytes(),
        bytes([table.bits]) + table.symbols.astype(U32).tobytes() + table.freq.astype(U32).tobytes(), *blocks,
    ]
    return MAGIC + b"".join(map(section, parts))


def sections(raw: bytes) -> Iterator[bytes]:
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC)
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        yield raw[at + 8 : at + 8 + n]
        at += 8 + n


def read_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids)."""
    docs, counts, nulls, packed, *blocks = sections(raw)
    k = (len(packed) - 1) // 8
    table = Table(packed[0], np.frombuffer(packed, U32, k, 1), np.frombuffer(packed, U32, k, 1 + 4 * k).astype(np.uint64))
    out = decode_blocks(blocks, table)
    ids = [None if z else int(d) for d, z in zip(np.frombuffer(docs, "<i8"), np.frombuffer(nulls, bool), strict=True)]
    return ids, np.frombuffer(counts, U32), np.concatenate(out) if out else np.zeros(0, np.uint32)

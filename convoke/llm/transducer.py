"""SentencePiece encoding and decoding by a weighted finite-state transducer, for BPE models with byte fallback.

Three parts are compiled from a model file:

* the normaliser: a blank is put before the text and blanks become U+2581 (identity otherwise; a model whose normaliser does more or less is refused);
* the pieces: a trie from characters to pieces, with an arc to bytes for a character that is none;
* the grammar: its state is the last piece. BPE's result is the one sequence in which every two neighbours are also what BPE
  makes of the two alone, so an arc from one piece to the next weighs 0 if they are, and infinity if not. The arcs are
  found when first needed, by merging the two pieces' characters, and kept.

An input is composed with these left to right, and the path of least weight in the tropical semiring is taken: of the arcs that
end at a position exactly one has a finite weight, so a state a position is enough. Runs of several blanks, whose merges tie
in weight, are resolved by merging itself. Decoding is the inverse: bytes and pieces back to text, less the blank in front.

No piece goes on into a blank, so that inputs are cut before blanks, and what was composed once is kept, up to a bound.
"""

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoke.llm import text as T

BLANK = "▁"
SEGMENTS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Bytes that the kept segments take (each counts KEEP more than its text and ids), and arcs that are kept.
CACHE, KEEP, ARCS = 48 << 20, 200, 400_000
#: Bytes of texts or ids that are in hand at a time.
SLICE = 4 << 20
NONE: dict = {}


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, message[at : at + size]
            at += size


def check_normaliser(model: bytes) -> None:
    """Raises ValueError unless the model's normalizer_spec is the one that encode() applies: no character map, a blank in front, extra blanks kept, blanks replaced."""
    spec = {2: b"", 3: 1, 4: 1, 5: 1, 6: b""}  # precompiled_charsmap, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces, normalization_rule_tsv
    trainer: dict = {24: 0}  # treat_whitespace_as_suffix
    for number, value in fields(model):
        if number in (2, 3):
            (trainer if number == 2 else spec).update(fields(value))
    if spec[2] or spec[6] or (spec[3], spec[4], spec[5]) != (1, 0, 1) or trainer[24]:
        raise ValueError("the model's normaliser isn't identity with a blank in front and extra blanks kept")


class Transducer:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_normaliser(model.serialized_model_proto())
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece goes on into a blank")
        self.arcs: dict[int, dict[int, bool]] = {}
        self.arc_count = 0
        self.known: dict[str, bytes] = {}
        self.held = 0

    @cached_property
    def trie(self) -> dict:
        """A node is a dict from characters to nodes, and from "" to the id of the piece that ends there. Decoding needs none."""
        root: dict = {}
        for p, i in self.ids.items():
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        return root

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the neighbours whose union scores best, the leftmost of them, merge first."""
        part: list[str] = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and right[a] < len(part):
                s = self.score.get(both := part[a] + part[right[a]])
                if s is not None:
                    heapq.heappush(heap, (-s, a, both))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a]
            if not part[a] or b >= len(part) or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, ""
            right[a] = right[b]
            if right[a] < len(part):
                left[right[a]] = a
            offer(left[a])
            offer(a)
        return [p for p in part if p]

    def merge_short(self, text: str) -> list[str]:
        """merge() for a few characters, without a heap."""
        part, score = list(text), self.score.get
        while True:
            best, at = None, 0
            for k in range(len(part) - 1):
                s = score(part[k] + part[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return part
            part[at : at + 2] = [part[at] + part[at + 1]]

    def allowed(self, one: int, two: int) -> bool:
        """Whether the grammar's arc from piece one to piece two has a finite weight."""
        a, b = self.pieces[one], self.pieces[two]
        if self.arc_count >= ARCS:
            self.arcs.clear()
            self.arc_count = 0
        self.arc_count += 1
        ok = self.merge_short(a + b) == [a, b]
        self.arcs.setdefault(one, {})[two] = ok
        return ok

    def shortest_path(self, segment: str) -> list[int]:
        """Ids on the path of finite weight; -1 - c stands for a character c that is no piece, which merges with nothing."""
        n, trie, arcs = len(segment), self.trie, self.arcs
        begin, last = [-1] * (n + 1), [0] * (n + 1)  # of the last piece on the path to each position
        for i in range(n):
            before = last[i] if i else -1
            from_here = arcs.get(before, NONE) if before >= 0 else NONE
            node, j = trie, i
            while j < n:
                node = node.get(segment[j])
                if node is None:
                    break
                j += 1
                piece = node.get("")
                if piece is not None and begin[j] < 0:
                    ok = before < 0 or from_here.get(piece)
                    if ok is None:
                        ok = self.allowed(before, piece)
                        from_here = arcs.get(before, NONE)
                    if ok:
                        begin[j], last[j] = i, piece
            if begin[i + 1] < 0 and "" not in trie.get(segment[i], NONE):
                begin[i + 1], last[i + 1] = i, -1 - ord(segment[i])
        out, j = [], n
        while j:
            out.append(last[j])
            j = begin[j]
        return out[::-1]

    def segment_ids(self, segment: str) -> bytes:
        if segment.startswith(BLANK * 2):
            path = [self.ids.get(p, -1 - ord(p[0])) for p in self.merge(segment)]
        else:
            path = self.shortest_path(segment)
        if min(path) >= 0:
            return array("I", path).tobytes()
        out = array("I")
        for i in path:
            out.extend([i] if i >= 0 else [self.id_of_byte[b] for b in chr(-1 - i).encode()])
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for a null or empty text."""
        if not text:
            return b""
        if self.held >= CACHE:  # what came first is the most frequent
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.held = sum(2 * len(s) + len(ids) + KEEP for s, ids in self.known.items())
        out = []
        for s in SEGMENTS.findall(BLANK + text.replace(" ", BLANK)):
            ids = self.known.get(s)
            if ids is None:
                ids = self.segment_ids(s)
                if len(s) <= 64:
                    self.known[s] = ids
                    self.held += 2 * len(s) + len(ids) + KEEP
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD. Control pieces have no text."""
        raw = self.decoder
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text.removeprefix(" ")

    @cached_property
    def decoder(self) -> list[bytes]:
        return [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(BLANK, " ").encode() if p in self.ids else b"" for i, p in enumerate(self.pieces)]


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, cut by the bytes of column 1."""
    for batch in batches:
        for a, b in T.slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), SLICE):
            yield batch.slice(a, b - a)


def encoded(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, for each row of documents(doc_id, text, ...).

    A null or empty text has no ids. Rows of equal or null doc_id are each encoded and keep their doc_id; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(model).encode
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(t) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text) for each row of ids(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = transducer(model).decode
        for part in sliced(batches):
            raw = part.column(1).to_pylist()
            columns = [pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([decode(x) for x in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_ids", "ids_crc32", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")

"""Repair of conversations' structure at the least cost, by Dial's shortest paths.

Nodes are (place among the rows, what was said last); keeping, giving another role, deleting and inserting are arcs of cost 0 to
3. Distances to the end are found with a ring of buckets, one for each distance up to the largest cost, and the audit walks the
arcs that lie on shortest paths, taking the least letter at each node. Rows that must go are no part of the graph: they cost 3
each wherever the path runs, and their letter D is the least, so it comes as soon as it can.

Rows are range-partitioned by conversation and order, and a task streams its conversations one by one. A conversation that goes on
in another partition is done by pieces: each piece gives the distances from each of its four ways in to each way out, these are
composed from the end backwards to distances at every piece's end and then, with the walks, forwards to the states in which
pieces begin. A piece is a few numbers there. Only the digest of such a conversation, which is sequential by its definition, is made by
one task, through which the repaired rows stream.
"""

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.llm.scratch import Scratch, partitions

BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted row or another role leads from each state; what a row leads to if it is kept, by its initial; their inverses.
TURN = (USER, USER, ASSISTANT, USER)
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TURNED = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
KEPT = {c: tuple(tuple(p for p, q in to.items() if q == state) for state in range(4)) for c, to in KEEP.items()}
NONE = ((), (), (), ())
REROLE, DELETE, INSERT, LARGEST = 2, 3, 2, 3
#: Cost, and rows inserted, after the last row in each state.
END, TAIL = (0, 4, 2, 0), ("", "II", "I", "")
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Bytes of text in a partition, characters of a text that ranges are cut by, bytes of repaired rows sent at a time.
PART, PREFIX, CHUNK = 16_000_000, 48, 4_000_000
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations(conv_id, turn, role, text, ...) after damage by crc32 of conv_id:turn.

    Null ids, turns, roles and texts are one space there, in roles and texts also after. A row that was dropped has copies 0.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"), F.pmod(F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")), F.lit(20)).alias("hit"))
    hit = F.col("hit")
    text = F.when(hit.isin(0, 1), "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 0, "").when(hit == 4, "user").otherwise(F.col("role"))
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select("conv_id", F.when(hit != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def distances(rows: list[tuple[str, bool]], ends: tuple | list, wanted: tuple = (START,)) -> list[int]:
    """Costs from each node 4 * place + state to the end; ends are those after the last row in each state. Dial: a ring of LARGEST + 1 buckets. It ends with the bucket in which the last of the wanted states before the first row is settled, if any are named; nodes farther than that stay at FAR."""
    n = len(rows)
    dist = [FAR] * (4 * n + 4)
    seeds = sorted(((d, 4 * n + q) for q, d in enumerate(ends) if d < FAR), reverse=True)
    ring: list[list[int]] = [[] for _ in range(LARGEST + 1)]
    settled, left, at, held = bytearray(len(dist)), len(wanted) or -1, 0, 0
    while left and (held or seeds):
        if not held:
            at = max(at, seeds[-1][0])
        bucket = ring[at % (LARGEST + 1)]
        while seeds and seeds[-1][0] == at:
            _, v = seeds.pop()
            if at < dist[v]:
                dist[v] = at
                bucket.append(v)
                held += 1
        while bucket:
            v = bucket.pop()
            held -= 1
            if settled[v] or dist[v] != at:
                continue
            settled[v] = 1
            i, q = v >> 2, v & 3
            if i == 0 and q in wanted:
                left -= 1
            arcs = []
            if i < n:  # inserts after the last row are the next piece's, or in ends
                arcs += [(4 * i + p, INSERT) for p in TURNED[q]]
            if i:
                initial, cut = rows[i - 1]
                arcs.append((v - 4, DELETE))
                arcs += [(4 * i - 4 + p, cut) for p in KEPT.get(initial, NONE)[q]]
                arcs += [(4 * i - 4 + p, REROLE + cut) for p in TURNED[q]]
            for u, cost in arcs:
                if at + cost < dist[u]:
                    dist[u] = at + cost
                    ring[(at + cost) % (LARGEST + 1)].append(u)
                    held += 1
        at += 1
    return dist


def walk(rows: list[tuple[str, bool]], forced: list[int], dist: list[int], state: int) -> tuple[str, int]:
    """(letters, last state) of the least of the cheapest edits. forced[i] rows that must go come before row i, or after the last."""
    i, q, out = 0, state, []
    while True:
        out.append("D" * forced[i])
        while i < len(rows):
            here, (initial, cut) = dist[4 * i + q], rows[i]
            if dist[4 * i + 4 + q] + DELETE == here:
                out.append("D")
            elif dist[4 * i + TURN[q]] + INSERT == here:
                out.append("I")
                q = TURN[q]
                continue
            elif q in KEEP.get(initial, ()) and dist[4 * i + 4 + KEEP[initial][q]] + cut == here:
                out.append("K")
                q = KEEP[initial][q]
            else:
                out.append("R")
                q = TURN[q]
            i += 1
            break
        else:
            return "".join(out), q


class Piece:
    """Rows of a conversation, or of a part of it, in order."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.live: list[tuple[str, bool]] = []
        self.said: list[tuple[str, str]] = []
        self.forced = [0]
        self.seen: set[tuple[str, str]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None  # least and largest turn, the last row's initial
        self.opening = None

    def add(self, turn: int | None, role: str, text: str, copies: int, late: bool = False) -> None:
        """late: an earlier piece has such a row."""
        if not copies:
            return
        initial = role[:1]
        if self.initial is None:
            self.opening = initial
        else:
            self.illegal += not legal(self.initial, initial)
        self.illegal += copies - 1
        self.initial = initial
        if turn is not None:
            self.turns += self.last is None or turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        said = text.rstrip(BLANKS)
        again = late or (role, text) in self.seen
        self.seen.add((role, text))
        if not said:
            self.blank += copies
            self.forced[-1] += copies
            return
        self.duplicate += copies - (not again)
        if again:
            self.forced[-1] += copies
            return
        cut = said[-1] not in ".!?"
        self.truncated += cut
        self.live.append((initial, cut))
        self.said.append((role, text))
        self.forced.append(copies - 1)

    def gaps(self) -> int:
        return 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)

    def lines(self, audit: str, state: int) -> Iterator[str]:
        """The repaired rows; the audit's letters from the piece's first on."""
        q, i, left = state, 0, self.forced[0]
        for letter in audit:
            if letter == "D" and left:
                left -= 1
                continue
            if letter == "I":
                q = TURN[q]
                yield f"{NAMES[q]}:"
                continue
            initial, (role, text) = self.live[i][0], self.said[i]
            i += 1
            left = self.forced[i]
            if letter == "K":
                q = KEEP[initial][q]
                yield f"{role}:{text}"
            elif letter == "R":
                q = TURN[q]
                yield f"{NAMES[q]}:{text}"

    def repaired(self) -> tuple:
        """A row of OUT, for a whole conversation."""
        dist = distances(self.live, END)
        audit, q = walk(self.live, self.forced, dist, START)
        audit += TAIL[q]
        text = "\n".join(self.lines(audit, START))
        cost = dist[START] + DELETE * sum(self.forced)
        return (self.conv, self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def legal(one: str, two: str) -> bool:
    return (one, two) in (("s", "u"), ("u", "a"), ("a", "u"))


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


EDGED = f"{OUT}, edge boolean"


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation -> EDGED; edge tells the first and the last conversation, which may go on elsewhere."""
    held: list[tuple] = []
    began = False
    for conv, rows in groupby(streamed(batches), key=lambda r: r[0]):
        piece = Piece(conv)
        for _, turn, role, text, copies in rows:
            piece.add(turn, role, text, copies)
        if held and len(held) > 1000:
            yield table(held[:-1], EDGED)
            held = held[-1:]
        held.append((*piece.repaired(), not began))
        began = True
    if held:
        held[-1] = (*held[-1][:-1], True)
        yield table(held, EDGED)


ORDER = ["conv_id", "turn", "role", "text"]


def ranged(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by range of (conv_id, turn, role, text), sorted. Rows are cut apart by the first PREFIX characters of their text."""
    return rows.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions(*ORDER)


def repaired_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """OUT for each conv_id of conversations(conv_id, turn, role, text, ...), after damage: see damaged.

    A conversation's rows are in order of turn, nulls first, and of role and text, by code point, where turns are equal; repeated rows are duplicates of
    the first. A null conv_id is a conversation. A null or empty text is blank; one without a row after damage has zeros. An empty table gives
    no rows. Rows that are equal in all four columns are counted before they are dealt, so none of them is a task's burden.
    """
    scratch = Scratch(spark, "conversations")
    rows = damaged(conversations).groupBy(*ORDER).agg(F.sum("copies").alias("copies"))
    size = conversations.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // PART))
    made = scratch.write(ranged(rows, parts).mapInArrow(whole, EDGED), "whole")
    # two rows a partition at most
    spread = scratch.write(made.where("edge").groupBy("conv_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("conv_id").alias("of")), "spread")
    columns = [f.split()[0] for f in OUT.split(", ")]
    if spread.isEmpty():
        return made.select(columns)
    of = F.broadcast(spread)
    done = made.join(of, made["conv_id"].eqNullSafe(of["of"]), "left_anti").select(columns)
    return done.unionByName(in_pieces(scratch, rows.join(of, rows["conv_id"].eqNullSafe(of["of"]), "left_semi"), parts))


# --- conversations of several partitions

KEYS = ["conv_id", "part"]
SUMMED = "conv_id long, part int, matrix array<long>, forced long, blank long, duplicate long, truncated long, illegal long, opening string, initial string"
WALKED = "conv_id long, part int, audits array<string>, states array<int>"


def piece_of(rows: pa.Table) -> Piece:
    """From (conv_id, part, turn, role, text, copies, late) of one piece."""
    rows = rows.combine_chunks()
    piece = Piece(rows["conv_id"][0].as_py())
    columns = [rows[c].to_pylist() for c in ("turn", "role", "text", "copies", "late")]
    order = sorted(range(len(columns[0])), key=lambda i: (columns[0][i] is not None, columns[0][i] or 0, columns[1][i].encode(), columns[2][i].encode()))
    for i in order:
        piece.add(*(c[i] for c in columns))
    return piece


def summarise(rows: pa.Table) -> pa.Table:
    """Costs from state p before the piece to state q after it, at 4 * p + q."""
    p = piece_of(rows)
    columns = [distances(p.live, [0 if e == q else FAR for e in range(4)], ())[:4] for q in range(4)]
    matrix = [columns[q][s] for s in range(4) for q in range(4)]
    return pa.Table.from_batches([table([(p.conv, rows["part"][0].as_py(), matrix, sum(p.forced), p.blank, p.duplicate, p.truncated, p.illegal, p.opening, p.initial)], SUMMED)])


COMPOSED = "conv_id long, part int, ends array<long>, cost long, blank long, duplicate long, truncated long, illegal long"


def compose(rows: pa.Table) -> pa.Table:
    """A conversation's pieces, a few numbers each -> the costs after each piece, and the conversation's figures with its first piece."""
    r = rows.sort_by("part").to_pylist()
    ends, out = list(END), []
    for x in reversed(r):
        out.append((x["conv_id"], x["part"], ends))
        m = x["matrix"]
        ends = [min(m[4 * s + q] + ends[q] for q in range(4)) for s in range(4)]
    said = [x for x in r if x["initial"] is not None]
    illegal = sum(x["illegal"] for x in r) + sum(not legal(a["initial"], b["opening"]) for a, b in zip(said, said[1:]))
    total = [ends[START] + DELETE * sum(x["forced"] for x in r), *(sum(x[c] for x in r) for c in ("blank", "duplicate", "truncated")), illegal]
    return pa.Table.from_batches([table([(*o, *(total if i == 0 else [None] * 5)) for i, o in enumerate(reversed(out))], COMPOSED)])


def walks(rows: pa.Table, composed: pa.Table) -> pa.Table:
    """The letters of a piece, and the state after it, for each state before it."""
    p = piece_of(rows)
    dist = distances(p.live, composed["ends"][0].as_py(), ())
    found = [walk(p.live, p.forced, dist, s) for s in range(4)]
    return pa.Table.from_batches([table([(p.conv, rows["part"][0].as_py(), [a for a, _ in found], [q for _, q in found])], WALKED)])


def entered(rows: pa.Table) -> pa.Table:
    """(conv_id, part, state before the piece, letters after the last)."""
    state, out = START, []
    r = rows.sort_by("part").to_pylist()
    for x in r:
        out.append((x["conv_id"], x["part"], state))
        state = x["states"][state]
    return pa.Table.from_batches([table([(*o, TAIL[state] if i + 1 == len(out) else "") for i, o in enumerate(out)], "conv_id long, part int, state int, tail string")])


LINES = "conv_id long, part int, n int, chunk binary"


def written(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The repaired rows of a piece, each with a line's end, in chunks."""
    p, out, held, size = piece_of(rows), [], [], 0
    part = rows["part"][0].as_py()
    for line in p.lines(known["audit"][0].as_py(), known["state"][0].as_py()):
        held.append(line.encode() + b"\n")
        size += len(held[-1])
        if size > CHUNK:
            out.append((p.conv, part, len(out), b"".join(held)))
            held, size = [], 0
    out.append((p.conv, part, len(out), b"".join(held)))
    return pa.Table.from_batches([table(out, LINES)])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order -> (conv_id, repaired_sha256); constant memory."""
    for conv, rows in groupby(streamed(batches), key=lambda r: r[0]):
        sha, more = hashlib.sha256(), False
        for *_, chunk in rows:
            if chunk:
                if more:
                    sha.update(b"\n")
                sha.update(memoryview(chunk)[:-1])
                more = True
        yield table([(conv, sha.hexdigest())], "conv_id long, repaired_sha256 string")


def in_pieces(scratch: Scratch, rows: DataFrame, parts: int) -> DataFrame:
    """OUT of conversations that fill several partitions; a null conv_id is kept apart by a flag."""
    cut = ranged(rows, parts).select(*ORDER, "copies", F.spark_partition_id().alias("part"), F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256).alias("said"))
    cut = scratch.write(cut, "pieces")
    said = cut.where("copies > 0").select("conv_id", "said", "part").distinct()
    first = said.groupBy("conv_id", "said").agg(F.min("part").alias("first")).withColumnsRenamed({"conv_id": "c", "said": "s"})
    late = said.join(first, said["conv_id"].eqNullSafe(first["c"]) & (said["said"] == first["s"])).where("part > first")
    late = late.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("said").alias("s"))
    marked = cut.join(late, cut["conv_id"].eqNullSafe(late["c"]) & (cut["part"] == late["p"]) & (cut["said"] == late["s"]), "left")
    marked = scratch.write(marked.select("conv_id", "part", "turn", "role", "text", "copies", F.col("p").isNotNull().alias("late")), "marked")
    turns = marked.where("copies > 0").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    wide = F.least(F.col("hi").cast("decimal(21,0)") - F.col("lo") + 1 - F.col("n"), F.lit((1 << 63) - 1)).cast("long")
    gaps = F.when(F.col("lo").isNull(), 0).otherwise(wide)
    composed = scratch.write(marked.groupBy(*KEYS).applyInArrow(summarise, SUMMED).groupBy("conv_id").applyInArrow(compose, COMPOSED), "composed")
    walked = scratch.write(marked.groupBy(*KEYS).cogroup(composed.groupBy(*KEYS)).applyInArrow(walks, WALKED), "walked")
    states = walked.select("conv_id", "part", "states").groupBy("conv_id").applyInArrow(entered, "conv_id long, part int, state int, tail string").withColumnsRenamed({"conv_id": "c", "part": "p"})
    known = walked.join(states, walked["conv_id"].eqNullSafe(states["c"]) & (walked["part"] == states["p"]))
    known = scratch.write(known.select("conv_id", "part", "state", F.concat(F.get("audits", F.col("state")), "tail").alias("audit")), "audits")
    lines = marked.groupBy(*KEYS).cogroup(known.groupBy(*KEYS)).applyInArrow(written, LINES)
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "n").mapInArrow(digests, "conv_id long, repaired_sha256 string")
    audit = known.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    out = composed.where("cost is not null").drop("part", "ends")
    for df in (turns.select("conv_id", gaps.alias("gaps")), audit, hashed):
        df = df.withColumnRenamed("conv_id", "c")
        out = out.join(df, out["conv_id"].eqNullSafe(df["c"]), "left").drop("c")
    return out.select([f.split()[0] for f in OUT.split(", ")])

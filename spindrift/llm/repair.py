"""Repair of conversations' turn structure at the least cost.

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  Rows are kept
(0), re-roled to user or assistant (1) or deleted (2, required where blank or
seen earlier); empty user or assistant rows are inserted (5); a truncated row
that is not deleted adds 5.

The search runs over layers, one a row, of four states: nothing yet, system
alone, after a user, after an assistant.  A macro edit is a run of insertions and
then what happens to the row, written ``I...I`` and one of ``D K R``: such codes
are prefix-free, so of two edit strings of equally many rows the lesser is told by
the first macro edit that differs.  A layer therefore keeps no strings, but each
state's cost, the rank of its string among the layer's, and a pointer to the
state before with the code between; strings are read back at the end.  Costs
relative to the layer's least and ranks take few values, so steps are memoised.

A conversation may hold a third of all rows.  Copies of a row are counted before
they are shuffled.  Rows are sorted by range over conversation and turn, so a long
conversation lies in many partitions.  A partition finishes the conversations that
lie inside it; of the first and last it makes a segment: costs and ranks from each
state to each, which compose.  A conversation's segments, at most one a partition,
are composed, each then finds its own edits, and its repaired text follows in
compressed blocks of bounded size.

Defined results: rows are taken by turn (nulls first), then role and text in
UTF-8 order; null roles and texts are one space; empty tables give no rows; other
columns are ignored; ``turn`` counts as a 64-bit integer, ids of any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import store

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a row inserted or re-roled in each state gets.
WANTED = ("user", "user", "assistant", "user")
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
#: What completes a conversation in each state.
TAIL = ("", "II", "I", "")
#: Bytes of text in one compressed block.
BLOCK = 4 << 20
WHITE = " \t\n\x0b\x0c\r"

Layer = tuple[tuple[int, ...], tuple[int, ...]]


def start(state: int) -> Layer:
    return tuple(0 if q == state else FAR for q in range(4)), (0, 0, 0, 0)


@lru_cache(maxsize=None)
def macro_edits(initial: str, fault: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, code) of one row's macro edits; two insertions reach every state."""
    out = []
    for q in range(4):
        at, cost, code = q, 0, ""
        for _ in range(3):
            out.append((q, at, cost + DELETE, code + "D"))
            if fault not in "bd":
                extra = TRUNCATED * (fault == "t")
                if (at, initial) in NEXT:
                    out.append((q, NEXT[at, initial], cost + extra, code + "K"))
                out.append((q, NEXT[at, WANTED[at][0]], cost + extra + RE_ROLE, code + "R"))
            at, cost, code = NEXT[at, WANTED[at][0]], cost + INSERT, code + "I"
    return tuple(out)


def _ranked(best: dict[int, tuple]) -> tuple[int, Layer]:
    """The layer of the best (cost, rank before, order after) of each state, and its least cost.

    States that another one beats whatever follows are left out, so that costs stay
    close together: after an assistant all goes on that goes on after nothing, but
    that a system row then has to be deleted, and insertions lead from state to state.
    """
    cost = [best[t][0] if t in best else FAR for t in range(4)]
    user = min(cost[USER], min(cost[NOTHING], cost[SYSTEM], cost[ASSISTANT]) + INSERT)
    assistant = min(cost[ASSISTANT], user + INSERT)
    worst = (assistant + DELETE, assistant, user, assistant)
    best = {t: x for t, x in best.items() if x[0] <= worst[t]}
    least = min(x[0] for x in best.values())
    order = sorted(best, key=lambda t: best[t][1:3])
    return least, (tuple(best[t][0] - least if t in best else FAR for t in range(4)), tuple(order.index(t) if t in best else 0 for t in range(4)))


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, initial: str, fault: str) -> tuple[int, Layer, tuple]:
    """What the least cost grows by, the next layer, and each state's (state before, code)."""
    costs, ranks = layer
    best: dict[int, tuple] = {}
    for q, t, cost, code in macro_edits(initial, fault):
        if costs[q] < FAR:
            new = (costs[q] + cost, ranks[q], code, q)
            if t not in best or new < best[t]:
                best[t] = new
    least, after = _ranked(best)
    return least, after, tuple((best[t][3], best[t][2]) if t in best else None for t in range(4))


def forward(kinds: list[tuple[str, str, int]], layer: Layer) -> tuple[int, Layer, list[tuple[tuple, int]]]:
    """Least cost, last layer, and the pointers of all layers with how often they repeat.

    kinds: initial, fault and copies of each row; further copies must be deleted.
    """
    total, pointers = 0, []
    for initial, fault, copies in kinds:
        grown, layer, back = step(layer, initial, fault)
        total += grown
        pointers.append((back, 1))
        more = copies - 1
        while more:
            grown, after, back = step(layer, initial, "b" if fault == "b" else "d")
            times = more if after == layer else 1
            total, layer, more = total + grown * times, after, more - times
            pointers.append((back, times))
    return total, layer, pointers


def edits(pointers: list[tuple[tuple, int]], state: int) -> tuple[str, int]:
    """The edit string that ends in a state, and the state that it starts from."""
    codes = []
    for back, times in reversed(pointers):
        while times:
            before, code = back[state]
            again = times if before == state else 1
            codes.extend([code] * again)
            times, state = times - again, before
    return "".join(reversed(codes)), state


def ending(layer: Layer) -> tuple[int, int]:
    """Cost above the layer's least, and state, of the best complete conversation."""
    costs, ranks = layer
    cost, _, _, state = min((costs[q] + INSERT * len(TAIL[q]), ranks[q], TAIL[q], q) for q in range(4))
    return cost, state


def replayed(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows of an edit string that starts in a state."""
    for edit in audit:
        if edit == "I":
            role, text = WANTED[state], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = WANTED[state]
        state = NEXT[state, role[0]]
        yield role, text


class _Run:
    """A run of one conversation's rows: kinds, counts, and texts in compressed blocks."""

    def __init__(self, key: str | None, conv: object):
        self.key, self.conv, self.kinds, self.blocks = key, conv, [], []
        self.roles, self.texts, self.copies, self.bytes = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.kinds:
            self.illegal += self.kinds[-1][0] + initial not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.blank += copies * (fault == "b")
        self.duplicate += 0 if fault == "b" else copies - (fault != "d")
        self.truncated += fault == "t"
        self.kinds.append((initial, fault, copies))
        self.roles.append(role), self.texts.append(text), self.copies.append(copies)
        self.bytes += len(role) + len(text)
        if self.bytes >= BLOCK:
            self.close()

    def close(self) -> None:
        if self.copies:
            self.blocks.append(packed(self.roles, self.texts, self.copies))
            self.roles, self.texts, self.copies, self.bytes = [], [], [], 0

    def rows(self) -> Iterator[tuple[str, str]]:
        for block in self.blocks:
            yield from unpacked(block)
        for role, text, n in zip(self.roles, self.texts, self.copies, strict=True):
            for _ in range(n):
                yield role, text

    def counts(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}

    def whole(self) -> dict:
        total, layer, pointers = forward(self.kinds, start(NOTHING))
        more, state = ending(layer)
        audit = edits(pointers, state)[0] + TAIL[state]
        said = "\n".join(f"{role}:{text}" for role, text in replayed(audit, NOTHING, self.rows()))
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return {"kind": "whole", "key": self.key, "conv": self.conv, **self.counts(), "gaps": gaps, "cost": total + more, "audit": audit, "repaired_sha256": hashlib.sha256(said.encode()).hexdigest()}

    def segment(self, part: int) -> Iterator[dict]:
        """A row of what composes, then the blocks."""
        self.close()
        costs, ranks = [], []
        for q in range(4):
            total, (relative, order), _ = forward(self.kinds, start(q))
            costs += [min(total + c, FAR) if c < FAR else FAR for c in relative]
            ranks += order
        ends = {"first": self.kinds[0][0], "last": self.kinds[-1][0]} if self.kinds else {}
        yield {"kind": "segment", "key": self.key, "conv": self.conv, "part": part, **self.counts(), **ends, "first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.distinct, "costs": costs, "ranks": ranks}
        kinds = iter(self.kinds)
        for seq, block in enumerate(self.blocks):
            own = [next(kinds) for _ in range(len(unpacked_copies(block)))]
            yield {"kind": "block", "key": self.key, "part": part, "seq": seq, "codes": "".join(i + f for i, f, _ in own), "payload": block}


def packed(roles: list[str], texts: list[str], copies: list[int]) -> bytes:
    table = pa.table({"role": pa.array(roles, pa.large_string()), "text": pa.array(texts, pa.large_string()), "copies": pa.array(copies, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _opened(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(block)).read_all()


def unpacked(block: bytes) -> Iterator[tuple[str, str]]:
    table = _opened(block)
    for role, text, n in zip(table["role"].to_pylist(), table["text"].to_pylist(), table["copies"].to_pylist(), strict=True):
        for _ in range(n):
            yield role, text


def unpacked_copies(block: bytes) -> list[int]:
    return _opened(block)["copies"].to_pylist()


COUNTS = "blank long, duplicate long, truncated long, illegal long"
RESULT = f"{COUNTS}, gaps long, cost long, audit string, repaired_sha256 string"
SEGMENT = "part int, seq int, first string, last string, first_turn long, last_turn long, n_turns long, costs array<long>, ranks array<int>, codes string, payload binary"


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of rows damaged by crc32 of ``conv_id:turn``, modulo 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _faults() -> Column:
    said = F.rtrim(F.col("text"), F.lit(WHITE))
    return F.when(said == "", "b").when(F.col("is_first") == 0, "d").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")


def _prepared(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with copies and fault, sorted by range; a row without copies stands for the conversation alone."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    turn = F.col("turn").cast("long")
    there = copies > 0
    text = F.when(there, F.coalesce(F.col("text").cast("string"), F.lit(" ")))
    own = rows.select(
        F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"), F.col("conv_id").alias("conv"), F.when(there & turn.isNotNull(), 1).otherwise(0).alias("known"), F.when(there, F.coalesce(turn, F.lit(0))).otherwise(0).alias("turn"),
        F.when(there, F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"), F.unhex(F.md5(text)).alias("hash"), text.alias("text"), copies.alias("copies"), F.lit(0).alias("is_first"),
    )
    # Of each role and text the first row by turn is marked; marks meet the rows where copies are counted.
    found = own.where("copies > 0").groupBy("key", "role", "hash").agg(F.min("known").alias("known"), F.min(F.when(F.col("known") == 1, F.col("turn"))).alias("least"))
    marks = found.select("key", F.lit(None).cast(own.schema["conv"].dataType).alias("conv"), "known", F.when(F.col("known") == 1, F.col("least")).otherwise(0).cast("long").alias("turn"), "role", "hash", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(1).alias("is_first"))
    counted = own.unionByName(marks).groupBy("key", "known", "turn", "role", "hash").agg(F.max("conv").alias("conv"), F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("is_first").alias("is_first"))
    shown = counted.select("key", "conv", "known", "turn", "role", "text", "copies", F.when(F.col("copies") > 0, _faults()).alias("fault"))
    order = ("key", "known", "turn", "role")
    return shown.repartitionByRange(*order, F.substring("text", 1, 256)).sortWithinPartitions(*order, "text")


def _runs(schema: StructType):
    """For a partition's sorted rows: finished conversations, and the segments of its first and last."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, n_runs, out, size = TaskContext.get().partitionId(), None, 0, [], 0
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(batch.num_columns))
            for key, conv, known, turn, role, text, copies, fault in zip(*columns, strict=True):
                if current is None or key != current.key:
                    if current is not None:
                        n_runs += 1
                        out += current.segment(part) if n_runs == 1 else [current.whole()]
                    current = _Run(key, conv)
                if copies:
                    current.add(turn if known else None, role, text, copies, fault)
                if len(out) >= 1000 or n_runs == 1 and out:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if current is not None:
            out += current.segment(part)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return run


def compose(segments: list[dict]) -> tuple[dict, list[tuple[int, int]]]:
    """Totals of a conversation and the states in which each of its segments starts and ends; segments in order."""
    layer, total, pointers = start(NOTHING), 0, []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    last = first_turn = last_turn = None
    n_turns = 0
    for s in segments:
        best: dict[int, tuple] = {}
        for q in range(4):
            for t in range(4):
                if layer[0][q] < FAR and s["costs"][4 * q + t] < FAR:
                    new = (layer[0][q] + s["costs"][4 * q + t], layer[1][q], s["ranks"][4 * q + t], q)
                    if t not in best or new < best[t]:
                        best[t] = new
        grown, layer = _ranked(best)
        total += grown
        pointers.append({t: best[t][3] for t in best})
        for c in counts:
            counts[c] += s[c]
        if last and s["first"]:
            counts["illegal"] += last + s["first"] not in ("su", "ua", "au")
        last = s["last"] or last
        if s["first_turn"] is not None:
            n_turns += s["n_turns"] - (s["first_turn"] == last_turn)
            first_turn, last_turn = s["first_turn"] if first_turn is None else first_turn, s["last_turn"]
    more, state = ending(layer)
    ends = []
    for back in reversed(pointers):
        ends.append((back[state], state))
        state = back[state]
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - n_turns
    return counts | {"gaps": gaps, "cost": total + more}, ends[::-1]


def _composed(schema: StructType):
    arrow = _arrow(schema)

    def run(found: pa.Table) -> pa.Table:
        segments = sorted(found.to_pylist(), key=lambda s: s["part"])
        totals, ends = compose(segments)
        rows = [{"key": s["key"], "conv": s["conv"], "part": s["part"], "begins": a, "ends": b, "is_last": k == len(segments) - 1} | (totals if not k else {}) for k, (s, (a, b)) in enumerate(zip(segments, ends, strict=True))]
        return pa.Table.from_pylist(rows, arrow)

    return run


PIECE = "key string, part int, seq int, audit string, payload binary"


def _replay(schema: StructType):
    arrow = _arrow(schema)

    def run(blocks: pa.Table, ends: pa.Table) -> pa.Table:
        place = ends.to_pylist()[0]
        out, blocks = [], sorted(blocks.to_pylist(), key=lambda b: b["seq"])
        kinds = [(c[0], c[1], n) for b in blocks for c, n in zip((b["codes"][i : i + 2] for i in range(0, len(b["codes"]), 2)), unpacked_copies(b["payload"]), strict=True)]
        audit = edits(forward(kinds, start(place["begins"]))[2], place["ends"])[0]
        tail = TAIL[place["ends"]] if place["is_last"] else ""
        rows = replayed(audit + tail, place["begins"], (row for b in blocks for row in unpacked(b["payload"])))
        seq, roles, texts, size = 0, [], [], 0
        for role, text in rows:
            roles.append(role), texts.append(text)
            size += len(role) + len(text)
            if size >= BLOCK:
                out.append({"key": place["key"], "part": place["part"], "seq": seq, "payload": packed(roles, texts, [1] * len(roles))})
                seq, roles, texts, size = seq + 1, [], [], 0
        out.append({"key": place["key"], "part": place["part"], "seq": seq, "audit": audit + tail, "payload": packed(roles, texts, [1] * len(roles))})
        return pa.Table.from_pylist(out, arrow)

    return run


def _digests(schema: StructType):
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, digest, begun = None, [], hashlib.sha256(), False
        told = lambda: pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], arrow)
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    if key is not None:
                        yield told()
                    key, audit, digest, begun = row["key"], [], hashlib.sha256(), False
                audit.append(row["audit"] or "")
                for role, text in unpacked(row["payload"]):
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
        if key is not None:
            yield told()

    return run


def _schema(df: DataFrame, fields: str) -> StructType:
    return StructType.fromDDL(fields.replace("CONV", df.schema["conv"].dataType.simpleString()))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, faults by kind, cost, audit and digest of the repaired rows.

    rows: conv_id, turn, role, text and, if it is there, copies: how often the row
    occurs; a row with 0 copies only keeps its conversation in the result.
    """
    sorted_rows = _prepared(rows)
    made = _schema(sorted_rows, f"kind string, key string, conv CONV, {RESULT}, {SEGMENT}")
    found = store(sorted_rows.mapInArrow(_runs(made), made), "conversations")
    segments = found.where("kind = 'segment'").drop("kind", "codes", "payload", "audit", "repaired_sha256", "gaps", "cost", "seq")
    resolved_schema = _schema(sorted_rows, f"key string, conv CONV, part int, begins int, ends int, is_last boolean, {COUNTS}, gaps long, cost long")
    resolved = store(segments.groupBy("key").applyInArrow(_composed(resolved_schema), resolved_schema), "conversation-states")
    # A segment without rows, of a dropped conversation or beside others, has no block; where it is the last it may have to complete.
    blocks = found.where("kind = 'block'").select("key", "part", "seq", "codes", "payload")
    ends = resolved.select("key", "part", "begins", "ends", "is_last")
    piece = StructType.fromDDL(PIECE)
    pieces = blocks.groupBy("key", "part").cogroup(ends.groupBy("key", "part")).applyInArrow(_replay(piece), piece)
    digest = StructType.fromDDL("key string, audit string, repaired_sha256 string")
    digests = pieces.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(_digests(digest), digest)
    totals = resolved.where("blank is not null").select("key", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    split = totals.join(digests, "key")
    return split.select(F.col("conv").alias("conv_id"), *columns).unionByName(found.where("kind = 'whole'").select(F.col("conv").alias("conv_id"), *columns))

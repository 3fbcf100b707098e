"""Best-fit packing of tokenised documents by patterns of lengths.

1. Every document becomes token ids and an end id; longer ones than a sequence
   are cut into full pieces, the first piece taking the remainder.
2. The histogram of piece lengths (as many numbers as a sequence is long) goes
   to the driver.  Patterns of few lengths that fill a sequence are
   enumerated; non-negative least squares fits how often each repeats;
   the counts are rounded down, and what is left is packed best-fit decreasing
   over the histogram.
3. The plan is a table of (length, rank range) -> (sequences, offset), bounded
   by the sequence length; pieces find their place by their rank among those
   of equal length, which is counted per partition and summed, so no task ever
   sees all pieces of a length.

Defined results: null and empty texts make one piece, the end id alone; repeated
rows are packed each; very long texts are encoded whole and cut; the table's
other columns play no part; pieces of equal length take their places in any
order; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, store
from .words import SPACE, hashes

# Fixed value: the splitting pattern of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

@dataclass(frozen=True)
class Settings:
    tokenizer: str
    sequence: int = 1024
    end_id: int = 2
    #: Runs of text whose ids a worker remembers.
    remembered: int = 2_000_000
    #: Most lengths in an enumerated pattern.
    parts: int = 3
    steps: int = 300


class Encoder:
    """Token ids of whole texts, with a memory of the runs of characters seen.

    A run is white space with the other characters after it.  A vocabulary that
    splits by SPLIT never joins text across the start of a run, so a run's ids do
    not depend on its surroundings; if it has a rank file beside it, whose merges
    give the same ids, that encodes the runs, as it is faster.  Texts with white
    space outside ASCII, and all texts of vocabularies that split otherwise, are
    encoded whole.

    special: texts that hold one of the tokenizer file's added tokens are encoded
    whole by the tokenizer, which gives that token's own id; else such strings
    are characters like others.
    """

    def __init__(self, path: str, remembered: int, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t.encode() for t in added] if special else []
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        self.plain = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
        self.by_runs, self.bytes_of = splits_by_runs(path), None
        rank_file = path.removesuffix(".json") + ".tiktoken"
        if self.by_runs and os.path.exists(rank_file):
            import tiktoken

            with open(rank_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            if len(ranks) + len(added) == plain.get_vocab_size():
                encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
                self.plain = encoding.encode_to_numpy
                self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
                for token, number in ranks.items():
                    self.bytes_of[number] = len(token)
        self.most = remembered
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _holds_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold an added token."""
        found = np.zeros(len(offsets) - 1, bool)
        raw_bytes = data.tobytes() if self.added else b""
        for token in self.added:
            at = raw_bytes.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                found[text] |= at + len(token) <= offsets[text + 1]
                at = raw_bytes.find(token, at + 1)
        return found

    def _learn(self, runs: list[bytes], keys: np.ndarray) -> None:
        """Encode new runs; those that begin with white space and end without it go in one piece."""
        blank = b"\t\n\v\f\r "
        joint = [i for i, r in enumerate(runs) if r[0] in blank and r[-1] not in blank] if self.bytes_of is not None else []
        known = set(joint)
        alone = [i for i in range(len(runs)) if i not in known]
        parts, sizes = [], []
        if joint:
            ids = self.plain(b"".join([runs[i] for i in joint]).decode())
            ends = np.cumsum([len(runs[i]) for i in joint])
            bounds = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            parts.append(ids)
            sizes.append(np.diff(bounds, prepend=0))
        if alone:
            parts += [self.plain(runs[i].decode()) for i in alone]
            sizes.append([len(x) for x in parts[len(parts) - len(alone) :]])
        first = len(self.start) - 1
        slots = np.empty(len(runs), np.int64)
        slots[joint + alone] = np.arange(first, first + len(runs))
        self.flat = np.concatenate([self.flat, *parts])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, slots)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and offsets by text."""
        if len(self.keys) > self.most:
            self.forget()
        n = len(offsets) - 1
        added = self._holds_added(data, offsets)
        whole = odd_space(data, offsets) | added if self.by_runs else np.ones(n, bool)
        starts = np.zeros(0, np.int64)
        if len(data):
            blank = SPACE[data]
            opens = blank.copy()
            opens[1:] &= ~blank[:-1]
            opens[offsets[:-1][np.diff(offsets) > 0]] = True
            starts = np.flatnonzero(opens)
        text = np.searchsorted(offsets, starts, "right") - 1
        keep = ~whole[text]
        ends = np.append(starts[1:], len(data))
        starts, ends, text = starts[keep], ends[keep], text[keep]
        unique, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != unique)) if len(self.keys) else np.arange(len(unique))
        if len(new):
            raw_bytes = data.tobytes()
            self._learn([raw_bytes[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)], unique[new])
            at = np.searchsorted(self.keys, unique)
        which = self.slots[at][inverse] if len(unique) else np.zeros(0, np.int64)
        size = self.start[which + 1] - self.start[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[which] - total[:-1], size) + np.arange(total[-1])]
        lengths = np.bincount(text, size, n).astype(np.int64)
        if whole.any():
            parts, bounds = [], np.concatenate([[0], np.cumsum(lengths)])
            for i in range(n):
                if not whole[i]:
                    parts.append(ids[bounds[i] : bounds[i + 1]])
                    continue
                text_ = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                parts.append(np.array(self.tokenizer.encode(text_, add_special_tokens=False).ids, np.uint32) if added[i] else self.plain(text_))
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, np.concatenate([[0], np.cumsum(lengths)])


def splits_by_runs(path: str) -> bool:
    """Whether a tokenizer file takes texts as they are and splits them by SPLIT."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    split = settings.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return plain and settings.get("normalizer") is None and settings["model"].get("type") == "BPE" and not settings["model"].get("dropout")


def odd_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have white space outside ASCII."""
    found = np.zeros(len(offsets) - 1, bool)
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        a, b, c = data[lead], data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
        hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        found[np.searchsorted(offsets, lead[hit], "right") - 1] = True
    return found


def cut(length: int, sequence: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than a sequence."""
    if length <= sequence:
        return [(0, length)]
    first = length % sequence or sequence
    return [(0, first)] + [(s, sequence) for s in range(first, length, sequence)]


PIECES = "piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, settings: Settings) -> DataFrame:
    """Tokenised pieces of all documents, numbered by partition and length: (part, length, place)."""
    from pyspark import TaskContext

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(settings.tokenizer, settings.remembered, special=True)
        part = TaskContext.get().partitionId()
        seen = np.zeros(settings.sequence + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            end = np.array([settings.end_id], "<u4")
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                ids = ids.astype("<u4")
                for i in range(hi - lo):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]], end])
                    for number, (start, length) in enumerate(cut(len(own), settings.sequence)):
                        values = (lo + i, number, start, length, zlib.crc32(own[start : start + length].tobytes()), part, int(seen[length]))
                        seen[length] += 1
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))], names=["doc_id", *(x.split()[0] for x in PIECES.split(", "))])

    prepare(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")


def patterns(histogram: np.ndarray, parts: int = 3) -> np.ndarray:
    """All multisets of up to ``parts`` present lengths that fill a sequence exactly.

    One row each, of lengths in descending order, filled up with zeros.
    """
    full = len(histogram) - 1
    there = histogram > 0
    lengths = np.flatnonzero(there)
    lengths = lengths[lengths > 0]
    found = [np.array([[full, 0, 0]])] if there[full] else []
    if parts >= 2:
        a = lengths[(lengths * 2 >= full) & (lengths < full)]
        a = a[there[full - a]]
        found.append(np.column_stack([a, full - a, np.zeros_like(a)]))
    if parts >= 3:
        a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        c = full - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        a, b, c = a[ok], b[ok], c[ok]
        ok = there[c]
        found.append(np.column_stack([a[ok], b[ok], c[ok]]))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_counts(table: np.ndarray, histogram: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative least squares: repeat counts of the patterns that rebuild the histogram.

    Accelerated projected gradient; each length's row is scaled so that rare
    lengths count too.
    """
    if not len(table):
        return np.zeros(0)
    scale = 1 / np.sqrt(histogram + 1.0)
    scale[0] = 0

    def forward(x):
        return scale * sum(np.bincount(table[:, k], x, len(histogram)) for k in range(table.shape[1]))

    def backward(r):
        return (scale * r)[table].sum(1)

    target = scale * histogram
    v = np.random.default_rng(1).random(len(table))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = backward(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(steps):
        following = np.maximum(y - backward(forward(y) - target) / (1.05 * top), 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = following + (t - 1) / t_next * (following - x)
        x, t = following, t_next
    return x


def plan(histogram: np.ndarray, parts: int = 3, steps: int = 300) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for every run of equal sequences."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    full = len(left) - 1

    def place(lengths: list[int], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            out.append((int(length), int(used[length]), repeats, sequence, offset))
            used[length] += repeats
            left[length] -= repeats
            offset += length
        sequence += repeats

    table = patterns(histogram, parts)
    counts = np.floor(fit_counts(table, histogram.astype(float), steps) + 1e-6).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] <= 0:
            break
        lengths = [v for v in table[i].tolist() if v]
        needs = {v: lengths.count(v) for v in lengths}
        repeats = min([counts[i], *(left[v] // k for v, k in needs.items())])
        if repeats > 0:
            # Equal lengths in one pattern take consecutive runs of ranks.
            place(lengths, int(repeats))
    # The residuals: best fit decreasing over the histogram, whole runs of equal sequences at a time.
    while left.any():
        lengths, room, needs = [], full, {}
        while room:
            fitting = np.flatnonzero(left[1 : room + 1]) + 1
            fitting = [v for v in fitting[::-1].tolist() if left[v] > needs.get(v, 0)]
            if not fitting:
                break
            # The largest that fits; for the last place an exact fit is the largest too.
            v = fitting[0]
            if len(lengths) and room - v and len(fitting) > 1:
                pair = _pair(fitting, room, left, needs)
                if pair:
                    lengths += pair
                    for p in pair:
                        needs[p] = needs.get(p, 0) + 1
                    room -= sum(pair)
                    continue
            lengths.append(v)
            needs[v] = needs.get(v, 0) + 1
            room -= v
        place(lengths, int(min(left[v] // k for v, k in needs.items())))
    return out


def _pair(fitting: list[int], room: int, left: np.ndarray, needs: dict[int, int]) -> list[int] | None:
    """Two lengths that fill the room exactly, the larger as large as can be."""
    present = set(fitting)
    for a in fitting:
        b = room - a
        if b > a:
            return None
        if b in present and (a != b or left[a] - needs.get(a, 0) >= 2):
            return [a, b]
    return None


def pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    found = store(pieces(docs, settings), "pieces")
    tally = found.groupBy("part", "length").agg((F.max("place") + 1).alias("n"))
    # One row for each partition and length; the bases are prefix sums over the partitions.
    tally = store(tally, "pieces-tally")
    histogram = np.zeros(settings.sequence + 1, np.int64)
    for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row a length
        histogram[row.length] = row.n
    runs = plan(histogram, settings.parts, settings.steps)
    from pyspark.sql import Window

    base = tally.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    ranked = found.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    by_length: dict[int, list] = {}
    for length, first, repeats, sequence, offset in runs:
        by_length.setdefault(length, []).append((first, sequence, offset))
    lookup = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(lookup)  # bounded by the lengths and patterns, not by the documents
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length).tolist():
                own = np.flatnonzero(length == v)
                first, seq, off = shared.value[v]
                at = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = seq[at] + rank[own] - first[at], off[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

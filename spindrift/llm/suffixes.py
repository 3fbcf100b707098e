"""Repeated passages by a sparse suffix array over the whole corpus.

Sorting every suffix of every text would move many times the input.  Two equal
strings of ``length`` bytes pick the same inner position by their content (the
least hash among their ``seed``-byte strings), so it is enough to sort the
suffixes at such anchors; an anchor stands for the run of windows that pick it.

1. Blocks of texts ask for the corpus counts of their anchors' seeds and of the
   anchors' whole contexts.  A context that occurs twice makes all its windows
   repeated, without being sorted (counted by 64-bit hashes); an anchor whose seed
   occurs once has none; the others stay open.
2. Open anchors' suffixes, with one witness of each repeated context, are range
   partitioned by their leading bytes and their seed with sampled splitters.
   Seeds with very many suffixes are dealt over several buckets.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time.
   Neighbours' common prefixes make the ranges within which windows are equal
   to the right of the anchor; equal left sides within a range are repeats.
4. Where a seed was dealt over buckets, windows that a bucket found once are
   compared across bucket borders.
5. The covered bytes of each text are removed together.

Strings are judged on the input; matches never cross texts.  Defined results:
null and empty texts have no bytes; texts under ``length`` bytes lose none; exact
copies of longer texts, and rows that repeat, lose all; a doc_id that several
rows have gives each its row; very long texts are read whole; the table's other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, store
from .counts import exchange, unplanes
from .words import _BYTE, _powers, mix


@dataclass(frozen=True)
class Settings:
    length: int = 200
    seed: int = 64
    #: Bytes of text in a block.
    block: int = 8 << 20
    bucket_keys: int = 500_000
    #: Suffixes in a sorting bucket, and of one seed before it is dealt over several.
    bucket: int = 40_000
    dealt: int = 4_000
    lead: int = 16


@dataclass
class Anchors:
    text: np.ndarray
    #: First window start and position of the anchor, in the block's bytes; windows after the first.
    first: np.ndarray
    at: np.ndarray
    more: np.ndarray
    seed: np.ndarray
    context: np.ndarray


def _hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Anchors:
    """The anchors of all windows of all texts, each with its run of windows."""
    out = []
    step = 1 << 19
    for lo in range(0, max(1, len(data) - s.length + 1), step):
        out.append(_anchors(data[lo : lo + step + s.length - 1], lo, offsets, s))
    joined = [np.concatenate([getattr(x, f) for x in out]) for f in ("text", "first", "at", "more", "seed", "context")]
    return Anchors(*joined)


def _anchors(data: np.ndarray, lo: int, offsets: np.ndarray, s: Settings) -> Anchors:
    none = np.zeros(0, np.int64)
    n = len(data) - s.length + 1
    if n <= 0:
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    up, down = _powers(1 << 20)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        seeds = mix((total[s.seed :] - total[: -s.seed]) * down[: len(data) - s.seed + 1])
    # The place is in the low bits, so the first of equal seeds is the least.
    key = (seeds & ~np.uint64((1 << 20) - 1)) | np.arange(len(seeds), dtype=np.uint64)
    width = s.length - s.seed + 1
    padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
    starts = np.arange(n) + lo
    text = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + s.length <= offsets[text + 1]
    starts, text, place = starts[valid], text[valid], place[valid]
    if not len(starts):
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b, at = starts[first], starts[last], place[first]
    context = _hash(total, down, a - lo, b - lo + s.length) ^ mix((at - (a - lo)).astype(np.uint64))
    # Least hashes are small ones; mixed again, they fall evenly into buckets.
    return Anchors(text[first], a, at + lo, b - a, mix(seeds[at]), context)


def text_blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """Blocks of whole texts: ids, sizes and the compressed bytes."""
    from pyspark import TaskContext

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, parts = [], [], []

        def emit():
            nonlocal ids, sizes, parts, number
            data, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            n = len(anchors(data, offsets, s).first)
            wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            row = pa.RecordBatch.from_arrays([pa.array([(part << 24) + number], pa.int64()), wrap(pa.concat_arrays(ids)), wrap(pa.array(np.concatenate(sizes))), pa.array([zstandard.ZstdCompressor(level=3).compress(data.tobytes())], pa.binary()), pa.array([n], pa.int64())], names=["block", "ids", "sizes", "data", "n_anchors"])
            ids, sizes, parts, number = [], [], [], number + 1
            return row

        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(np.diff(offsets))
                parts.append(data)
                if sum(map(len, parts)) >= s.block:
                    yield emit()
        if ids:
            yield emit()

    prepare(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"block long, ids array<{kind}>, sizes array<long>, data binary, n_anchors long")


def _bytes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))]).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(offsets[-1])))
    return np.frombuffer(data, np.uint8), offsets


def _keys(a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, inverse, n = np.unique(np.concatenate([a.seed, a.context]), return_inverse=True, return_counts=True)
    return keys, inverse, n


def _spread(blob_starts: np.ndarray, blob_ends: np.ndarray) -> bytes:
    return np.column_stack([blob_starts, blob_ends]).astype("<i8").tobytes()


SUFFIX = "lead binary, salt int, dealt boolean, block long, text int, start long, back int, more int, seed long, context long, bytes binary, covers binary"


def suffixes(blocks: DataFrame, s: Settings) -> DataFrame:
    """Open anchors and witnesses (bytes set), and covered ranges known already (covers set)."""
    n = blocks.agg(F.sum("n_anchors").alias("n")).first().n or 0

    def ask(row):
        keys, _, n = _keys(anchors(*_bytes(row), s))
        return keys, n, np.zeros(len(n), np.int64)

    found = exchange(blocks.select("block", "sizes", "data"), ask, 1 + 2 * n // s.bucket_keys, "anchor-counts", 8)
    answers = found.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "a")).alias("answers"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = _bytes(row)
                a = anchors(data, offsets, s)
                if not len(a.first):
                    continue
                keys, inverse, _ = _keys(a)
                total = np.concatenate([unplanes(x["a"]) for x in sorted(row["answers"], key=lambda x: x["bucket"])]).astype(np.int64)[inverse]
                seeds, contexts = total[: len(a.first)], total[len(a.first) :]
                again = contexts > 1
                start = a.first - offsets[a.text]
                texts, at = np.unique(a.text[again], return_index=True)
                bounds = np.append(at, np.count_nonzero(again))
                ranges = np.column_stack([start[again], start[again] + a.more[again] + s.length]).astype("<i8")
                covers = [ranges[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))]
                # Witnesses only where the seed has other contexts too, once in a block.
                open_ = np.flatnonzero(~again & (seeds > 1))
                witness = np.flatnonzero(again & (seeds > contexts))
                witness = witness[np.unique(a.context[witness], return_index=True)[1]]
                chosen = np.concatenate([open_, witness])
                raw_bytes = data.tobytes()
                m, k = len(chosen), len(texts)
                salts = -(-seeds[chosen] // s.dealt)
                first, last = a.first[chosen], a.first[chosen] + a.more[chosen] + s.length
                column = lambda x, t, fill: pa.array(np.concatenate([x, np.full(k, fill)]).astype(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([raw_bytes[p : p + s.lead] for p in a.at[chosen].tolist()] + [None] * k, pa.binary()),
                        column(a.context[chosen] % salts.astype(np.uint64), np.int32, 0),
                        pa.array(np.concatenate([salts > 1, np.zeros(k, bool)])),
                        pa.array(np.concatenate([np.where(np.arange(m) < len(open_), row["block"], -1), np.full(k, row["block"])]).astype(np.int64)),
                        pa.array(np.concatenate([a.text[chosen], texts]).astype(np.int32)),
                        column(start[chosen], np.int64, 0),
                        column(a.at[chosen] - first, np.int32, 0),
                        column(a.more[chosen], np.int32, 0),
                        pa.array(np.concatenate([a.seed[chosen].view(np.int64), np.zeros(k, np.int64)])),
                        pa.array(np.concatenate([a.context[chosen].view(np.int64), np.zeros(k, np.int64)])),
                        pa.array([raw_bytes[p:q] for p, q in zip(first.tolist(), last.tolist(), strict=True)] + [None] * k, pa.binary()),
                        pa.array([None] * m + covers, pa.binary()),
                    ],
                    names=[x.split()[0] for x in SUFFIX.split(", ")],
                )

    return blocks.select("block", "sizes", "data").join(answers, "block").mapInArrow(run, SUFFIX)


def multikey_order(table: np.ndarray) -> np.ndarray:
    """Rows of big-endian words in ascending order, by multikey quicksort, all open ranges at once.

    In each round every open range is split in three by the word of its middle
    row: less, equal, greater; the equal part goes on with the next word.
    """
    rows, width = table.shape
    order, start = np.arange(rows), np.zeros(rows, np.int64)
    size, depth = np.full(rows, rows), np.zeros(rows, np.int64)
    open_ = np.arange(rows) if rows > 1 and width else np.zeros(0, np.int64)
    while len(open_):
        words_ = table[order[open_], depth[open_]]
        first = np.searchsorted(open_, start[open_])  # open ranges are whole, so their places are too
        pivot = words_[first + size[open_] // 2]
        side = np.where(words_ < pivot, 0, np.where(words_ == pivot, 1, 2))
        by = np.argsort(start[open_] * 3 + side, kind="stable")
        order[open_] = order[open_][by]
        part = (start[open_] * 3 + side)[by]
        depth[open_] = depth[open_][by] + (side[by] == 1)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        length = np.diff(np.append(edge, len(open_)))
        start[open_], size[open_] = np.repeat(open_[edge], length), np.repeat(length, length)
        open_ = open_[(size[open_] > 1) & (depth[open_] < width)]
    return order


def _cumulative(table: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of all rows; column d: of the first d bytes."""
    up, _ = _powers(1 << 20)
    out = np.zeros((len(table), table.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[table] * up[: table.shape[1]], axis=1, out=out[:, 1:])
    return out


REPEAT = "block long, text int, covers binary, key long, start long"


def repeats(found: DataFrame, s: Settings) -> DataFrame:
    """Covered ranges from a sorted bucket of suffixes, and windows to compare across buckets (key set)."""
    left_most = s.length - s.seed

    def run(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        context = table["context"].to_numpy().view(np.uint64)
        _, keep = np.unique(context, return_index=True)  # equal contexts are witnesses of one another
        own = table["block"].to_numpy()
        keep = np.union1d(keep, np.flatnonzero(own >= 0))
        block, text, start, back, more, dealt = (table[c].to_numpy()[keep] for c in ("block", "text", "start", "back", "more", "dealt"))
        seed = table["seed"].to_numpy()[keep].view(np.uint64)
        ctx = [table["bytes"][i].as_py() for i in keep.tolist()]
        m = len(ctx)
        size = 8 * -(-s.length // 8)
        right, left = np.zeros((m, size), np.uint8), np.zeros((m, left_most), np.uint8)
        for i, c in enumerate(ctx):
            b = np.frombuffer(c, np.uint8)
            r = b[back[i] : back[i] + s.length]
            right[i, : len(r)] = r
            left[i, : back[i]] = b[: back[i]][::-1]
        order = multikey_order(right.view(">u8").astype(np.uint64))
        right, left = right[order], left[order]
        block, text, start, back, more, dealt, seed = (x[order] for x in (block, text, start, back, more, dealt, seed))
        differ = right[1:] != right[:-1]
        common = np.where(differ.any(1), differ.argmax(1), size)
        before = _cumulative(left)
        after = _cumulative(right) if dealt.any() else None
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        crossing: list[tuple] = []
        for d in range(left_most + 1):  # windows that begin d bytes before the anchor
            member = np.flatnonzero((back >= d) & (back - more <= d))
            if len(member) == 0:
                continue
            ranges = np.concatenate([[0], np.cumsum(common < s.length - d)])[member]
            with np.errstate(over="ignore"):
                key = mix(before[member, d] + mix(ranges.astype(np.uint64)))
            _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            again = n[inverse] > 1
            begin = start[member] + back[member] - d
            hit = np.flatnonzero(again & (block[member] >= 0))
            for b, t, p in zip(block[member[hit]].tolist(), text[member[hit]].tolist(), begin[hit].tolist(), strict=True):
                spans.setdefault((b, t), []).append(p)
            if after is not None:
                far = np.flatnonzero(dealt[member])
                if len(far):
                    rows = member[far]
                    with np.errstate(over="ignore"):
                        whole = mix(mix(before[rows, d] + np.uint64(d)) ^ after[rows, s.length - d] ^ seed[rows])
                    once = ~again[far]
                    _, one = np.unique(np.where(once, np.arange(len(far)), len(far) + inverse[far]), return_index=True)
                    for i in one.tolist():
                        mine = once[i] and block[rows[i]] >= 0
                        crossing.append((int(block[rows[i]]) if mine else -1, int(text[rows[i]]), int(whole[i].astype(np.int64)), int(begin[far[i]])))
        out: list[list] = [[] for _ in range(5)]
        for (b, t), starts in spans.items():
            p = np.unique(np.array(starts))
            edge = np.flatnonzero(np.diff(p) > 1)
            lo, hi = p[np.concatenate([[0], edge + 1])], p[np.concatenate([edge, [len(p) - 1]])] + s.length
            for column, v in zip(out, (b, t, np.column_stack([lo, hi]).astype("<i8").tobytes(), None, None), strict=True):
                column.append(v)
        for b, t, key, begin in crossing:
            for column, v in zip(out, (b, t, None, key, begin), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in REPEAT.split(", ")])

    return found.mapInArrow(run, REPEAT)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(docs: DataFrame, s: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    with_text: also the kept bytes, as ``kept`` (removal can split characters).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = store(text_blocks(docs.select("doc_id", "text"), s), "text-blocks")
    found = store(suffixes(blocks, s), "suffixes")
    open_ = found.where("bytes is not null").drop("covers")
    buckets = 1 + open_.count() // s.bucket
    # Splitters are sampled.  Windows are equal only if their seeds are, so very many seeds behind
    # one lead are dealt apart, and of one seed the parts that its salts make.
    dealt = open_.repartitionByRange(buckets, "lead", "seed", "salt")
    sorted_ = store(repeats(dealt, s), "repeats")
    crossing = sorted_.where("key is not null")
    twice = crossing.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    far = crossing.where("block >= 0").join(twice, "key", "left_semi").groupBy("block", "text").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    covers = found.where("covers is not null").select("block", "text", "covers").unionByName(sorted_.where("key is null").select("block", "text", "covers"))
    covers = covers.select("block", F.struct("text", "covers", F.lit(None).cast("array<long>").alias("starts")).alias("c")).unionByName(far.select("block", F.struct("text", F.lit(None).cast("binary").alias("covers"), "starts").alias("c")))
    by_block = covers.groupBy("block").agg(F.collect_list("c").alias("covers"))

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                data, offsets = _bytes(row)
                raw_bytes = data.tobytes()
                ranges: dict[int, list] = {}
                for c in row["covers"] or []:
                    own = np.frombuffer(c["covers"], "<i8").reshape(-1, 2) if c["starts"] is None else np.column_stack([c["starts"], np.array(c["starts"]) + s.length])
                    ranges.setdefault(c["text"], []).append(own)
                out: list[list] = [[] for _ in range(5)]
                for t in range(len(offsets) - 1):
                    text, kept, removed, n = raw_bytes[offsets[t] : offsets[t + 1]], [], 0, 0
                    if t in ranges:
                        own = np.concatenate(ranges[t])
                        own = own[np.argsort(own[:, 0], kind="stable")]
                        reach = np.maximum.accumulate(own[:, 1])
                        new = np.concatenate([[True], own[1:, 0] > reach[:-1]])
                        lo, hi = own[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(own)) - 1]
                        n, removed, at = len(lo), int((hi - lo).sum()), 0
                        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                            kept.append(text[at:a])
                            at = b
                        kept.append(text[at:])
                        rest = b"".join(kept)
                    else:
                        rest = text
                    for column, v in zip(out, (len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        column.append(v)
                columns = [batch.column("ids").slice(i, 1).flatten(), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
                names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]
                if with_text:
                    columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = blocks.select("block", "ids", "sizes", "data").join(by_block, "block", "left")
    return joined.mapInArrow(run, f"doc_id {kind}, {RESULT}" + (", kept binary" if with_text else ""))

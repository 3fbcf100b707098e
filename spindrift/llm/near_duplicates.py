"""Near duplicates by bottom-k sketches from one hash function.

1. Every text becomes its set of hashed word shingles, of which the ``k``
   smallest values are retained.  Texts with equal sets form a class; one
   member stands for it from here on, so exact copies cost nothing further.
2. Corpus counts of the retained values order them from rare to frequent.  Two
   sets that are similar enough share at least ``needed`` retained values, so
   they share one among each one's rarest ``size - needed + 1``: only those
   enter the inverted lists.  For sketches that hold the whole set ``needed``
   is exact; for others it lies six standard deviations of the hypergeometric
   overlap below its mean, which loses a link with a probability under 1e-7
   (``Settings(slack=None)`` takes every retained value and loses none that
   shares one).
3. Lists of up to ``small`` classes give all their pairs.  The members of longer
   lists are parted by set size and dealt into blocks.  Blocks are compared set
   against set, first with a few pivots, then only where two components can still
   be joined; a spanning forest of what is similar is all that leaves a task.
4. The union sketch of a pair estimates its similarity and drops clear misses;
   the exact Jaccard similarity of the full sets decides.
5. Connected components by least labels over the confirmed links.

Defined results: null or empty texts, and texts without words, have an empty
set and are linked with nothing; texts shorter than a shingle have their whole
word sequence as their one shingle; an empty table gives an empty result; a
null doc_id never names a component while another id can.  Rows that repeat a
doc_id with different texts are linked through that id's components separately.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, store
from .counts import exchange, unplanes
from .words import grams, mix, words

_BITS = 54


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Similar: denominator * intersection >= numerator * union.
    numerator: int = 85
    denominator: int = 100
    k: int = 128
    #: Longest inverted list whose pairs are all compared.
    small: int = 32
    #: Documents of a block, and keys of a counting bucket.
    block: int = 20_000
    bucket: int = 500_000
    #: Rows and bytes of sets in a block of a long list's group.
    block_rows: int = 256
    block_bytes: int = 4 << 20
    #: About how many sets of a group's band all its blocks are compared with first.
    pivots: int = 64
    #: Standard deviations of slack for sets larger than the sketch; None: no set is left to chance.
    slack: float | None = 6.0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes (54 bits), sorted by text and value, and the set sizes."""
    h, doc, _, _ = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    values = grams(h, width)
    at = doc[: len(values)]
    own = at == doc[width - 1 :] if len(values) else np.zeros(0, bool)
    values, at = values[own], at[own]
    first = np.cumsum(count) - count
    for i in np.flatnonzero((count > 0) & (count < width)).tolist():
        whole = mix(grams(h[first[i] : first[i] + count[i]], int(count[i])) + np.uint64(count[i]))
        values, at = np.append(values, whole), np.append(at, i)
    sets: list[np.ndarray] = []
    sizes = np.zeros(n, np.int64)
    # A chunk's texts are numbered by few bits, so (text, value) sorts as one number.
    for lo in range(0, n, 1 << (64 - _BITS)):
        part = (at >= lo) & (at < lo + (1 << (64 - _BITS))) if n > 1 << (64 - _BITS) else slice(None)
        key = ((at[part] - lo).astype(np.uint64) << np.uint64(_BITS)) | (values[part] >> np.uint64(64 - _BITS))
        key.sort()
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        sets.append(key & np.uint64((1 << _BITS) - 1))
        own_n = np.bincount((key >> np.uint64(_BITS)).astype(np.int64), minlength=min(n - lo, 1 << (64 - _BITS)))
        sizes[lo : lo + len(own_n)] = own_n
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for a set; None for the empty one."""
    out: list[bytes | None] = [None] * len(sizes)
    filled = np.flatnonzero(sizes)
    if len(filled):
        start = (np.cumsum(sizes) - sizes)[filled]
        with np.errstate(over="ignore"):
            a = np.add.reduceat(mix(sets), start) + sizes[filled].astype(np.uint64)
        b = np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
        for i, x in zip(filled.tolist(), np.column_stack([a, b]).astype("<u8"), strict=True):
            out[i] = x.tobytes()
    return out


def needed(n: int, s: Settings) -> int:
    """Retained values that a set of n shares at least with every similar one."""
    t = s.numerator / s.denominator
    if n * s.denominator <= s.numerator * s.k:
        return -(-n * s.numerator // s.denominator)
    if s.slack is None:
        return 1
    union = n / t
    spread = math.sqrt(s.k * t * (1 - t) * max(0.0, (union - s.k) / (union - 1)))
    return max(1, int(min(n, s.k) * t - s.slack * spread - 1))


def _width(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def sketch_blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """Blocks of documents: ids, set sizes, signatures and retained values."""
    from pyspark import TaskContext

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, sigs, kept = [], [], [], []

        def emit():
            nonlocal ids, sizes, sigs, kept, number
            all_ids, n = pa.concat_arrays(ids), np.concatenate(sizes)
            wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            values = np.concatenate(kept)
            row = pa.RecordBatch.from_arrays([pa.array([(part << 24) + number], pa.int64()), wrap(all_ids), wrap(pa.array(n, pa.int64())), wrap(pa.array(sigs, pa.binary())), pa.array([_width(values)], pa.binary()), pa.array([len(np.unique(values))], pa.int64())], names=["block", "ids", "sizes", "sigs", "kept", "n_keys"])
            ids, sizes, sigs, kept, number = [], [], [], [], number + 1
            return row

        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets, n = shingle_sets(data, offsets, s.shingle)
                start = np.cumsum(n) - n
                place = np.arange(len(sets)) - np.repeat(start, n)
                ids.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(n)
                sigs += signatures(sets, n)
                kept.append(sets[place < s.k])
            if sum(map(len, sizes)) >= s.block:
                yield emit()
        if ids:
            yield emit()

    prepare(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"block long, ids array<{kind}>, sizes array<long>, sigs array<binary>, kept binary, n_keys long")


def _keys(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, n = np.unique(_wide(row["kept"]), return_counts=True)
    mixed = mix(values)
    order = np.argsort(mixed, kind="stable")
    return mixed[order], n[order], np.zeros(len(n), np.int64)


def entries(blocks: DataFrame, s: Settings) -> DataFrame:
    """(value, sig, n) of every class's rarest retained values that other sketches have too."""
    keys = blocks.agg(F.sum("n_keys").alias("n")).first().n or 0
    found = exchange(blocks.select("block", "kept"), _keys, 1 + keys // s.bucket, "sketch-counts")
    answers = found.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "a")).alias("answers"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = _wide(row["kept"])
                unique, inverse = np.unique(values, return_inverse=True)
                order = np.argsort(mix(unique), kind="stable")
                total = np.empty(len(unique), np.int64)
                total[order] = np.concatenate([unplanes(x["a"]) for x in sorted(row["answers"], key=lambda x: x["bucket"])])
                frequency = total[inverse]
                n = np.array(row["sizes"], np.int64)
                held = np.minimum(n, s.k)
                doc = np.repeat(np.arange(len(n)), held)
                by_rarity = np.lexsort((values, frequency, doc))
                place = np.arange(len(values)) - np.repeat(np.cumsum(held) - held, held)
                limit = np.array([min(s.k, v) - needed(int(v), s) + 1 for v in n.tolist()])
                chosen = by_rarity[(place < limit[doc]) & (frequency[by_rarity] > 1)]
                at = doc[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(values[chosen].astype(np.int64)), pa.array(row["sigs"], pa.binary()).take(pa.array(at)), pa.array(n[at])], names=["value", "sig", "n"])

    return blocks.select("block", "sizes", "sigs", "kept").join(answers, "block").mapInArrow(run, "value long, sig binary, n long").distinct()


def members(blocks: DataFrame) -> DataFrame:
    """(doc_id, n, sig) of every document."""
    return blocks.select(F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("sizes").alias("n"), F.col("sigs").alias("sig"))).alias("x")).select("x.doc_id", "x.n", "x.sig")


def _similar_sizes(a: Column, b: Column, s: Settings) -> Column:
    return (F.least(a, b) * s.denominator >= F.greatest(a, b) * s.numerator)


class Verifier:
    """Confirms candidate pairs: first by union sketches, then by full sets."""

    def __init__(self, docs: DataFrame, blocks: DataFrame, candidates: DataFrame, s: Settings):
        self.s = s

        def sketches(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    n = np.array(row["sizes"], np.int64)
                    held = np.minimum(n, s.k)
                    start = (np.cumsum(held) - held) * 7
                    seen: dict = {}
                    for i, sig in enumerate(row["sigs"]):
                        if sig is not None:
                            seen.setdefault(sig, i)
                    at = list(seen.values())
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(n[at]), pa.array([row["kept"][start[i] : start[i] + held[i] * 7] for i in at], pa.binary())], names=["sig", "n", "sketch"])

        # Of a class's equal sketches any one will do.
        found = blocks.select("sizes", "sigs", "kept").mapInArrow(sketches, "sig binary, n long, sketch binary").join(candidates, "sig", "left_semi")
        self.sketches = store(found.groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")

        def sets(batches):
            for batch in batches:
                for _, _, data, offsets in chunks(batch.column(0)):
                    values, n = shingle_sets(data, offsets, s.shingle)
                    start = np.cumsum(n) - n
                    keep = np.flatnonzero(n > s.k)
                    sigs = signatures(values, n)
                    yield pa.RecordBatch.from_arrays([pa.array([sigs[i] for i in keep], pa.binary()), pa.array([_width(values[start[i] : start[i] + n[i]]) for i in keep], pa.binary())], names=["sig", "values"])

        # One document of each class that could be compared, by its id; sketches of small sets are whole.
        # A class without any id fetches the texts of all rows without one.
        large = self.sketches.where(F.col("n") > s.k).select("sig")
        chosen = members(blocks).join(large, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("chosen")).select("chosen").distinct()
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
        self.sets = store(texts.select("text").mapInArrow(sets, "sig binary, values binary").groupBy("sig").agg(F.first("values").alias("values")), "shingle-sets")

    def _judge(self, pairs: DataFrame, table: DataFrame, column: str, exact: bool) -> DataFrame:
        s = self.s
        own = table.select("sig", F.col(column).alias("x"))
        both = pairs.join(own.withColumnsRenamed({"sig": "a", "x": "xa"}), "a").join(own.withColumnsRenamed({"sig": "b", "x": "xb"}), "b")

        def run(batches):
            slack = s.k if s.slack is None else s.slack * math.sqrt(s.k * s.numerator / s.denominator * (1 - s.numerator / s.denominator)) + 1
            for batch in batches:
                keep, sure = [], []
                for a, b, n_a, n_b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = _wide(a), _wide(b)
                    merged = np.concatenate([x, y])
                    merged.sort()
                    twice = merged[1:] == merged[:-1]
                    if exact or (n_a <= s.k and n_b <= s.k):
                        common = int(np.count_nonzero(twice))
                        keep.append(common * s.denominator >= (n_a + n_b - common) * s.numerator)
                        sure.append(True)
                    else:
                        # The k smallest of the union; how many of them both have.
                        distinct = np.flatnonzero(np.concatenate([[True], ~twice]))[: s.k]
                        common = int(np.count_nonzero(twice[: distinct[-1] + 1])) if len(distinct) else 0
                        keep.append(common + slack >= s.k * s.numerator / s.denominator)
                        sure.append(False)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(mask) for i in range(4)), pa.array(sure, pa.bool_()).filter(mask)], names=["a", "b", "n_a", "n_b", "sure"])

        return both.select("a", "b", "n_a", "n_b", "xa", "xb").mapInArrow(run, "a binary, b binary, n_a long, n_b long, sure boolean")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n_a, n_b) that are similar, as (a, b)."""
        close = store(self._judge(pairs, self.sketches, "sketch", False), "close")
        checked = self._judge(close.where("not sure").drop("sure"), self._whole(), "x", True)
        return store(close.where("sure").select("a", "b").unionByName(checked.select("a", "b")), "links")

    def _whole(self) -> DataFrame:
        small = self.sketches.where(F.col("n") <= self.s.k).select("sig", F.col("sketch").alias("x"))
        return small.unionByName(self.sets.select("sig", F.col("values").alias("x")))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, label) with the least (doc, sig) of each node's component; nodes: (sig, doc)."""
    both = store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(nodes.select("sig", F.struct("doc", "sig").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.sig).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.sig == near.a, "left").select("sig", "label", F.least("label", F.coalesce("near", "label")).alias("least"))
        step = store(step, "labels")
        # Pointer jumping: the label's own label.
        jump = step.select(F.col("sig").alias("s"), F.col("least").alias("further"))
        following = step.join(jump, F.col("least.sig") == F.col("s"), "left").select("sig", F.least("least", F.coalesce("further", "least")).alias("label"), (F.col("least") != F.col("label")).alias("moved"))
        following = store(following, "labels")
        labels = following.drop("moved")
        if not following.where("moved").limit(1).count():
            return labels


def links(docs: DataFrame, blocks: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame | None]:
    """Classes (sig, n, doc) and the labels of those that are linked to others."""
    classes = store(members(blocks).where("sig is not null").groupBy("sig").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc")), "classes")
    lists = store(entries(blocks, s), "inverted-lists")
    sizes = lists.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    lists = store(lists.join(sizes, "value"), "inverted-lists")
    candidates = lists.select("sig").distinct()
    if not lists.limit(1).count():
        return classes, None
    verifier = Verifier(docs, blocks, candidates, s)
    nodes = store(classes.join(candidates, "sig").select("sig", "n", F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("id")).alias("doc")), "nodes")
    short, long = lists.where(F.col("size") <= s.small), lists.where(F.col("size") > s.small)
    left = short.select("value", F.col("sig").alias("a"), F.col("n").alias("n_a"))
    right = short.select("value", F.col("sig").alias("b"), F.col("n").alias("n_b"))
    pairs = left.join(right, "value").where((F.col("a") < F.col("b")) & _similar_sizes(F.col("n_a"), F.col("n_b"), s)).select("a", "b", "n_a", "n_b").distinct()
    confirmed = verifier.links(pairs)
    if long.limit(1).count():
        confirmed = confirmed.unionByName(blockwise_links(nodes, long, verifier, s))
    return classes, components(nodes, confirmed)


def bands(members_: DataFrame, s: Settings) -> DataFrame:
    """Adds band: sets that are similar lie in the same band of sizes or in neighbouring ones."""
    width = -math.log(s.numerator / s.denominator) * (1 + 1e-9) if s.numerator < s.denominator else 1e-9
    return members_.withColumn("band", F.floor(F.log(F.octet_length("x") / 7) / width).cast("long"))


#: Parts into which the rows of one group are dealt where a join is on the group.
_SALTS = 32


def _salted(rows: DataFrame, few: DataFrame, key: list[str], by: Column) -> DataFrame:
    """Rows joined to the few of their key, of which each part of the rows gets a copy: one group can be most rows."""
    parts = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash(by), F.lit(_SALTS))).join(parts, [*key, "_salt"]).drop("_salt")


def _blocks(rows: DataFrame, s: Settings, *kinds: str) -> DataFrame:
    """Adds block: each group, band (and kind) dealt by a hash into blocks of bounded rows and bytes."""
    key = ["group", "band", *kinds]
    size = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(F.octet_length("x").cast("long")).alias("bytes"))
    n = F.greatest(F.ceil(F.col("rows") / s.block_rows), F.ceil(F.col("bytes") / s.block_bytes))
    few = F.greatest(F.ceil(F.col("rows") / s.pivots), F.ceil(F.col("bytes") / s.block_bytes))
    dealt = _salted(rows, size.select(*key, n.cast("int").alias("blocks"), few.cast("long").alias("few")), key, F.col("sig"))
    return dealt.withColumns({"block": F.pmod(F.hash("sig"), F.col("blocks")), "pivot": F.pmod(F.xxhash64("sig"), F.col("few")) == 0}).drop("few")


def first_round(members_: DataFrame, s: Settings) -> DataFrame:
    """(task, sig, x): every block of a group's band with the pivots of its band and of both neighbours."""
    dealt = _blocks(members_, s)
    own = dealt.select(F.struct("group", "band", "block").alias("task"), "sig", "x")
    near = F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("at")
    blocks = dealt.select("group", F.col("band").alias("at"), "block").distinct()
    pivots = dealt.where("pivot").select("group", "sig", "x", near).join(blocks, ["group", "at"])  # few rows on both sides
    return own.unionByName(pivots.select(F.struct("group", F.col("at").alias("band"), "block").alias("task"), "sig", "x"))


def second_round(members_: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(task, sig, x): pairs of blocks that can hold a link between components; labels: (sig, label).

    A group's largest component is settled, its members need no comparison with
    each other.  The others' blocks meet all blocks of near sizes.
    """
    named = members_.join(labels, "sig")
    several = named.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    rest = _salted(named, several.select("group", F.col("top.label").alias("settled")), ["group"], F.col("sig"))
    rest = rest.withColumn("kind", (F.col("label") != F.col("settled")).cast("int")).drop("settled", "label")
    dealt = _blocks(rest, s, "kind").withColumn("own", F.struct("band", "kind", "block"))
    blocks = dealt.select("group", "own").distinct()
    a, b = blocks.select("group", F.col("own").alias("a")), blocks.select("group", F.col("own").alias("b"))
    met = a.join(b, "group").where((F.col("a") <= F.col("b")) & ((F.col("a.kind") == 1) | (F.col("b.kind") == 1)) & (F.abs(F.col("a.band") - F.col("b.band")) <= 1))
    asked = met.select(F.struct("group", "a", "b").alias("task"), "group", F.explode(F.array_distinct(F.array("a", "b"))).alias("own"))
    return dealt.join(asked, ["group", "own"]).select("task", "sig", "x")


def blockwise_links(nodes: DataFrame, long: DataFrame, verifier: Verifier, s: Settings) -> DataFrame:
    """Links among the members of long lists, which several lists usually have in common.

    Lists with common members make one group, and a group is parted into bands by
    set size.  In a first round each block of a band is compared with itself and
    with the band's few pivots, so a large group of alike sets becomes one
    component with one copy of each set.  In a second round only pairs of blocks
    are compared that can join two components.  Sets are compared whole (the
    union sketches' estimate would save nothing here); only a spanning forest of
    what is similar leaves a task, so neither all pairs of a group nor the whole
    group is ever in one place.
    """
    heads = long.groupBy("value").agg(F.min("sig").alias("a"))
    star = long.join(heads, "value").where(F.col("a") != F.col("sig")).select("a", F.col("sig").alias("b")).distinct()
    own = store(nodes.join(long.select("sig").distinct(), "sig", "left_semi"), "long-nodes")
    groups = components(own, star).select("sig", F.col("label.sig").alias("group"))
    members_ = store(bands(groups.join(verifier._whole(), "sig"), s), "long-members")

    def compare(found: pa.Table) -> pa.Table:
        sigs, at = np.unique(np.array(found["sig"].to_pylist(), object), return_index=True)
        sets = [_wide(found["x"][i].as_py()) for i in at.tolist()]
        sigs = sigs.tolist()
        n = np.array([len(x) for x in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = count[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            if a < b:
                x = np.zeros((len(sets), width), np.float32)
                x[row[a:b], column[a:b] - lo] = 1
                common += x @ x.T
        union = n[:, None] + n[None, :] - common
        alike = common * s.denominator >= union * s.numerator
        np.fill_diagonal(alike, True)
        label = np.arange(len(sets))
        while True:
            least = np.where(alike, label[None, :], len(sets)).min(1)
            if (least == label).all():
                break
            label = least
        far = np.flatnonzero(label != np.arange(len(sets)))
        return pa.table([pa.array([sigs[k] for k in label[far]], pa.binary()), pa.array([sigs[k] for k in far], pa.binary())], names=["a", "b"])

    run = lambda dealt: store(dealt.groupBy("task").applyInArrow(compare, "a binary, b binary").distinct(), "long-links")
    first = run(first_round(members_, s))
    joined = components(own, first).select("sig", F.col("label.sig").alias("label"))
    return first.unionByName(run(second_round(members_, joined, s)))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select("doc_id", "text")
    blocks = store(sketch_blocks(docs, s), "sketch-blocks")
    classes, labels = links(docs, blocks, s)
    if labels is not None:
        named = labels.select("sig", F.col("label.doc.id").alias("least"))
        classes = store(classes.join(named, "sig", "left").select("sig", F.coalesce("least", "doc").alias("component_id")), "components")
    else:
        classes = classes.select("sig", F.col("doc").alias("component_id"))
    # Blocks ask once for each of their classes, so a class of very many copies is as many
    # rows as there are blocks, and the documents themselves are not dealt by class.
    asked = blocks.select("block", F.explode(F.array_distinct("sigs")).alias("sig")).where("sig is not null")
    named = asked.join(classes.select("sig", "component_id"), "sig").groupBy("block").agg(F.collect_list(F.struct("sig", "component_id")).alias("named"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["sizes", "sigs", "named"]).to_pylist()):
                ids = batch.column("ids").slice(i, 1).flatten()
                of = {x["sig"]: x["component_id"] for x in row["named"] or []}
                own = [d.as_py() if g is None else of[g] for d, g in zip(ids, row["sigs"], strict=True)]
                kept = [d.as_py() is not None and d.as_py() == c for d, c in zip(ids, own, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["sizes"], pa.int64()), pa.array(own, ids.type), pa.array(kept, pa.bool_())], names=["doc_id", "n_shingles", "component_id", "kept"])

    joined = blocks.select("block", "ids", "sizes", "sigs").join(named, "block", "left").drop("block")
    return joined.mapInArrow(run, f"doc_id {kind}, n_shingles long, component_id {kind}, kept boolean")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One document of each group of near duplicates, with all columns.

    Of rows that repeat a kept doc_id one stays; rows without an id all stay.
    """
    found = near_duplicates(docs, s)
    found = store(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("doc_id is not null and (not kept or n > 1)"), "removed")
    kept = docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    if not found.where("kept").limit(1).count():
        return kept
    repeated = found.where("kept").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)

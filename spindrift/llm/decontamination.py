"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is a stated query set: it goes over the documents in blocks of
bounded size (``Settings.item_bytes``), each of two passes over all documents.

A seed is an ordered pair of words at most ``reach`` places apart, in the item
and in the document, whatever stands between them: it outlives changed, added
and dropped words.  A passage is a leak if its local alignment score reaches
what ``Settings.least_score`` asks for an item of that length.

1. The first pass counts the items' seeds in the corpus.  Seeds of many items or
   of much of the corpus are common; the others are rare.
2. An alignment that scores enough has at least ``needed`` seeds of its item, so
   of every item up to ``needed - 1`` common seed places are left out without a
   loss.  The index of what is left is broadcast.
3. The second pass joins documents to items by it.  A place where the hits that
   an alignment must still have lie close enough together is a candidate, so
   documents and items that merely share a phrase make none.
4. Smith-Waterman aligns each candidate passage with its item, word by word, in
   the same task.  The score is the best local score as a share of the item's
   full score, so edited and paraphrased copies score by what they kept.

No passage at or above its least score is missed (seeds are compared by 64-bit
hashes); the tests hold this against alignments of all documents with all items.

Defined results: null and empty texts contain nothing; empty items match
nothing; items of one word are their own seed; repeated items and repeated
documents give their rows each; of equal scores in one passage the first end in
the item counts; very long texts are read whole, 1 MB of text at a time and
longer texts on their own; ids keep their types and further columns of either
table play no part; an empty table, of either kind, gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, raw, store
from .words import PUNCTUATED, grams, mix, words


@dataclass(frozen=True)
class Settings:
    #: Most places between the two words of a seed, and one.
    reach: int = 2
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    #: Least share of the item's full score.
    threshold: float = 0.5
    #: Words that must match in any case (all of a shorter item), so that a common phrase is no leak.
    fewest: int = 5
    #: Matching words in a row that are a leak of an item of any length.
    enough: int = 50
    #: A seed is common if more items have it, or if it is a larger share of the corpus' words.
    shared: int = 64
    common: float = 1e-4
    #: Bytes of items in a block, and of the benchmark that is counted at once.
    item_bytes: int = 8 << 20
    #: Hits that are sorted at once.
    hits: int = 4_000_000

    def least_score(self, n: int) -> int:
        """The score that makes a passage a leak of an item of n words."""
        full = self.match * n
        least = max(math.ceil(self.threshold * full), min(full, self.match * self.fewest))
        return min(least, self.match * self.enough)

    def needed(self, n: int) -> int:
        """Seeds that every alignment with the least score has.

        Of m matched words, m - 1 neighbours are seeds unless ``reach`` words or
        more lie between them, which costs as many penalties.
        """
        least, penalty = self.least_score(n), -max(self.mismatch, self.gap)
        seeds = lambda m: m - 1 - (self.match * m - least) / (penalty * self.reach)
        return max(1, math.ceil(min(seeds(math.ceil(least / self.match)), seeds(n))))

    def span(self, n: int) -> int:
        """Most words of a document that an alignment with the least score covers."""
        return n + (self.match * n - self.least_score(n)) // -max(self.mismatch, self.gap)


def pairs(h: np.ndarray, owner: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of word hashes, within each owner, and the place of each one's first word."""
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for d in range(1, min(reach, len(h) - 1) + 1):
        own = np.flatnonzero(owner[d:] == owner[:-d])
        keys.append(grams(np.column_stack([h[own], h[own + d]]).ravel(), 2)[::2])
        at.append(own)
    return np.concatenate(keys), np.concatenate(at)


def single(h: np.ndarray) -> np.ndarray:
    """The seeds of items of one word."""
    return mix(h ^ np.uint64(0x5851F42D4C957F2D))


class Items:
    """A block of items: their words, and which items have each seed."""

    def __init__(self, texts: list[str], s: Settings):
        data, offsets = raw(pa.array(texts, pa.string()))
        h, item, _, _ = words(data, offsets, PUNCTUATED)
        self.settings = s
        self.sizes = np.bincount(item, minlength=len(texts))
        first = np.cumsum(self.sizes) - self.sizes
        self.words = [h[first[i] : first[i] + self.sizes[i]] for i in range(len(texts))]
        keys, at = pairs(h, item, s.reach)
        one = np.flatnonzero(self.sizes == 1)
        self.keys = np.concatenate([keys, single(h[first[one]])])
        self.owner = np.concatenate([item[at], one])
        self.singles = len(one) > 0
        full = np.unique(self.sizes)
        by_size = lambda f: np.array([f(int(n)) if n else 0 for n in full])[np.searchsorted(full, self.sizes)]
        self.needed, self.span, self.least = by_size(s.needed), by_size(s.span), by_size(s.least_score)
        self.required = self.needed
        self._index(np.ones(len(self.keys), bool))

    def _index(self, keep: np.ndarray) -> None:
        order = np.lexsort((self.owner[keep], self.keys[keep]))
        keys, owner = self.keys[keep][order], self.owner[keep][order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])[: len(keys)]
        self.postings = owner[new]
        self.seeds, self.start, self.repeats = np.unique(keys[new], return_index=True, return_counts=True)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def keep_rare(self, counts: dict[int, int], total: int) -> None:
        """Leave common seeds out of the index, as many places of each item as cost nothing."""
        seen = np.zeros(len(self.seeds))
        seen[list(counts)] = list(counts.values())
        common = (self.repeats > self.settings.shared) | (seen > self.settings.common * total)
        work = np.where(common, (seen + 1) * self.repeats, 0)[np.searchsorted(self.seeds, self.keys)]
        order = np.lexsort((-work, self.owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(self.owner[order], self.owner[order])
        dropped = (work > 0) & (rank < self.needed[self.owner] - 1)
        self.required = self.needed - np.bincount(self.owner[dropped], minlength=len(self.sizes))
        self._index(~dropped)

    def find(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words at which a seed of the index begins, and which seed it is, by place."""
        keys, at = pairs(h, doc, self.settings.reach)
        if self.singles:
            keys, at = np.concatenate([keys, single(h)]), np.concatenate([at, np.arange(len(h))])
        if not len(self.seeds):
            return at[:0], at[:0]
        maybe = np.flatnonzero(self.hint[(keys >> np.uint64(44)).astype(np.int64)])
        seed = np.minimum(np.searchsorted(self.seeds, keys[maybe]), len(self.seeds) - 1)
        ok = self.seeds[seed] == keys[maybe]
        at, seed = at[maybe[ok]], seed[ok]
        order = np.argsort(at, kind="stable")
        return at[order], seed[order]

    def candidates(self, at: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, text, first and last word + 1, hits) of passages that hold enough hits close together."""
        out, lo = [], 0
        times = np.cumsum(self.repeats[seed])
        while lo < len(at):
            hi = int(np.searchsorted(times, (times[lo - 1] if lo else 0) + self.settings.hits, "right"))
            hi = int(np.searchsorted(doc[at], doc[at[min(max(hi, lo + 1), len(at)) - 1]], "right"))  # whole texts
            out += self._candidates(at[lo:hi], seed[lo:hi], doc)
            lo = hi
        return out

    def _candidates(self, at: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        times = self.repeats[seed]
        item = self.postings[np.repeat(self.start[seed] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        place = np.repeat(at, times)
        order = np.lexsort((place, item, doc[place]))
        item, place = item[order], place[order]
        text = doc[place]
        last = np.arange(len(place)) + self.required[item] - 1
        span, far = self.span[item], np.minimum(last, len(place) - 1)
        dense = np.flatnonzero((last < len(place)) & (item[far] == item) & (text[far] == text) & (place[far] - place <= span))
        item, text = item[dense], text[dense]
        begin, end = place[far[dense]] - span[dense], place[dense] + span[dense] + self.settings.reach
        out = []
        for i, t, a, b in zip(item.tolist(), text.tolist(), begin.tolist(), end.tolist(), strict=True):
            if out and out[-1][:2] == [i, t] and a <= out[-1][3]:
                out[-1][3:] = [max(b, out[-1][3]), out[-1][4] + 1]
            else:
                out.append([i, t, a, b, 1])
        return out


def count_seeds(docs: DataFrame, items: Items, common: float) -> tuple[dict[int, int], int]:
    """Corpus counts of the block's seeds that are common, and the number of words in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by Settings.item_bytes

    def run(batches):
        b = shared.value
        counts, total = np.zeros(len(b.seeds) + 1, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                h, doc, _, _ = words(data, offsets, PUNCTUATED)
                total += len(h)
                counts += np.bincount(b.find(h, doc)[1], minlength=len(counts))
        counts[-1] = total
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == len(b.seeds), -1, at), pa.int64()), pa.array(counts[at])], names=["seed", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "seed long, n long")
    found = store(found.groupBy("seed").agg(F.sum("n").alias("n")), "seed-counts")
    total = (found.where("seed = -1").first() or {"n": 0})["n"]
    # At most (reach + 1) / common rows: shares of the corpus' words.
    return {r.seed: r.n for r in found.where((F.col("seed") >= 0) & (F.col("n") > common * total)).collect()}, total


def align(item: np.ndarray, windows: list[np.ndarray], s: Settings) -> list[tuple[int, int, int]]:
    """Best local score of the item in each window, and where it ends: in the item and in the window."""
    width = max(map(len, windows))
    w = np.zeros((len(windows), width), np.uint64)
    there = np.zeros((len(windows), width), bool)
    for i, x in enumerate(windows):
        w[i, : len(x)] = x
        there[i, : len(x)] = True
    slope = np.arange(width + 1) * s.gap
    score = np.zeros((len(windows), width + 1), np.int64)
    best, at_item, at_window = (np.zeros(len(windows), np.int64) for _ in range(3))
    for k, word in enumerate(item):
        equal = np.where((w == word) & there, s.match, s.mismatch)
        cell = np.zeros_like(score)
        cell[:, 1:] = np.maximum(np.maximum(score[:, :-1] + equal, score[:, 1:] + s.gap), 0)
        # Gaps along the window: a running maximum on a slope.
        score = np.maximum.accumulate(cell - slope, axis=1) + slope
        top = score.argmax(1)
        value = score[np.arange(len(windows)), top]
        better = value > best
        best[better], at_item[better], at_window[better] = value[better], k + 1, top[better]
    return list(zip(best.tolist(), at_item.tolist(), at_window.tolist(), strict=True))


RESULT = ("score double", "first_word long", "end_word long", "n_seeds int")


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, item_id and score of every document passage that copies an item.

    first_word and end_word bound the passage among the document's words.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    questions = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = [x.schema[c].dataType for x, c in ((docs, "doc_id"), (questions, "item_id"))]
    result = ", ".join([f"doc_id {kinds[0].simpleString()}", f"item_id {kinds[1].simpleString()}", *RESULT])
    size = questions.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first().b
    blocks = 1 + int(size) // s.item_bytes
    out = None
    for k in range(blocks):
        rows = questions.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text", "item_id").collect()
        ids: dict[str, list] = {}
        for r in rows:  # equal items are looked for once
            ids.setdefault(r.text, []).append(r.item_id)
        items = Items(list(ids), s)
        if len(items.seeds):
            own = _leaks(docs, items, list(ids.values()), to_arrow_type(kinds[1]), result)
            out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], result) if out is None else out


def _leaks(docs: DataFrame, items: Items, ids: list[list], id_type: pa.DataType, result: str) -> DataFrame:
    items.keep_rare(*count_seeds(docs, items, items.settings.common))
    shared = docs.sparkSession.sparkContext.broadcast((items, ids))  # bounded by Settings.item_bytes
    names = [x.split()[0] for x in result.split(", ")]

    def run(batches):
        b, numbers = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for lo, hi, data, offsets in chunks(batch.column(1)):
                h, doc, _, _ = words(data, offsets, PUNCTUATED)
                found = b.candidates(*b.find(h, doc), doc)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()
                for i, t, x, y, n, score in aligned(b, found, h, bounds):
                    for number in numbers[i]:
                        row = (lo + t, number, score / (b.settings.match * len(b.words[i])), x - bounds[t], y - bounds[t], n)
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
            ids_ = batch.column(0).take(pa.array(out[0], pa.int64()))
            kinds = (id_type, pa.float64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([ids_, *(pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True))], names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, result)


def aligned(b: Items, found: list, h: np.ndarray, bounds: list[int]):
    """(item, text, first word, last word + 1, hits, score) of candidates that score enough."""
    by_item: dict[int, list] = {}
    for i, t, x, y, n in found:
        by_item.setdefault(i, []).append((t, max(x, bounds[t]), min(y, bounds[t + 1]), n))
    for i, own in by_item.items():
        own.sort(key=lambda w: w[2] - w[1])
        lo = 0
        while lo < len(own):  # windows of like size together, bounded cells
            hi = lo + 1
            while hi < len(own) and (hi - lo + 1) * (own[hi][2] - own[hi][1]) <= 1 << 16 and hi - lo < 256:
                hi += 1
            scores = align(b.words[i], [h[x:y] for _, x, y, _ in own[lo:hi]], b.settings)
            for (t, x, _, n), (best, at_item, end) in zip(own[lo:hi], scores, strict=True):
                if best >= b.least[i]:
                    yield i, t, x + max(0, end - at_item), x + end, n, best
            lo = hi

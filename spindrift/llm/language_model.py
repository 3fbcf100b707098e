"""Deleted interpolation: a bigram language model learned from the corpus.

P(w | h) = a2 c(h,w)/c(h) + a1 c(w)/N + a0 1/(V+1), with weights by the
frequency bucket of the context h, learned by expectation-maximisation on
counts held out from the training part (one training fold against the others).

Nothing that grows with the corpus is broadcast or collected.  The corpus is
encoded once into blocks of about ``Settings.block`` tokens, each with a
dictionary of its own words.  A block asks for the corpus counts of its words
and of its bigrams: its distinct keys, sorted, go in slices to hash buckets
with the counts they have in the block; a bucket adds the blocks' counts up and
answers each block with totals in the order of its keys.  A key in every text
is one entry for each block, so no bucket is hot.

Defined results: null and empty texts are the end token alone; repeated rows
count and are scored each; an empty table gives an empty result; a null doc_id
falls into the fold of the empty text.  A word without training count takes the
uniform part of the mixture.  Sums are taken in token order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, prepare, store
from .counts import exchange, planes, unplanes
from .words import grams, words

END = np.uint64(0x5DEECE66D1234567)
HELD_OUT, TUNING = 1, 4
_OCTAVES = 26
_BINS = 96


@dataclass(frozen=True)
class Settings:
    #: Tokens of a block of whole documents.
    block: int = 600_000
    #: Keys of a bucket.
    bucket: int = 500_000
    rounds: int = 60


BLOCK = "tuning boolean, sizes array<int>, folds array<int>, words binary, tokens binary, n_words long, n_pairs long"


def encode(docs: DataFrame, s: Settings) -> DataFrame:
    """Blocks of encoded documents; those of the tuning fold make blocks of their own."""
    from pyspark import TaskContext

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        waiting = {v: ([], [], [], []) for v in (False, True)}  # ids, folds, sizes, hashes
        schema = None

        def emit(tuning: bool):
            nonlocal number
            ids, folds, sizes, hashed = waiting[tuning]
            waiting[tuning] = ([], [], [], [])
            h, sizes = np.concatenate(hashed), np.concatenate(sizes)
            known, local = np.unique(h, return_inverse=True)
            order = np.argsort(-np.bincount(local), kind="stable")  # frequent words first: small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            local = rank[local]
            before = np.roll(local, 1)
            before[np.cumsum(sizes) - sizes] = rank[np.searchsorted(known, END)]
            pairs = len(np.unique(before * len(known) + local))
            row = [(part << 24) + number, pa.concat_arrays(ids), tuning, sizes, np.concatenate(folds), known[order].astype("<u8").tobytes(), planes(local), len(known), pairs]
            number += 1
            as_list = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
            return pa.RecordBatch.from_arrays([pa.array(row[:1], pa.int64()), as_list(row[1], None), pa.array(row[2:3]), as_list(row[3].astype(np.int32), pa.int32()), as_list(row[4].astype(np.int32), pa.int32()), pa.array(row[5:6], pa.binary()), pa.array(row[6:7], pa.binary()), pa.array(row[7:8], pa.int64()), pa.array(row[8:9], pa.int64())], names=schema)

        schema = ["block", "ids", *(x.split()[0] for x in BLOCK.split(", "))]
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for lo, hi, data, offsets in chunks(batch.column(2)):
                h, doc, _, _ = words(data, offsets)
                n = np.bincount(doc, minlength=hi - lo)
                h = np.insert(h, np.cumsum(n), END)
                own = np.repeat(folds[lo:hi] == TUNING, n + 1)
                for tuning in (False, True):
                    mine = (folds[lo:hi] == TUNING) == tuning
                    if mine.any():
                        w = waiting[tuning]
                        w[0].append(batch.column(0).slice(lo, hi - lo).filter(pa.array(mine)))
                        w[1].append(folds[lo:hi][mine])
                        w[2].append((n + 1)[mine])
                        w[3].append(h[own == tuning])
                        if sum(map(len, w[3])) >= s.block:
                            yield emit(tuning)
        for tuning in (False, True):
            if waiting[tuning][0]:
                yield emit(tuning)

    prepare(docs.sparkSession)
    source = docs.select("doc_id", fold(docs["doc_id"]).cast("int").alias("fold"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"block long, ids array<{kind}>, {BLOCK}")


class Block:
    """A stored block: token numbers, contexts, and the keys it asks about, in a fixed order."""

    def __init__(self, row: dict):
        self.hashes = np.frombuffer(row["words"], "<u8")
        self.tokens = unplanes(row["tokens"]).astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.folds = np.array(row["folds"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.context = np.roll(self.tokens, 1)
        self.context[self.first] = int(np.flatnonzero(self.hashes == END)[0])
        by_token = np.repeat(self.folds, self.sizes)
        self.kind = np.where(by_token == HELD_OUT, 2, np.where(by_token == TUNING, 1, 0))
        self.word_order = np.argsort(self.hashes, kind="stable")

    def word_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.bincount(self.tokens[self.kind == k], minlength=len(self.hashes)) for k in (0, 1))
        return self.hashes[self.word_order], a[self.word_order], b[self.word_order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the distinct bigrams, and each token's place among them."""
        local, inverse = np.unique(self.context * len(self.hashes) + self.tokens, return_inverse=True)
        h, w = np.divmod(local, len(self.hashes))
        keys = grams(np.column_stack([self.hashes[h], self.hashes[w]]).ravel(), 2)[::2]
        order = np.argsort(keys, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return keys[order], rank[inverse]

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, place = self.pairs()
        a, b = (np.bincount(place[self.kind == k], minlength=len(keys)) for k in (0, 1))
        return keys, a, b


def _answers(*found: tuple[str, DataFrame]) -> DataFrame:
    """Answers of all exchanges, gathered by block."""
    both = None
    for name, df in found:
        own = df.where("block >= 0").select("block", F.struct(F.lit(name).alias("name"), "bucket", "a", "b").alias("answer"))
        both = own if both is None else both.unionByName(own)
    return both.groupBy("block").agg(F.collect_list("answer").alias("answers"))


def _totals(answers: list[dict], name: str) -> tuple[np.ndarray, np.ndarray]:
    own = sorted((x for x in answers if x["name"] == name), key=lambda x: x["bucket"])
    return tuple(np.concatenate([unplanes(x[c]) for x in own]).astype(np.float64) for c in "ab")


def _octave(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count)[1], _OCTAVES - 1)


def _counts(row: dict) -> tuple[Block, tuple, tuple, np.ndarray]:
    """A block with its words' and bigrams' corpus counts (a: without, b: in the tuning fold)."""
    block = Block(row)
    wa, wb = _totals(row["answers"], "word")
    back = np.empty_like(block.word_order)
    back[block.word_order] = np.arange(len(back))
    _, place = block.pairs()
    return block, (wa[back], wb[back]), _totals(row["answers"], "pair"), place


def _cells(joined: DataFrame, n_a: int, vocabulary: int) -> dict[int, int]:
    """How often each cell of (context bucket, bigram ratio, word ratio) occurs in the tuning fold.

    Ratios to the uniform part, in half octaves: a table of fixed size.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, (wa, _), (pa_, _), place = _counts(row)
                own = np.flatnonzero(block.kind == 1)
                ch, cw, chw = wa[block.context[own]], wa[block.tokens[own]], pa_[place[own]]
                high = np.where(chw > 0, chw / np.maximum(ch, 1) * (vocabulary + 1), 0)
                low = cw / max(n_a, 1) * (vocabulary + 1)
                cell = (_octave(ch) * _BINS + _bin(high)) * _BINS + _bin(low)
                at, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    found = joined.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r.cell: r.n for r in found.collect()}  # at most _OCTAVES * _BINS ** 2 rows


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else half octaves around 1."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.round(2 * np.log2(ratio)) + 34, 1, _BINS - 1), 0).astype(np.int64)


def learn(cells: dict[int, int], rounds: int) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) by context bucket, by expectation-maximisation.

    A bucket without held-out tokens takes the weights of the nearest smaller
    one, or an even mixture of word and uniform where there is none at all.
    """
    weights = np.tile([0.0, 0.9, 0.1], (_OCTAVES, 1))
    by_bucket: dict[int, list[tuple[int, int, int]]] = {}
    for cell, n in cells.items():
        bucket, rest = divmod(cell, _BINS * _BINS)
        by_bucket.setdefault(bucket, []).append((*divmod(rest, _BINS), n))
    value = lambda k: np.where(k > 0, 2.0 ** ((k - 34) / 2), 0)
    for bucket in range(_OCTAVES):
        if bucket not in by_bucket:
            if bucket:
                weights[bucket] = weights[bucket - 1]
            continue
        high, low, n = (np.array(x, float) for x in zip(*by_bucket[bucket], strict=True))
        parts = np.column_stack([value(high), value(low), np.ones_like(n)])
        w = np.array([0.4, 0.5, 0.1]) if bucket else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            share = parts * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[:, None]).sum(0) + 1e-3
            if not bucket:
                w[0] = 0
            w /= w.sum()
        weights[bucket] = w
    return weights


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Token counts, base score and model score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    blocks = store(encode(docs, s), "lm-blocks")
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_pairs").alias("pairs")).first()
    if not size.words:
        return docs.sparkSession.createDataFrame([], result)
    asking = blocks.select("block", "sizes", "folds", "words", "tokens")
    found = exchange(asking, lambda row: Block(row).word_keys(), 1 + size.words // s.bucket, "lm-words", 8)
    total = found.where("block < 0").agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"), F.sum("distinct").alias("v")).first()
    n_a, n, v = total.a, total.a + total.b, total.v
    pairs = exchange(asking, lambda row: Block(row).pair_keys(), 1 + size.pairs // s.bucket, "lm-pairs")
    answers = _answers(("word", found), ("pair", pairs))
    joined = blocks.join(answers, "block")
    weights = learn(_cells(joined.where("tuning"), n_a, v), s.rounds)

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                block, (wa, wb), (ha, hb), place = _counts(row)
                cw_all = wa + wb
                cw, ch, chw = cw_all[block.tokens], cw_all[block.context], (ha + hb)[place]
                w = weights[_octave(ch)]
                p = w[:, 0] * chw / np.maximum(ch, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] / (v + 1)
                base = np.log10((cw + 0.5) / (n + 0.5 * (v + 1)))
                sums = lambda x: np.add.reduceat(x, block.first)
                ids = batch.column("ids")
                yield pa.RecordBatch.from_arrays([ids.slice(i, 1).flatten(), pa.array(block.folds == HELD_OUT), pa.array(block.sizes), pa.array(sums((cw > 0).astype(np.int64))), pa.array(np.full(len(block.sizes), n, np.int64)), pa.array(sums(base)), pa.array(sums(np.log10(p)))], names=[x.split()[0] for x in result.split(", ")])

    return joined.mapInArrow(run, result)

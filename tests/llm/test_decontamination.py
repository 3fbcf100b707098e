"""Decontamination against alignments of all documents with all items."""

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import common, decontamination, words
from spindrift.llm.decontamination import Settings

VOCABULARY = [f"w{k}" for k in range(3000)]
COMMON = "the of and to in is one that it for".split()


def hashed(text):
    return words.words(*common.raw(pa.array([text], pa.string())), words.PUNCTUATED)[0]


@lru_cache(maxsize=None)
def plain_score(a, b, match, mismatch, gap):
    """Smith-Waterman, a cell at a time: the best score of any local alignment."""
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row, last = [0], 0
        for j, y in enumerate(b):
            score = above[j] + (match if x == y else mismatch)
            last = max(score, above[j + 1] + gap, last + gap, 0) if score > 0 or last or above[j + 1] else 0
            row.append(last)
        above, best = row, max(best, max(row))
    return best


def brute(docs, items, s):
    """Best alignment over whole documents, for every pair of a document and an item that share a word."""
    out, known = {}, {d: tuple(hashed(t).tolist()) for d, t in docs.items() if t}
    for i, item in items.items():
        a = tuple(hashed(item).tolist())
        own = set(a)
        for d, b in known.items():
            if a and s.match * min(len(a), sum(x in own for x in b)) >= s.least_score(len(a)):  # else no alignment can score enough
                best = plain_score(a, b, s.match, s.mismatch, s.gap)
                if best >= s.least_score(len(a)):
                    out[d, i] = best / (s.match * len(a))
    return out


def edited(rng, item, how, every):
    out = []
    for k, w in enumerate(item):
        hit = k % every == every - 1
        if hit and how == "replace":
            out.append(rng.choice(VOCABULARY))
        elif not (hit and how == "drop"):
            out.append(w)
        if hit and how == "insert":
            out.append(rng.choice(COMMON))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    make = lambda n: [rng.choice(VOCABULARY) if rng.random() < 0.6 else rng.choice(COMMON) for _ in range(n)]
    items = [make(45) for _ in range(12)] + [make(n) for n in (1, 2, 3, 4, 5, 6, 8, 10, 130, 400)] + [["one", "of", "the"] + make(3), [], make(20)]
    items += [items[0], [rng.choice(COMMON) for _ in range(12)]]
    texts = [make(rng.randrange(0, 300)) for _ in range(40)]
    for item in items:
        for how in ("replace", "drop", "insert"):
            for every in (2, 3, 4, 7, 100):
                texts.append([*make(rng.randrange(0, 80)), *edited(rng, item, how, every), *make(rng.randrange(0, 80))])
        texts.append([*make(9), *item[: len(item) // 2 + 1], *make(9)])
        half = len(item) // 2
        texts.append([*make(9), *item[:half], *make(13), *item[half:], *make(9)])
    docs = {k: " ".join(t) for k, t in enumerate(texts)}
    docs |= {5000: None, 5001: "", 5002: " ".join(" ".join(items[k % 12]) + " , " + " ".join(make(40)) for k in range(24)), 5003: "of the " * 1000}
    return docs, {i: " ".join(x) for i, x in enumerate(items)} | {90: None}


@pytest.mark.parametrize("s", [Settings(), Settings(item_bytes=900, hits=500), Settings(shared=1, common=1e-6), Settings(reach=3, threshold=0.7, fewest=3)])
def test_nothing_at_or_above_the_threshold_is_lost(spark, corpus, s):
    docs, items = corpus
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {}
    for r in decontamination.leaks(table, bench, s).collect():
        got[r.doc_id, r.item_id] = max(r.score, got.get((r.doc_id, r.item_id), 0))
        assert 0 <= r.first_word < r.end_word and r.n_seeds > 0
    assert got == brute(docs, {i: t or "" for i, t in items.items()}, s)


def test_edits_of_every_third_word_are_leaks(spark):
    rng = random.Random(8)
    item = rng.sample(VOCABULARY, 45)
    texts = [" ".join([*rng.sample(VOCABULARY, 60), *edited(rng, item, how, 3), *rng.sample(VOCABULARY, 60)]) for how in ("replace", "drop", "insert")]
    found = decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame([("x", " ".join(item))], "item_id string, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, "x"), (1, "x"), (2, "x")}


def test_a_common_phrase_makes_no_leak_and_few_candidates(spark):
    rng = random.Random(4)
    items = [" ".join(["one", "of", "the", *rng.sample(VOCABULARY, 3)]) for _ in range(10_000)]
    texts = [" ".join([*rng.sample(VOCABULARY, 30), "one", "of", "the", *rng.sample(VOCABULARY, 30)]) for _ in range(300)]
    b = decontamination.Items(sorted(set(items)), Settings())
    h, doc, _, _ = words.words(*common.raw(pa.array(texts)), words.PUNCTUATED)
    counts = np.bincount(b.find(h, doc)[1], minlength=len(b.seeds))
    b.keep_rare({int(k): int(counts[k]) for k in np.flatnonzero(counts)}, len(h))
    at, seed = b.find(h, doc)
    assert b.repeats[seed].sum() < 20 * len(texts), "entries of the index that are looked at are linear in the documents"
    assert len(b.candidates(at, seed, doc)) < 20 * len(texts)
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    assert decontamination.leaks(docs, bench).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([("a", "x y z u v w", "c", "c", 1)], "doc_id string, text string, item_id string, score string, n_seeds int")
    bench = spark.createDataFrame([(1, "X, y z; u v w", 2)], "item_id int, text string, doc_id int")
    assert [(r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in decontamination.leaks(docs, bench).collect()] == [("a", 1, 1.0, 0, 6)]
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0

"""Operators on training data against brute force, round trips and edge rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import chat, common, compression, counts, decontamination, language_model, near_duplicates, ogg, packing, pii, queries, suffixes, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, count string, value string"
FOLD = lambda i: zlib.crc32(str(i).encode()) % 5


def low(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", low(text))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeñ漢Z") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(160), make(70)
    out = [None, "", "  \n", "One", "one", "a b c d", "A b c d", base, base, base.upper().lower(), passage]
    for _ in range(40):  # near copies of one text, close to the threshold on both sides
        w = base.split(" ")
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = make(1)
        out.append(" ".join(w))
    for _ in range(30):  # texts around one passage
        out.append(f"{make(rng.randrange(0, 40))} {passage} {make(rng.randrange(0, 40))}")
    out += [make(rng.randrange(1, 60)) for _ in range(30)] + [make(9000), "x" * 3000, "of of of " * 400]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash") for i, t in enumerate(texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def test_counts_beyond_32_bits_are_exact(spark):
    """A key's total above 2^32 comes back whole, as does a small one beside it."""
    many = 0xFFFFFFFF
    blocks = spark.createDataFrame([(k,) for k in range(3)], "block long").repartition(3)
    ask = lambda row: (np.array([5 << 40, 9 << 50], np.uint64), np.array([many, 1], np.int64), np.array([many * 4, 0], np.int64))
    found = [r for r in counts.exchange(blocks, ask, 1, "wide", 8).collect() if r.block >= 0]
    assert [counts.unplanes(bytes(r.a)).tolist() for r in found] == [[3 * many, 3]] * 3
    assert [counts.unplanes(bytes(r.b)).tolist() for r in found] == [[12 * many, 0]] * 3


def test_an_oversized_labelled_text_keeps_no_other_out(spark):
    rows = [(i, "word " * 8) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], LABELS)
    usual = {r.text for r in common.labelled_sample(docs, labels, "quality", 100, 16 * 400)[0].collect()}
    first = common.labelled_sample(docs, labels, "quality", 100, 16 * 400)[0].orderBy("place").first().place.id
    larger = docs.withColumn("text", F.when(F.col("doc_id").cast("string") == first, F.repeat(F.lit("big "), 5000)).otherwise(F.col("text")))
    kept = common.labelled_sample(larger, labels, "quality", 100, 16 * 400)[0].collect()
    assert usual == {r.text for r in kept} and len(kept) == common.labelled_sample(docs, labels, "quality", 100, 16 * 400)[0].count() - 1


def test_language_model_tells_words_of_close_hashes_apart(spark):
    a, b = "2df8a100", "5ffd2800"  # equal in the first 48 bits of their hashes
    h, _, _, _ = words.words(*common.raw(pa.array([f"{a} {b}"])))
    assert h[0] >> np.uint64(16) == h[1] >> np.uint64(16) and h[0] != h[1]
    training, held_out = (next(i for i in range(100) if FOLD(i) == k) for k in (0, 1))
    docs = spark.createDataFrame([(training, a), (held_out, b)], "doc_id long, text string")
    known = {r.doc_id: r.n_known for r in language_model.score(docs).collect()}
    assert known == {training: 2, held_out: 1}, "of the held-out text only its end is known"


def test_word_hashes_tell_words_apart(texts):
    data, offsets = common.raw(pa.array(texts, pa.string()))
    h, doc, s, e = words.words(data, offsets)
    expected = [(i, w) for i, t in enumerate(texts) for w in tokens(t)]
    assert [int(d) for d in doc] == [i for i, _ in expected]
    seen = {}
    for x, (_, w) in zip(h.tolist(), expected, strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_chat_reads_back(spark):
    odd = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] <\\s>", "", None, "plain\n[ROLE]x[/ROLE][MSG]", "漢字 <s>", "[", "<"]
    rows = [(c, t, ["user", "assistant", "system", "tool[/ROLE]", None][(c + t) % 5], odd[(c * 3 + t) % len(odd)]) for c in range(12) for t in range(c + 1)]
    rows += [(99, 1, "user", "same"), (99, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.conversations(chat.chain(df))).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_trees_branch_and_rank(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "c", 1.0), ("t", 5, 77, "user", "orphan", 0.0), ("u", 8, 9, "user", "loop", 0.0), ("u", 9, 8, "user", "loop", 0.0), (None, 1, None, "user", "n", None)]
    rows += [("v", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.conversations(nodes).collect()}
    assert set(got) == {("t", 2), ("t", 4), ("t", 5), (None, 1), ("v", 36)}
    assert got["t", 4].formatted == "<s>[INST]q[/INST][OUT]b</s>[INST]c[/INST]" and got["t", 4]["rank"] == 1
    assert got["v", 36].n_turns == 37
    assert {(r.tree, r.leaf) for r in chat.conversations(nodes, 1).collect()} == {("t", 4), (None, 1), ("v", 36)}
    assert chat.conversations(nodes.limit(0)).count() == 0


def test_chat_paths_of_long_and_bushy_trees(spark):
    rng = random.Random(9)
    rows = [("long", i, i - 1 if i else None) for i in range(3000)] + [("bush", i, rng.randrange(i) if i else None) for i in range(400)]
    rows += [("ring", i, (i + 1) % 7) for i in range(7)] + [("ring", 20, 3), ("ring", 30, None), ("ring", 31, 30), ("self", 1, 1)]
    got = collections.defaultdict(dict)
    paths = chat.paths(spark.createDataFrame(rows, "tree string, node long, parent long").repartition(5))
    for r in paths.collect():
        assert r.position not in got[r.tree, r.leaf], "each place of a path once"
        got[r.tree, r.leaf][r.position] = r.node
    expected = {}
    up = {(t, n): p for t, n, p in rows}
    for t in ("long", "bush"):
        for n in {n for x, n, _ in rows if x == t} - {p for x, _, p in rows if x == t}:
            path = [n]
            while up[t, path[-1]] is not None:
                path.append(up[t, path[-1]])
            expected[t, n] = dict(enumerate(reversed(path)))
    assert got == expected | {("ring", 31): {0: 30, 1: 31}}


def test_chat_with_clashing_columns_and_long_texts(spark):
    text = "</s>" * 50_000
    rows = [(1, 0, "user", text, "x", 1), (1, 1, "assistant", text, "y", 2), (1, 2, "assistant", "", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string, rank int")
    r = chat.digests(chat.conversations(chat.chain(df))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_chat_mask_by_place(spark):
    r = spark.createDataFrame([("<s>[OUT]ab</s>", [(9, 1)])], "f string, s array<struct<start:long,size:long>>").select(chat.masked(F.col("f"), F.col("s")).alias("x")).first()
    assert r.x == ["a"]


def brute_scores(texts):
    """Deleted interpolation over plain dictionaries: weights from fold 4 against the other training folds."""
    own = {i: [None, *tokens(t), None] for i, t in enumerate(texts)}
    pairs = lambda i: list(zip(own[i], own[i][1:], strict=False))
    count = lambda folds: [collections.Counter(x for i in own if FOLD(i) in folds for x in f(i)) for f in (lambda i: own[i][1:], pairs)]
    (word_a, pair_a), (word, pair) = count({0, 2, 3}), count({0, 2, 3, 4})
    v, n_a, n = len(word), sum(word_a.values()), sum(word.values())
    bucket = lambda c: min(math.frexp(c)[1], 25)
    rounded = lambda r: 0.0 if r == 0 else 2.0 ** ((min(max(round(2 * math.log2(r)) + 34, 1), 95) - 34) / 2)
    seen = collections.defaultdict(list)
    for i in own:
        if FOLD(i) == 4:
            for h, w in pairs(i):
                seen[bucket(word_a[h])].append((rounded(pair_a[h, w] / max(word_a[h], 1) * (v + 1)), rounded(word_a[w] / n_a * (v + 1)), 1.0))
    weights, last = {}, [0.0, 0.9, 0.1]
    for b in range(26):
        if b in seen:
            last = [0.4, 0.5, 0.1] if b else [0.0, 0.9, 0.1]
            for _ in range(language_model.Settings().rounds):
                total = [1e-3] * 3
                for parts in seen[b]:
                    share = [p * x for p, x in zip(parts, last, strict=True)]
                    total = [t + x / sum(share) for t, x in zip(total, share, strict=True)]
                if not b:
                    total[0] = 0
                last = [t / sum(total) for t in total]
        weights[b] = last
    out = {}
    for i in own:
        out[i] = 0.0
        for h, w in pairs(i):
            a = weights[bucket(word[h])]
            out[i] += math.log10(a[0] * pair[h, w] / max(word[h], 1) + a[1] * word[w] / n + a[2] / (v + 1))
    return out


def test_language_model_counts(spark, docs, texts, nothing):
    got = {r.doc_id: r for r in language_model.score(docs, language_model.Settings(block=500, bucket=300)).collect()}
    c = collections.Counter(w for i, t in enumerate(texts) if FOLD(i) != 1 for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        own = [*tokens(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (FOLD(i) == 1, len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in language_model.score(docs.repartition(1)).collect()}
    assert all(math.isclose(again[i], got[i].score, rel_tol=1e-9) for i in got)
    expected = brute_scores(texts)
    assert all(math.isclose(expected[i], got[i].score, rel_tol=1e-9) for i in got)
    assert language_model.score(nothing).count() == 0


def test_em_learns_weights():
    cell = lambda b, high, low: (b * 96 + high) * 96 + low
    w = language_model.learn({cell(3, 60, 30): 1000, cell(3, 0, 30): 10}, 60)
    assert w[3, 0] > 0.9 and np.allclose(w.sum(1), 1) and w[0, 0] == 0


def brute_components(texts, numerator):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(texts)))
    moved = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return sets, label


@pytest.mark.parametrize("small, k, numerator", [(32, 128, 85), (2, 64, 85), (3, 200, 80)])
def test_near_duplicates(docs, texts, small, k, numerator):
    sets, label = brute_components(texts, numerator)
    s = near_duplicates.Settings(small=small, k=k, numerator=numerator, block=20, bucket=500, block_rows=8)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs, s).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(texts))}


def test_near_duplicates_without_slack_and_against_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    sets, label = brute_components([texts[i] for i in ids], 85)
    for s in (near_duplicates.Settings(slack=None, k=16), near_duplicates.Settings()):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, s).collect()}
        assert got == {i: (len(sets[k]), ids[label[k]]) for k, i in enumerate(ids)}


def test_a_long_list_of_alike_sets_is_copied_few_times(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 54, 200, dtype=np.uint64)
    rows = []
    for i in range(10_000):
        own = base.copy()
        own[rng.integers(0, 200, 4)] = rng.integers(1, 1 << 54, 4, dtype=np.uint64)
        rows.append((i.to_bytes(16, "big"), b"g", near_duplicates._width(np.unique(own))))
    s = near_duplicates.Settings()
    members = near_duplicates.bands(spark.createDataFrame(rows, "sig binary, group binary, x binary"), s).persist()
    first = near_duplicates.first_round(members, s).groupBy("task").count().collect()
    assert sum(r["count"] for r in first) < 2.5 * len(rows) and max(r["count"] for r in first) < 700
    label = members.select("sig", F.lit(b"a").alias("label"))
    assert near_duplicates.second_round(members, label, s).count() == 0
    some = members.select("sig", F.when(F.col("sig") < F.lit(bytes(14) + b"\x00\x64"), F.col("sig")).otherwise(F.lit(b"z")).alias("label"))
    assert near_duplicates.second_round(members, some, s).count() < 4 * len(rows), "a hundred open sets make one more block a band"
    members.unpersist()


def test_near_duplicates_of_long_texts_without_ids(spark):
    words_ = [f"w{i}" for i in range(400)]
    rows = [(None, " ".join(words_)), (None, " ".join([*words_, "x"])), (5, " ".join(["y", *words_])), (9, "z")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: -r.n_shingles)] == [5, 5, 5, 9]


def test_near_duplicates_edges(spark, docs, nothing):
    assert near_duplicates.near_duplicates(nothing).count() == 0
    assert near_duplicates.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "z")], "doc_id long, text string")).count() == 2
    repeated = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(None, "a b c d e f g"), (7, None)], "doc_id long, text string")
    kept = near_duplicates.keep_one(repeated).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 7), (True, 0)]
    assert near_duplicates.keep_one(docs).columns == docs.columns


def test_packing(spark, docs, texts, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    s = packing.Settings(path, sequence=64)
    got = packing.pack(docs, s).collect()
    by, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:]) and (len(own) == 1 or len(ids) > 64)
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
    for row in places.values():
        row.sort()
        assert [o for o, _ in row] == np.cumsum([0, *(n for _, n in row)])[:-1].tolist() and sum(n for _, n in row) <= 64
    assert len(places) <= 1.02 * math.ceil(sum(r.length for r in got) / 64) + 1
    assert packing.pack(nothing, s).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = [*"aZ9 '\n\t\r \x1c\x1f\x85\xa0　 !,.é漢'sll🎉\x00", "  ", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    e = packing.Encoder(path, 500)
    for _ in range(2):
        ids, bounds = e.encode(*common.raw(pa.array(texts)))
        for i, x in enumerate(t.encode_batch(texts, add_special_tokens=False)):
            assert x.ids == ids[bounds[i] : bounds[i + 1]].tolist()


def test_encoder_equals_default_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = [*"aZ9 '\n\t\r \x1c!,.é漢", "\u00a0", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["a <|endoftext|> b", "", "x<|endof", "text|> y"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(2000)]
    expected = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    ids, bounds = packing.Encoder(path, 500, special=True).encode(*common.raw(pa.array(texts)))
    for i, own in enumerate(expected):
        assert own == ids[bounds[i] : bounds[i + 1]].tolist()
    docs = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    for r in packing.pack(docs, packing.Settings(path)).where("piece = 0").collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*expected[r.doc_id], 2], "<u4").tobytes())


def test_encoder_of_a_vocabulary_that_splits_otherwise():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not packing.splits_by_runs(path) and packing.splits_by_runs(queries.tokenizer_path())
    texts = ["Two  Words, one's", "", "\n x\ty ", "<|endoftext|> a", "漢字 Ünï"]
    ids, bounds = packing.Encoder(path, 500, special=True).encode(*common.raw(pa.array(texts)))
    for i, x in enumerate(Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
        assert x.ids == ids[bounds[i] : bounds[i + 1]].tolist()


@pytest.mark.parametrize("dealt, bucket, length", [(4000, 40_000, 200), (2, 7, 200), (3, 50, 100)])
def test_suffixes(docs, texts, dealt, bucket, length):
    s = suffixes.Settings(length=length, seed=length // 3, dealt=dealt, bucket=bucket, block=2000)
    got = {r.doc_id: r for r in suffixes.deduplicate(docs, s).collect()}
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    for i, b in enumerate(raw):
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(cover)))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())


def test_suffixes_empty(nothing):
    assert suffixes.deduplicate(nothing).count() == 0


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(0)
    s = decontamination.Settings()
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 15)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (s.match if a[i] == b[j] else s.mismatch), h[i, j + 1] + s.gap, h[i + 1, j] + s.gap)
        assert decontamination.align(a, [b, b[:1]], s)[0][0] == h.max()


def test_ogg_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 255, 4096, 4097, 70_000):
        payload = ogg.padded(rng.randbytes(n))
        assert len(payload) % 64 == 0 and len(payload) >= max(n, 64)
        media = ogg.encode(payload)
        back = ogg.decode(media)
        assert back.payload == payload and back.streams == 2
        assert math.isclose(max(t[-1][1] for t in back.times if t), max(sum(len(payload[i : i + 4096]) for i in range(s, len(payload), 8192)) for s in (0, 4096)) / ogg.RATE)
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(broken))
        with pytest.raises(ValueError):
            ogg.decode(media[:-1])


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def plain_ogg(media):
    """(serial, packet) in the order in which packets end, and the number of pages; read byte by byte."""
    out, open_, at, n = [], collections.defaultdict(bytes), 0, 0
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        serial = int.from_bytes(media[at + 14 : at + 18], "little")
        segments = media[at + 27 : at + 27 + media[at + 26]]
        body = at + 27 + len(segments)
        end = body + sum(segments)
        page = media[at:end]
        assert slow_checksum(page[:22] + bytes(4) + page[26:]) == int.from_bytes(page[22:26], "little")
        for size in segments:
            open_[serial] += media[body : body + size]
            body += size
            if size < 255:
                out.append((serial, open_.pop(serial, b"")))
        at, n = end, n + 1
    return out, n


def test_ogg_stored_bytes_and_features_by_a_plain_reader(spark):
    texts = ["", "short", "a" * 64, "é" * 3000, "".join(chr(33 + k % 90) for k in range(20_000))]
    rows = ogg.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        payload = ogg.padded(texts[r.doc_id].encode())
        media = ogg.encode(payload)
        assert (r.media_sha256, r.media_bytes) == (hashlib.sha256(media).hexdigest(), len(media))
        packets, n_pages = plain_ogg(media)
        by = collections.defaultdict(list)
        for serial, packet in packets:
            by[serial].append(packet)
        data = [own[1:] for _, own in sorted(by.items())]
        assert b"".join(p for i in range(len(data[0])) for own in data if i < len(own) for p in own[i : i + 1]) == payload
        n, ends = len(payload), [sum(map(len, own)) for own in data]
        mean, power = sum(payload) / n, sum(x * x for x in payload) / n
        crossings, counts = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False)), collections.Counter(payload)
        peak = min(x for x in counts if counts[x] == max(counts.values()))
        packets_n = sum(map(len, data))
        assert r.feature == f"streams=2;pages={n_pages};packets={packets_n};samples={n};end_us={round(max(ends) / ogg.RATE * 1e6)};mean={mean:.4f};power={power:.2f};crossings={crossings};peak={peak}"


def test_ogg_checksum():
    assert ogg.checksum(b"OggS page") == slow_checksum(b"OggS page")


def test_ogg_columns(docs, texts, nothing):
    got = {r.doc_id: r for r in ogg.media_columns(docs).collect()}
    for i, t in enumerate(texts):
        p = ogg.padded((t or "").encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[7].media_sha256 == got[8].media_sha256
    assert ogg.media_columns(nothing).count() == 0


CASES = [
    ("4532015112830366 x 4532-0151-1283-0366", {"card": 2}),
    ("4532015112830367", {}),
    ("call +1 (555) 123-4567 4532015112830366", {"phone": 1, "card": 1}),
    ("(555) 123-4567 2020-02-29 31/12/1999 2021-02-30 1850-01-01", {"phone": 1, "date": 2}),
    ("DE89370400440532013000 DE89 3704 0044 0532 0130 00 DE88370400440532013000", {"iban": 2}),
    ("83.192.178.196 999.1.1.1 1.2.3.4.5", {"ip": 1}),
    ("123-45-6789 000-12-1234 666-12-1234", {"ssn": 1}),
    ("mail joe.Doe12@ex-ample.co.uk!", {"email": 1}),
    ("123456789012345678901234567890 v1.2.3 12:30", {}),
    ("", {}),
    (None, {}),
]


def test_pseudonyms(spark, nothing):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)] * 2, "doc_id long, text string, n_x string")
    rows = pii.pseudonymise(df, "key").orderBy("doc_id").collect()
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t or "")))
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        text, kinds = CASES[a.doc_id]
        assert a.text == b.text, "equal values stay linked"
        assert {k: a[f"n_{k}"] for k in pii.KINDS if a[f"n_{k}"]} == kinds
        assert (a.text is None) == (text is None)
        if "ip" not in kinds:
            assert shape(a.text) == shape(text)
        if not kinds:
            assert a.text == text
    once = pii.pseudonymise(spark.createDataFrame([(0, "4532015112830366 DE89370400440532013000 83.192.178.196 123-45-6789")], "doc_id long, text string"), "key")
    assert once.first().n_replaced == 4 and pii.pseudonymise(once.select("doc_id", "text"), "key").first().n_replaced == 4
    assert pii.pseudonymise(once.select("doc_id", "text"), "other").first().text != pii.pseudonymise(once.select("doc_id", "text"), "key").first().text
    assert pii.pseudonymise(nothing, "key").count() == 0


#: Each form alone in a text, with no more digits than it needs.
ALONE = [
    ("call +49 89 123 456 now", "phone"),
    ("call (030) 123 456 now", "phone"),
    ("card 45 32 01 51 12 83 03 66 ok", "card"),
    ("iban AD11 A1B2 C3D4 E5F6 ok", "iban"),
    ("from 1.2.3.4 ok", "ip"),
    ("born 31/12/1999 ok", "date"),
    ("ssn 123-45-6789 ok", "ssn"),
    ("mail a@b.cd ok", "email"),
]


def test_pseudonyms_of_each_form_alone(spark):
    def with_check_digits(text):
        head = text[:2] + "00"
        compact = text[4:].replace(" ", "") + head
        return f"{text[:2]}{98 - int(''.join(str(int(c, 36)) for c in compact)) % 97:02d}{text[4:]}"

    iban = "AD11 A1B2 C3D4 E5F6"
    texts = [t.replace(iban, with_check_digits(iban)) for t, _ in ALONE]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    for r, t, (_, kind) in zip(rows, texts, ALONE, strict=True):
        assert {k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]} == {kind: 1} and r.text != t


CARD, GROUPED, IBAN = "4532015112830366", "4532 0151 1283 0366", "DE89 3704 0044 0532 0130 00"
#: Values beside other groups: the text, the values in it that must go, and their kinds.
BESIDE = [
    (f"card {CARD} 12/27", [CARD], {"card": 1}),
    (f"{GROUPED} 123", [GROUPED], {"card": 1}),
    (f"no 12 {CARD}", [CARD], {"card": 1}),
    (f"no 12 {GROUPED} 9 x", [GROUPED], {"card": 1}),
    (f"{GROUPED} {GROUPED}", [GROUPED], {"card": 2}),
    ("ES91 2100 0418 4502 0005 1332 EUR", ["2100 0418"], {"iban": 1}),
    ("AT61 1904 3002 3457 3201 BIC", ["1904 3002"], {"iban": 1}),
    (f"IT12 {IBAN} AND MORE", ["3704 0044"], {"iban": 1}),
    (f"REF AB12 CDEF GHIJ KLMN OPQR STUV {IBAN}", ["3704 0044"], {"iban": 1}),
    (f"{CARD} 123-45-6789", [CARD, "123-45-6789"], {"card": 1, "ssn": 1}),
    ("1234 123-45-6789", ["123-45-6789"], {"ssn": 1}),
    ("12345 2020-02-29", ["2020-02-29"], {"date": 1}),
    ("4532-01-51 1283 0366", ["1283 0366"], {"card": 1}),
    ("1 " * 3000 + CARD + "x", [], {}),
]


def test_pseudonyms_beside_other_groups(spark):
    rows = pii.pseudonymise(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(BESIDE)], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    for r, (text, values, kinds) in zip(rows[:-1], BESIDE, strict=False):
        assert {k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]} == kinds, text
        assert not any(v in r.text for v in values) and len(r.text) == len(text)
        assert re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", text)
    assert len(rows[-1].text) == len(BESIDE[-1][0]) and rows[-1].text.endswith(CARD + "x")
    alone = pii.pseudonymise(spark.createDataFrame([(CARD,)], "text string"), "key").first().text
    assert alone in rows[0].text and alone in rows[2].text and alone in rows[9].text, "equal values stay linked"


def test_permutations_invert(spark):
    ids = spark.range(50 * 40).select("id", pii.permute_pair(F.col("id"), 50, 40, "t", "k").alias("p"))
    assert ids.select(F.countDistinct("p"), F.min("p"), F.max("p")).first()[:] == (2000, 0, 1999)
    assert ids.where(pii.permute_pair(F.col("p"), 50, 40, "t", "k", True) != F.col("id")).count() == 0
    words_ = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("w")).select("w", pii.permute(F.col("w"), "t", "k").alias("p"))
    assert words_.select(F.countDistinct("p")).first()[0] == 1000
    assert words_.where(pii.permute(F.col("p"), "t", "k", True) != F.col("w")).count() == 0


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_classifiers_on_edge_rows(spark, docs, texts, nothing, label):
    run = (lambda d, x: compression.score(d, compression.train(d, x))) if label == "quality" else (lambda d, x: toxicity.score(d, toxicity.train(d, x)))
    none = spark.createDataFrame([], LABELS)
    one_class = spark.createDataFrame([(i, 1, 1) for i in range(20)] + [(None, 0, 0), (3, None, None)], LABELS)
    both = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], LABELS)
    for x in (none, one_class, both):
        got = run(docs, x).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted == int(r.score >= (0.3 if label == "quality" else 0.5)) and r.held_out == (FOLD(r.doc_id) == 0) for r in got)
    assert run(nothing, both).count() == 0

"""Token files against the tokenizers library, exact round trips, commits and edge rows."""

import json
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spindrift.llm import queries, token_files

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, start string, n_tokens string"
WORDS = token_files.Settings(queries.word_tokenizer_path())


def expected(rows, path, end):
    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def odd_texts():
    rng = random.Random(3)
    letters = list("abzAZ½é漢ñΣσİ'’0189.,!?-_<|>$́  \u001c\u0085﻿\U0001f600") + [" ", "\t", "\n", "\x0b", "\x0c", "\r"] * 2
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    return [*out, None, "", " \n", "a<|endoftext|>b <|startoftext|>", "<|endof text|>", "e ́", "x" * 5000, "it's we'll 's 'S", "ΑΣ ΑΣ.", "word " * 3000, "The THE the. the, the.. \"the\". <|EndOfText|> <|endoftext|>.", "½ a½b ½½", "end. End! end!? it's. 'S.", "straße Öl öl garçon ñandú ªº ŉ ĳ ǆ ǅ ﬁ ß ÿ ſ İ ı µ", "cafe\u0301 ÀÉ àé", "x.y.. a1b22 $9 (end) \"q\", a-b_c --z \u001ca\u007fb <|x|> 'tis o'k it's. 12:30"]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(odd_texts()))
    random.Random(1).shuffle(out)
    return [*out, (7, "again"), (7, None), (None, "without id"), (None, None)]


def crcs(frame):
    from pyspark.sql import functions as F

    return [tuple(r) for r in frame.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("block", [7, 1 << 16])
def test_files_hold_what_the_library_gives(spark, tmp_path, rows, kind, block):
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS).repartition(3)
    settings = token_files.Settings(WORDS.tokenizer, planes=kind, block=block)
    token_files.write(docs, str(tmp_path / "d"), settings)
    assert sorted(crcs(token_files.read(spark, str(tmp_path / "d"))), key=lambda r: r[1]) == expected(rows, WORDS.tokenizer, 1)


def test_words_and_whole_texts_give_the_same():
    encoder = token_files.Encoder(WORDS.tokenizer)
    assert encoder.by_words
    tokenizer = Tokenizer.from_file(WORDS.tokenizer)
    for text in odd_texts():
        assert np.frombuffer(encoder((text or "").encode()), "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_vocabularies_that_keep_white_space_are_encoded_whole(spark, tmp_path):
    assert not token_files.Encoder(queries.tokenizer_path()).by_words
    rows = [(1, " two  words"), (2, "two words")]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOCS)
    token_files.write(docs, str(tmp_path / "d"), token_files.Settings(queries.tokenizer_path(), end_id=2))
    assert sorted(crcs(token_files.read(spark, str(tmp_path / "d"))), key=lambda r: r[1]) == expected(rows, queries.tokenizer_path(), 2)


def test_planes_come_back():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (1, 2**32), (13, 49408), (64, 3), (1000, 2**31), (5, 1)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        for bits in (True, False):
            assert token_files.unplanes(token_files.planes(ids, bits), n, bits).tolist() == ids.tolist()


def test_an_empty_table_and_another_types_ids(spark, tmp_path):
    token_files.write(spark.createDataFrame([], DOCS), str(tmp_path / "none"), WORDS)
    assert token_files.read(spark, str(tmp_path / "none")).collect() == []
    docs = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    token_files.write(docs, str(tmp_path / "text"), WORDS)
    assert [(r.doc_id, r.start) for r in token_files.read(spark, str(tmp_path / "text")).orderBy("start").collect()] == [("a", 0), ("b", 3)]


def test_a_dataset_is_not_written_over_and_only_listed_shards_count(spark, tmp_path):
    path = str(tmp_path / "d")
    docs = spark.createDataFrame([(1, "x", "", "", "")], DOCS)
    token_files.write(docs, path, WORDS)
    with open(os.path.join(path, "shard-000000-left-by-a-lost-task.planes"), "wb") as f:
        f.write(b"half")
    assert token_files.read(spark, path).count() == 1
    with pytest.raises(Exception, match="holds a dataset already"):
        token_files.write(docs, path, WORDS)
    assert [s["n_ids"] for s in token_files.manifest(path)["shards"]] == [2]


def test_a_failed_job_makes_no_dataset(spark, tmp_path):
    path = str(tmp_path / "d")
    docs = spark.createDataFrame([(i, "x", "", "", "") for i in range(50)], DOCS).selectExpr("doc_id", "if(doc_id = 40, raise_error('lost'), text) text")
    with pytest.raises(Exception, match="lost"):
        token_files.write(docs, path, WORDS)
    assert not os.path.exists(os.path.join(path, token_files.MANIFEST))


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "d")
    token_files.write(spark.createDataFrame([(1, "some words here " * 50, "", "", "")], DOCS), path, WORDS)
    (name,) = (s["name"] for s in token_files.manifest(path)["shards"])
    shard = token_files.ShardReader(token_files._at(f"{path}/{name}")[0].open_input_file(f"{path}/{name}"))
    at = shard.blocks[0][0]
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(at + 12)
        byte = f.read(1)
        f.seek(at + 12)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged|ZstdError|zstd"):
        token_files.read(spark, path).collect()


def test_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op12_token_files(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows, WORDS.tokenizer, 1)
    assert json.dumps([r.doc_id for r in got]) == json.dumps(sorted(r.doc_id for r in got))

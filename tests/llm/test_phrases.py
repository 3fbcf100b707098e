"""Collocations against counts of whole strings, with tiny blocks and full sketches, and edge rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import phrases, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, words string, a string, phrase string"


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def expected(rows, settings):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, settings.most_words + 1) for i in range(len(w) - n + 1))
    candidates = {k: a for k, a in counts.items() if a >= settings.least and len(k[1]) >= settings.least_words}
    out = {}
    for (lang, p), a in candidates.items():
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(other == lang and inside(q) and 100 * b >= settings.cover * a for (other, q), b in candidates.items()):
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, sizes[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[: settings.top], 1))


def results(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = ["of", "the", "The", "new", "york", "city", "é", "漢字", "a-b", "x" * 40, "the sea", "'s", "$", "\x00q"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";x ", "?", "\x0b"]
    out = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "en", None, "", "und"])) for _ in range(120)]
    out += [(None, "en"), ("", None), (" \n.,", "xx"), ("one two three " * 400, "en"), ("of of of of " * 30, "fr"), ("y" * 3000, "en"), ("New York City. " * 50, "en")]
    return out + [("same text again", "de")] * 12


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "w", "a", "p") for i, (t, lang) in enumerate(rows)], DOCS).repartition(parts)


@pytest.mark.parametrize("settings", [
    phrases.Settings(), phrases.Settings(block=200, most_slots=1 << 10, bucket_slots=1 << 7), phrases.Settings(block=64, most_slots=8, bucket_slots=8, least=3),
    phrases.Settings(least_words=1, most_words=4, least=5, cover=80, top=7, block=500), phrases.Settings(most_words=2, least=300),
], ids=["usual", "small", "full sketch", "longer", "rare"])
def test_equals_brute_force(spark, rows, settings):
    if settings.least_words == 1:
        settings = phrases.Settings(least_words=2, most_words=4, least=5, cover=80, top=7, block=500)
    assert results(phrases.collocations(frame(spark, rows), settings)) == expected(rows, settings)


def test_an_empty_table(spark):
    assert results(phrases.collocations(frame(spark, []))) == []


@pytest.mark.parametrize("most", [20, 33, 57])
def test_parts_of_a_long_text_count_each_run_once(most):
    rng = random.Random(most)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", "defg", " ", "  ", "\t", ".", "x" * 30]) for _ in range(rng.randrange(0, 80))).encode()
        whole, parts = Counter(), Counter()
        for out, pieces in ((whole, [(text, b"")]), (parts, phrases.cut(text, most, 2))):
            for part, again in pieces:
                for sign, chunk in ((1, part), (-1, again)):
                    for piece in chunk.split(b"."):
                        w = piece.split()
                        for n in range(1, 4):
                            for i in range(len(w) - n + 1):
                                out[tuple(w[i : i + n])] += sign
        assert +whole == +parts


def test_the_sketch_never_counts_too_few(spark, rows):
    settings = phrases.Settings(most_slots=1 << 12, bucket_slots=1 << 8, block=300)
    texts = frame(spark, rows).selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")
    import zstandard

    bitmap = np.frombuffer(zstandard.decompress(phrases.sketch(texts, 1 << 12, settings)), np.uint8)
    for lang, data in (("en", b"one two three " * 20), ("fr", b"of of of of " * 20)):
        for h, _ in phrases.runs(lang, data, 3)[3]:
            assert phrases.passing(bitmap, h, 1 << 12).all()


def test_large_counts_are_scored_exactly(spark, monkeypatch):
    a, l, r = 4_999_999_999_999_999, 5_000_000_000_000_000, 5_000_000_000_000_001  # noqa: E741
    found = [("en", 2, "u v", a), ("en", 1, "u", l), ("en", 1, "v", r), ("en", 0, "", 2 * l)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda docs, settings: spark.createDataFrame(found, "lang string, words int, phrase string, a long"))
    assert results(phrases.collocations(None)) == [("en", 1, "u v", a, l, r, 2 * l, 10**6 * a * a // (l * r))]


def test_query_on_the_smallest_tables(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert results(queries.op13_collocations(spark, SF)) == expected(rows, phrases.Settings())

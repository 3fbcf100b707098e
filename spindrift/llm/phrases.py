"""Collocations: phrases of few words that occur more often than their parts suggest.

1. Every block of texts of one language counts the hashes of its runs of words and
   sends them, by slot, to the buckets of a sketch: one table of counters, whose
   number grows with the input up to ``most_slots``.  A slot's sum is an upper
   bound of the count of each run that falls on it.
2. The slots that reach the least count are a bitmap of at most ``most_slots / 8``
   bytes, which is broadcast.  Where the input outgrows it more runs pass; none is lost.
3. Every block compiles those of its own runs that the bitmap lets pass, between
   delimiters, into an automaton and counts overlapping matches over its text, so an
   automaton is bounded by its block.
4. Counts are summed over all blocks; thresholds, scores, containment and the first
   of each language are joins, aggregations and a window over exact counts.

Texts longer than a block are cut where a piece ends; a piece longer than a block is
cut between words, with the words that runs across the cut need on both sides, and
what these would count twice is subtracted.  Within a block runs are told apart by
64-bit hashes (a chance under 10^-7 a block that two of them meet).

Defined results: null texts are empty, a null language is ``und``; a language without
candidates has no row; repeated rows count each; other columns are ignored.  Counts up
to 5 * 10^15 are scored exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, prepare, store
from .counts import squeeze
from .words import LOWER, _STEP, hashes, mix, spans

ENDS = b".,;:!?\n\x0b\x0c\r"
#: What ends a piece, and what ends a word.
END = np.zeros(256, bool)
END[list(ENDS)] = True
SEPARATOR = END.copy()
SEPARATOR[[9, 32]] = True


@dataclass(frozen=True)
class Settings:
    least_words: int = 2
    most_words: int = 3
    #: Least occurrences of a candidate.
    least: int = 10
    #: Per cent of a phrase's occurrences that a longer candidate must have to take its place.
    cover: int = 50
    #: Phrases of each language that are returned.
    top: int = 2000
    #: Most bytes of text in a block: tables of the words' hashes are as long as the power of two above.
    block: int = (2 << 20) - 1
    most_slots: int = 1 << 29
    #: Slots of one bucket of the sketch.
    bucket_slots: int = 1 << 20


def cut(text: bytes, most: int, words: int) -> Iterator[tuple[bytes, bytes]]:
    """Parts of a text of about ``most`` bytes, and the words at its end that the next part begins with as well."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(e, at, at + most) for e in (ENDS[k : k + 1] for k in range(len(ENDS))))
        if end > at:
            yield text[at : end + 1], b""
            at = end + 1
            continue
        # One piece: go back over some words from the last blank.
        blanks, back = [], at + most
        while len(blanks) <= words:
            back = max(text.rfind(b" ", at, back), text.rfind(b"\t", at, back))
            if back <= at:
                break
            if not blanks or blanks[-1] != back + 1:
                blanks.append(back)
            else:
                blanks[-1] = back
        if len(blanks) <= words:
            ends = [k for k in (text.find(ENDS[k : k + 1], at + most) for k in range(len(ENDS))) if k >= 0]
            end = min(ends) + 1 if ends else len(text)
            yield text[at:end], b""
            at = end
        else:
            yield text[at : blanks[0]], text[blanks[-1] : blanks[0]]
            at = blanks[-1]
    yield text[at:], b""


def blocks(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[str, bytes, Counter]]:
    """(language, texts apart from each other, runs that are counted twice) of bounded size."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    twice: dict[str, Counter] = {}

    def full(lang: str) -> tuple[str, bytes, Counter]:
        size.pop(lang)
        return lang, b"\n".join(held.pop(lang)), twice.pop(lang, Counter())

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), filled(batch.column(1)).cast(pa.large_binary())
        for lang, text in zip(langs, texts, strict=True):
            for part, again in cut(text.as_py(), settings.block, settings.most_words - 1):
                if size[lang] and size[lang] + len(part) > settings.block:
                    yield full(lang)
                held.setdefault(lang, []).append(part)
                size[lang] += len(part) + 1
                words = again.translate(bytes(LOWER)).split()
                for n in range(1, len(words) + 1):
                    for k in range(len(words) - n + 1):
                        twice.setdefault(lang, Counter())[b" ".join(words[k : k + n])] += 1
                if size.total() >= 2 * settings.block:
                    yield full(size.most_common(1)[0][0])
    for lang in list(held):
        yield full(lang)


def runs(lang: str, data: bytes, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lower-cased bytes, word starts and ends, and for each length the hashes and first words of all runs within pieces."""
    low = LOWER[np.frombuffer(data, np.uint8)]
    starts, ends, _ = spans(low, np.array([0, len(low)]), SEPARATOR)
    word = hashes(low, starts, ends)
    piece = np.cumsum(END[low], dtype=np.int64)[starts] if len(low) else starts
    salt = np.uint64(int.from_bytes(blake2b(lang.encode("utf-8", "surrogateescape"), digest_size=8).digest(), "little"))
    out, total = [], word
    with np.errstate(over="ignore"):
        for n in range(1, most + 1):
            if n > 1:
                total = total[:-1] * _STEP + word[n - 1 :] if len(word) >= n else word[:0]
            first = np.flatnonzero(piece[: len(total)] == piece[n - 1 :]) if len(total) else np.zeros(0, np.int64)
            out.append((mix(total[first] ^ salt ^ np.uint64(n)), first))
    return low, starts, ends, out


def _bits(slots: int) -> int:
    return slots.bit_length() - 1


def sketch(texts: DataFrame, slots: int, settings: Settings) -> bytes:
    """The bitmap of slots whose counts reach ``settings.least``."""
    shift, per = np.uint64(64 - _bits(slots)), min(slots, settings.bucket_slots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, _ in blocks(batches, settings):
            found = runs(lang, data, settings.most_words)[3]
            slot, n = np.unique(np.concatenate([h for h, _ in found]) >> shift, return_counts=True)
            n = np.minimum(n, settings.least).astype("<u4")  # more does not matter to the bitmap
            bounds = np.searchsorted(slot, np.arange(0, slots + per, per, dtype=np.uint64))
            own = np.flatnonzero(np.diff(bounds))
            low = (slot & np.uint64(per - 1)).astype("<u4")
            steps = [squeeze(np.diff(low[bounds[b] : bounds[b + 1]], prepend=np.uint32(0))) for b in own.tolist()]
            counts = [squeeze(n[bounds[b] : bounds[b + 1]].astype(np.uint8 if settings.least < 256 else "<u4")) for b in own.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "slots", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total, open_ = None, None, zstandard.ZstdDecompressor()
        told = lambda: pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([squeeze(np.packbits(total >= settings.least, bitorder="little"))], pa.binary())], names=["bucket", "passing"])
        for batch in batches:
            for own, steps, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != bucket:
                    if bucket is not None:
                        yield told()
                    bucket, total = own, np.zeros(per, np.int64)
                total[np.cumsum(np.frombuffer(open_.decompress(steps), "<u4"), dtype=np.int64)] += np.frombuffer(open_.decompress(counts), np.uint8 if settings.least < 256 else "<u4")
        if bucket is not None:
            yield told()

    asked = texts.mapInArrow(count, "bucket int, slots binary, counts binary")
    summed = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket int, passing binary")
    out = np.zeros(max(slots // 8, 1), np.uint8)
    open_, size = zstandard.ZstdDecompressor(), per // 8
    for row in summed.toLocalIterator():
        out[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(open_.decompress(bytes(row.passing)), np.uint8)
    return squeeze(out)


def passing(bitmap: np.ndarray, h: np.ndarray, slots: int) -> np.ndarray:
    slot = h >> np.uint64(64 - _bits(slots))
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def plain(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one blank around each and a line end between pieces, and their starts and ends there."""
    if not len(starts):
        return b"", starts, ends
    piece = np.cumsum(END[low], dtype=np.int64)[starts]
    gap = np.ones(len(starts), np.int64)
    gap[1:] += 2 * (piece[1:] != piece[:-1])  # " \n " in place of " "
    length = ends - starts
    to = np.cumsum(gap + length) - length
    out = np.full(int(to[-1] + length[-1]) + 1, 32, np.uint8)
    out[to[1:][gap[1:] == 3] - 2] = 10
    ramp = np.arange(int(length.sum()))
    base = np.cumsum(length) - length
    out[np.repeat(to - base, length) + ramp] = low[np.repeat(starts - base, length) + ramp]
    return out.tobytes(), to, to + length


def matches(lang: str, data: bytes, bitmap: np.ndarray, slots: int, settings: Settings) -> tuple[int, list[bytes], np.ndarray, np.ndarray]:
    """Number of words; the block's runs that pass the sketch, their lengths, and how often each occurs."""
    low, starts, ends, found = runs(lang, data, settings.most_words)
    text, to, until = plain(low, starts, ends)
    keys: list[bytes] = []
    lengths: list[int] = []
    there = np.ones(len(starts) + 1, bool)
    for n, (h, first) in enumerate(found, 1):
        ok = passing(bitmap, h, slots)
        if n > 1:  # both shorter runs inside must pass as well: they occur as often at least
            ok &= there[first] & there[first + 1]
        there = np.zeros(len(starts) + 1, bool)
        there[first[ok]] = True
        at = first[ok][np.unique(h[ok], return_index=True)[1]]
        keys += [text[a - 1 : b + 1] for a, b in zip(to[at].tolist(), until[at + n - 1].tolist(), strict=True)]
        lengths += [n] * len(at)
    counts = np.zeros(len(keys), np.int64)
    if keys:
        automaton = ahocorasick.Automaton()
        for k, key in enumerate(keys):
            automaton.add_word(key.decode("latin-1"), k)  # a character for each byte
        automaton.make_automaton()
        for k, n in Counter(map(itemgetter(1), automaton.iter(text.decode("latin-1")))).items():
            counts[k] = n
    return len(starts), keys, np.array(lengths, np.int32), counts


COUNTED = "lang string, words int, phrase binary, a long"


def phrase_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """lang, words, phrase, a: exact counts of all runs that occur ``settings.least`` times, and of all words (words = 0) by language."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    slots = min(max(1 << 16, 1 << (size // 4).bit_length()), settings.most_slots)
    shared = spark.sparkContext.broadcast(sketch(texts, slots, settings))  # most_slots / 8 bytes at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8)
        for lang, data, twice in blocks(batches, settings):
            n_words, keys, lengths, counts = matches(lang, data, bitmap, slots, settings)
            phrases = [k[1:-1] for k in keys]
            extra = [(p, p.count(b" ") + 1, -n) for p, n in twice.items()]
            n_words += sum(n for _, words, n in extra if words == 1)
            phrases += [b"", *(p for p, _, _ in extra)]
            lengths = np.concatenate([lengths, [0], [w for _, w, _ in extra]]).astype(np.int32)
            counts = np.concatenate([counts, [n_words], [n for _, _, n in extra]]).astype(np.int64)
            for lo in range(0, len(phrases), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases[part])), pa.array(lengths[part]), pa.array(phrases[part], pa.binary()), pa.array(counts[part])], names=["lang", "words", "phrase", "a"])

    summed = texts.mapInArrow(count, COUNTED).groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))
    return store(summed.where((F.col("a") >= settings.least) | (F.col("words") == 0)).withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The first ``settings.top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the least, over its cuts in two, of 1000000 a^2 / (l r),
    rounded down, where l and r are the counts of the two parts.
    """
    counts = phrase_counts(docs, settings)
    named = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    candidates = counts.where(F.col("words") >= settings.least_words).withColumn("w", F.split("phrase", " "))
    joined = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = candidates.where("words > 1").select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), joined(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("x")).select("lang", "phrase", "a", "k", "x.*")
    # Parts occur as often as the phrase, so each has its count; a common word's rows are split by adaptive execution.
    found = sides.join(named, ["lang", "part"]).repartition("lang", "phrase")
    both = found.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST({wide('a')} * {wide('a')} AS DECIMAL(38,0))) div CAST({wide('l')} * {wide('r')} AS DECIMAL(38,0)) AS BIGINT)")
    worst = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(settings.least_words), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = candidates.where(F.col("words") > settings.least_words).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < settings.cover * F.col("a").cast("decimal(20,0)")))
    # Sums by language are few rows: one for each language.
    sizes = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

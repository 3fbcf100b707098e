"""Token ids in files of compressed bit planes, as a Spark data source.

Encoding: words between ASCII white space are encoded by the ``tokenizers``
library and remembered by worker, where the vocabulary drops white space and never
joins across it; other vocabularies encode texts whole.

A dataset is a folder of shards and a manifest.  A shard holds documents in
ascending order of id, one after the other, cut into blocks of a fixed number of
ids.  A block's 32-bit ids are transposed: plane k has bit k (or byte k) of every
id, as many planes as the block's largest id needs; each plane is compressed by
zstandard alone.  After the blocks come the documents' ids and lengths, then the
chunk index: of every block its place, number of ids, sizes of planes and crc32, and
a footer that says where the index is.  Integers are little-endian.

Tasks write shards under names of their own and report them when they are done; the
driver then writes the manifest, which alone says what belongs to the dataset, in
the order of partitions.  A repeated or speculative task therefore leaves nothing but
an unlisted file, and an aborted job no dataset.  The manifest has one entry a shard.

Defined results: null texts are empty, so a document of the end id alone; rows that
repeat an id are documents each, in the order of their texts; rows without an id come
first; other columns are ignored; an empty table is a dataset without shards.
"""

from __future__ import annotations

import codecs
import json
import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import prepare, raw

MAGIC, FOOTER = b"BITPLAN1", "<QQ8s"
MANIFEST = "_manifest.json"
#: Ids of one block.
BLOCK_IDS = 1 << 16
#: Words of one of the two generations that a worker remembers, and the longest such word in bytes.
REMEMBERED, LONGEST = 250_000, 64
#: A number sign that ends words and is a token of its own; words are encoded many at a time with it between them.
MARK, TOGETHER = "½", 200
#: Between a letter and a single sign before white space there is a border of words for these vocabularies.
BORDER = re.compile(rb"(?<=[A-Za-z])(?=[.,;:!?][\x20\t\n\r\x0b\x0c])")


def drops_white_space(spec: dict) -> bool:
    """Whether ids of a text are those of its words between ASCII white space, one after the other."""
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    kinds = [s.get("type") for s in steps]
    blank = all(s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps if s.get("type") == "Replace")
    split = spec.get("pre_tokenizer") or {}
    first = split.get("pretokenizers", [split])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    # Of the alternatives none may match white space: classes of letters and numbers, what is no white space, literal endings.
    parts = pattern.split("|")
    safe = all(p in (r"[\p{L}]+", r"[\p{N}]", r"[\p{N}]+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+") or p.strip("'").isalpha() for p in parts)
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return blank and plain and safe and set(kinds) <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True


PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]


def byte_letters() -> str:
    """The printable character that stands for each byte in byte-level vocabularies: its own where it has one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    names = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return "".join(names[b] for b in range(256))


class Encoder:
    """Little-endian 32-bit token ids of UTF-8 texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = {k: v for k, v in json.load(f).items() if k != "model"}
        self.by_words = drops_white_space(spec)
        # Words that differ in case alone are one, but for texts that an added token could be in.
        self.folds = any(s.get("type") == "Lowercase" for s in (spec.get("normalizer") or {}).get("normalizers", []))
        self.added = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        # Characters that stand for bytes, where the model is given those of runs of letters.
        pieces = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        runs_of_letters = self.by_words and self.folds and [p["type"] for p in pieces] == ["Split", "ByteLevel"] and not pieces[1].get("add_prefix_space") and r"[\p{L}]+" in pieces[0]["pattern"]["Regex"].split("|")
        self.model, self.letters = self.tokenizer.model, byte_letters() if runs_of_letters else None
        self.plain_pieces = bool(runs_of_letters) and {r"[\p{N}]", r"[^\s\p{L}\p{N}]+"} <= set(pieces[0]["pattern"]["Regex"].split("|"))
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # Words seen of late, and those of the generation before: what is asked for again moves up.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        if not self.by_words:
            return self.whole(text)
        folded = text.lower()
        plain = not any(t in folded for t in self.added)
        words = BORDER.sub(b" ", folded if self.folds and plain else text).split() if plain else text.split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known, new = self.known, {}, set(words)
        learn, sign = [], MARK.encode()
        for word in new:
            if word in self.older:
                self.known[word] = self.older[word]
            elif len(word) <= LONGEST:
                if sign in word:
                    self.known[word] = self.whole(word)
                elif self.letters is not None and (one := self._word(word)) is not None:
                    self.known[word] = one
                elif self.letters is not None and self.plain_pieces and word.isascii() and word.islower() and b"'" not in word and not any(t in word for t in self.added):
                    # Letters, single digits and runs of signs are pieces of their own.
                    self.known[word] = b"".join(map(self._piece, PIECES.findall(word)))
                else:
                    learn.append(word)
        for lo in range(0, len(learn), TOGETHER):
            part = learn[lo : lo + TOGETHER]
            self.known.update(zip(part, self._ids(part), strict=True))
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # words too long to be remembered
            return b"".join([self.known[w] if len(w) <= LONGEST else self.whole(w) for w in words])

    def _piece(self, piece: bytes) -> bytes:
        found = self.known.get(piece) or self.older.get(piece)
        if found is None:
            found = self.known[piece] = self.model_ids(codecs.charmap_decode(piece, "strict", self.letters)[0])
        return found

    def _word(self, word: bytes) -> bytes | None:
        """Ids of a word of small Latin letters: one piece, which the model takes as it is; None for other words."""
        if word.isalpha() and word.islower():  # ASCII letters alone stand for themselves
            text = word.decode()
        else:
            shown = word.decode("utf-8", "replace")
            if not (shown.isalpha() and shown == shown.lower() and max(shown) < "\u0250"):
                return None
            text = codecs.charmap_decode(word, "strict", self.letters)[0]
        return self.model_ids(text)

    def model_ids(self, text: str) -> bytes:
        found = self.model.tokenize(text)
        return _PACKED[len(found)](*[t.id for t in found]) if len(found) < len(_PACKED) else np.array([t.id for t in found], "<u4").tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is not None:
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join(texts), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(words) - 1:
                return [ids[a:b].tobytes() for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, least first, each compressed."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        table = np.unpackbits(table, axis=1, bitorder="little", count=max(top, 1))
        rows = np.packbits(table.T, axis=1, bitorder="little")
    else:
        rows = table.T[: max(-(-top // 8), 1)]
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(row).tobytes()) for row in rows]


def unplanes(found: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block's planes."""
    open_ = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(open_.decompress(p), np.uint8) for p in found])
    table = np.zeros((n, 4), np.uint8)
    if bits:
        own = np.unpackbits(rows, axis=1, bitorder="little", count=n).T
        full = np.zeros((n, 32), np.uint8)
        full[:, : own.shape[1]] = own
        table = np.packbits(full, axis=1, bitorder="little")
    else:
        table[:, : len(rows)] = rows.T
    return np.ascontiguousarray(table).view("<u4").ravel()


class ShardWriter:
    """Writes one shard as documents come; holds one block."""

    def __init__(self, out, bits: bool, block: int):
        self.out, self.bits, self.block = out, bits, block
        self.at, self.parts, self.held, self.index = 0, [], 0, []
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.n_ids = self.n_docs = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: list[memoryview | bytes]) -> None:
        self.ids.append(doc_ids)
        self.lengths.append(np.array([len(x) // 4 for x in ids], np.int64))
        self.n_docs += len(ids)
        for x in ids:
            self.parts.append(x)
            self.held += len(x)
            if self.held >= 4 * self.block:
                self._flush(False)

    def _flush(self, end: bool) -> None:
        data = b"".join(self.parts)
        size, lo = 4 * self.block, 0
        while lo < len(data) and (end or lo + size <= len(data)):
            part = data[lo : lo + size]
            found = planes(np.frombuffer(part, "<u4"), self.bits)
            self.index.append([self.at, len(part) // 4, [len(p) for p in found], zlib.crc32(part)])
            for p in found:
                self._put(p)
            self.n_ids += len(part) // 4
            lo += size
        self.parts, self.held = [data[lo:]], max(0, len(data) - lo)

    def close(self) -> None:
        self._flush(True)
        table = pa.table({"doc_id": pa.chunked_array(self.ids), "n_tokens": pa.array(np.concatenate(self.lengths), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        at = self.at
        self._put(sink.getvalue().to_pybytes())
        index = zstandard.compress(json.dumps({"planes": "bit" if self.bits else "byte", "documents": [at, self.at - at], "blocks": self.index}).encode())
        at = self.at
        self._put(index)
        self._put(struct.pack(FOOTER, at, len(index), MAGIC))


class ShardReader:
    """A shard's index, its documents and any block of it."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        at, length, magic = struct.unpack(FOOTER, file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard of token planes")
        index = json.loads(zstandard.decompress(file.read_at(length, at)))
        self.bits, self.blocks, self.place = index["planes"] == "bit", index["blocks"], index["documents"]

    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(self.file.read_at(self.place[1], self.place[0])).read_all()

    def block(self, k: int) -> bytes:
        at, n, sizes, crc = self.blocks[k]
        data = self.file.read_at(sum(sizes), at)
        ends = np.cumsum(sizes).tolist()
        out = unplanes([data[e - s : e] for e, s in zip(ends, sizes, strict=True)], n, self.bits).tobytes()
        if zlib.crc32(out) != crc:
            raise ValueError(f"block {k} is damaged")
        return out


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else posixpath.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None
    n_docs: int
    n_ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.bits, self.block = options["path"], options.get("planes", "bit") == "bit", int(options.get("block", BLOCK_IDS))
        self.id_type = schema["doc_id"].dataType.simpleString()
        where, folder = _at(self.path)
        if not overwrite and where.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a dataset already")
        where.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        where, folder = _at(self.path)
        name, shard = f"shard-{part:06d}-{uuid.uuid4().hex}.planes", None
        out = None
        for batch in iterator:
            if batch.num_rows:
                if shard is None:
                    out = where.open_output_stream(f"{folder}/{name}")
                    shard = ShardWriter(out, self.bits, self.block)
                data, offsets = raw(batch.column(batch.schema.names.index("ids")))
                view = memoryview(np.ascontiguousarray(data)).cast("B")
                shard.add(batch.column(batch.schema.names.index("doc_id")), [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        if shard is None:
            return Written(part, None, 0, 0)
        shard.close()
        out.close()
        return Written(part, name, shard.n_docs, shard.n_ids)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = _at(self.path)
        shards = [{"name": m.name, "n_docs": m.n_docs, "n_ids": m.n_ids} for m in sorted((m for m in messages if m), key=lambda m: m.part) if m.name]
        draft = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with where.open_output_stream(draft) as out:
            out.write(json.dumps({"doc_id": self.id_type, "shards": shards}).encode())
        where.move(draft, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = _at(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{folder}/{m.name}")


def manifest(path: str) -> dict:
    where, folder = _at(path)
    with where.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Shard(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.batch_bytes = options["path"], int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[Shard]:
        out, start = [], 0
        for s in manifest(self.path)["shards"]:
            out.append(Shard(s["name"], start))
            start += s["n_ids"]
        return out or [Shard("", 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        where, folder = _at(self.path)
        with where.open_input_file(f"{folder}/{partition.name}") as file:
            shard = ShardReader(file)
            table = shard.documents()
            lengths = table["n_tokens"].to_numpy()
            ends = np.cumsum(lengths)
            doc_ids, lo, k, held = table["doc_id"].combine_chunks(), 0, 0, b""
            while lo < len(lengths):
                first = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, first + self.batch_bytes // 4, "right")))
                parts, size, need = [held], len(held), 4 * (int(ends[hi - 1]) - first)
                while size < need:
                    parts.append(shard.block(k))
                    size, k = size + len(parts[-1]), k + 1
                data = b"".join(parts)
                own, held = data[:need], data[need:]
                cuts = (np.concatenate([[0], ends[lo:hi] - first]) * 4).tolist()
                starts = partition.start + first + np.concatenate([[0], ends[lo : hi - 1] - first])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), pa.array(starts, pa.int64()), pa.array(lengths[lo:hi], pa.int64()), pa.array([own[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                lo = hi


class TokenPlanes(DataSource):
    """``spark.read.format("token_planes").load(path)``: doc_id, start, n_tokens, ids (binary)."""

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        return f"doc_id {manifest(self.options['path'])['doc_id']}, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    prepare(spark).dataSource.register(TokenPlanes)


@dataclass(frozen=True)
class Settings:
    tokenizer: str
    end_id: int = 1
    #: "bit" or "byte"; byte planes of this vocabulary's ids take 1.34 bytes an id, bit planes 1.55.
    planes: str = "byte"
    block: int = BLOCK_IDS


def token_ids(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id and ids (binary) of every document, by ascending id over the partitions."""
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows that repeat an id are told apart by the beginning of their texts.
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    end = np.array([settings.end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(settings.tokenizer)
        for batch in batches:
            data, offsets = raw(batch.column(1))
            whole, bounds = data.tobytes(), offsets.tolist()
            found = [own(whole[a:b]) + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(encode, StructType().add("doc_id", id_type).add("ids", "binary"))


def write(docs: DataFrame, path: str, settings: Settings) -> None:
    """Write all documents' ids as a dataset."""
    register(docs.sparkSession)
    token_ids(docs, settings).write.format("token_planes").option("planes", settings.planes).option("block", settings.block).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("token_planes").load(path)

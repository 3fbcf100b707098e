"""Corpus counts of keys, asked for by blocks.

A block's distinct keys, sorted, go in slices to hash buckets with the counts
they have in the block; a bucket adds the blocks' counts up and answers each
block with totals in the order of its keys.  A key in every text is one entry
for each block, so no bucket is hot, and nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import store


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress better: four planes, or eight where the largest needs them."""
    width = 4 if not len(x) or int(x.max()) <= 0xFFFFFFFF else 8
    return bytes([width]) + squeeze(np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T)


def unplanes(blob: bytes) -> np.ndarray:
    width = blob[0]
    parts = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[1:], max_output_size=0), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(parts.T).view(f"<u{width}").ravel()


REQUEST = "bucket int, block long, keys binary, a binary, b binary"
ANSWER = "block long, bucket int, a binary, b binary, n_a long, n_b long, distinct long"


def exchange(blocks: DataFrame, ask: Callable[[dict], tuple], buckets: int, name: str, width: int = 6) -> DataFrame:
    """Corpus totals of every block's keys, by block and bucket, in the keys' order.

    width: bytes of a key that are compared; eight where a chance match would matter.
    """

    def requests(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, a, b = ask(row)
                bounds = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                out: list[list] = [[] for _ in range(5)]
                for q in np.flatnonzero(np.diff(bounds)).tolist():
                    own = slice(bounds[q], bounds[q + 1])
                    short = np.ascontiguousarray((keys[own] >> np.uint64(64 - 8 * width)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
                    for column, v in zip(out, (q, row["block"], short.tobytes(), planes(a[own]), planes(b[own])), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in REQUEST.split(", ")])

    def answer(found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        sizes = [len(r["keys"]) // width for r in rows]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :width] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, width)
        unique, inverse = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        a, b = (_sums(inverse, np.concatenate([unplanes(r[c]) for r in rows]), len(unique)) for c in "ab")
        out: list[list] = [[] for _ in range(7)]
        at = 0
        for r, n in zip(rows, sizes, strict=True):
            own = inverse[at : at + n]
            at += n
            for column, v in zip(out, (r["block"], r["bucket"], planes(a[own]), planes(b[own]), 0, 0, 0), strict=True):
                column.append(v)
        for column, v in zip(out, (-1, rows[0]["bucket"], b"", b"", int(a.sum()), int(b.sum()), int(np.count_nonzero(a + b))), strict=True):
            column.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in ANSWER.split(", ")])

    asked = blocks.mapInArrow(requests, REQUEST)
    return store(asked.groupBy("bucket").applyInArrow(answer, ANSWER), name)


def _sums(inverse: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of integers by key."""
    out = np.zeros(size, np.int64)
    np.add.at(out, inverse, n.astype(np.int64))
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)

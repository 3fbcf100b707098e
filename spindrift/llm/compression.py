"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text that shares its habits with the good examples compresses better with a
good dictionary.  Pairs of dictionaries, one of good and one of bad text, are
built from parts of the sample; the score's only input is the mean over the
pairs of the normalised size difference (bad - good) / (bad + good).  A logistic
regression on that difference, its square and its cube makes it a probability.
It is fitted on differences by the pairs that were not built from the text.

Fitting uses a bounded sample of labelled rows (``Settings.per_class`` and
``class_bytes``), whole texts; rows weigh as the classes' real shares do.

Defined results: null counts as empty, and an empty text gets the calibrated
value of its two empty frames, a difference of zero; equal texts get equal
scores, repeated rows a row each; very long texts are compressed whole; of
conflicting labels or texts of one doc_id the smaller counts in fitting; other
columns of either table play no part; an empty table gives an empty result.
Without labelled rows of both classes every score is the share of good ones
(0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import filled, fold, labelled_sample, logistic, to_share


@dataclass(frozen=True)
class Settings:
    #: Bounds on the labelled rows of each class that fitting reads, and on their bytes.
    per_class: int = 4000
    class_bytes: int = 16 << 20
    #: Pairs of dictionaries, and the bytes of each dictionary.
    pairs: int = 4
    dictionary_bytes: int = 16384
    level: int = 3
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    #: (good, bad) dictionaries.
    pairs: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]
    level: int


class Compressor:
    """The compressors of a model, built once in each worker."""

    def __init__(self, pairs: tuple[tuple[bytes, bytes], ...], level: int):
        def make(dictionary: bytes) -> zstandard.ZstdCompressor:
            data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
            return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False)

        self.pairs = [(make(good), make(bad)) for good, bad in pairs]

    def differences(self, text: bytes) -> list[float]:
        """By each pair: the normalised difference of the compressed sizes, above 0 for texts more like the good."""
        sizes = ((len(good.compress(text)), len(bad.compress(text))) for good, bad in self.pairs)
        return [(b - g) / (b + g) for g, b in sizes]


def _columns(difference: np.ndarray) -> np.ndarray:
    z = 10 * difference
    return np.column_stack([np.ones_like(z), z, z**2, z**3])


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """The segments that recur most in the texts, found by zstandard's trainer over whole texts."""
    try:
        return zstandard.train_dictionary(size, [t for t in texts if t]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text for the trainer
        return b"\n".join(texts)[-size:].ljust(8, b"\n")


def fit(sample: list[tuple[str, int]], share: float | None = None, settings: Settings = Settings()) -> Model:
    """share: of good rows among all labelled ones; the sample's rows are weighted to it."""
    s = settings
    by_class = [[t.encode() for t, y in sample if y == k] for k in (0, 1)]
    if not all(by_class):
        own = min(max(len(by_class[1]) / len(sample), 0.001), 0.999) if sample else 0.5
        return Model((), (float(np.log(own / (1 - own))), 0.0, 0.0, 0.0), s.level)
    parts = max(1, min(s.pairs, *map(len, by_class)))
    pairs = tuple(tuple(_dictionary(own[k::parts], s.dictionary_bytes) for own in reversed(by_class)) for k in range(parts))
    c = Compressor(pairs, s.level)
    d = np.array([c.differences(t) for own in by_class for t in own])
    y = np.concatenate([np.full(len(own), k, float) for k, own in enumerate(by_class)])
    if parts > 1:
        others = np.concatenate([np.arange(len(own)) % parts for own in by_class])[:, None] != np.arange(parts)
        d = (d * others).sum(1, keepdims=True) / (parts - 1)
    weights = logistic(_columns(d.mean(1)), y, to_share(y, share), np.full(4, s.ridge))
    return Model(pairs, tuple(weights.tolist()), s.level)


def probability(differences: list[list[float]], model: Model) -> np.ndarray:
    mean = np.array([np.mean(d) if d else 0.0 for d in differences])
    return 1 / (1 + np.exp(-np.clip(_columns(mean) @ np.array(model.weights), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    sample, share = labelled_sample(docs, labels, "quality", settings.per_class, settings.class_bytes)
    rows = sorted(sample.collect(), key=lambda r: r.place)  # at most per_class rows and class_bytes bytes a class
    return fit([(r.text, r.label) for r in rows], share, settings)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the settings
    result = f"doc_id {kind}, held_out boolean, score double, predicted int"

    def run(batches):
        m = shared.value
        c = Compressor(m.pairs, m.level)
        for batch in batches:
            p = probability([c.differences(t.encode()) for t in filled(batch.column(2)).to_pylist()], m)
            columns = [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (fold(docs["doc_id"]) == 0).alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(run, result)

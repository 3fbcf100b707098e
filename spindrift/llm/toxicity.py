"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of rows of one table, picked by hashes of the
word and of its first letters, so that forms of one stem are known by it.
Convolutions of several widths with max pooling over the whole text feed a
logistic output.

Thresholds are calibrated by language: the language is told from the text's
own function words (never from a column), and a score of 0.5 lies where a
logistic regression on out-of-fold logits puts it for that language.

Fitting uses a bounded sample of labelled rows (``Settings.per_class`` and
``class_bytes``), whole texts, of which the driver gets hashes only; fold 0 is
never used.  Scoring reads every whole text.

Defined results: null and empty texts have no words and get the score of an
all-zero pooling; equal texts get equal scores, repeated rows a row each; very
long texts are read whole; of conflicting labels or texts of one doc_id the
smaller counts in fitting; other columns of either table play no part; an empty
table gives an empty result.  Without labels of both classes nothing can be
learned: every score is 0.25, and no document is rejected.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, fold, labelled_sample, logistic, raw, to_share
from .words import LOWER, PUNCTUATED, hashes, mix, words

# Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine zu mit auf den von im dem des sich auch es an werden aus er hat dass sie nach wird bei",
    "en": "the of and to in is that it for was on are with as his they be at this have from or had by but not what all were",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más pero sus le ya o este",
    "fr": "le de la et les des est un une du en que qui dans pour pas sur au plus par ce il sont avec ne se ou",
}
LANGUAGES = ("other", *sorted(FUNCTION_WORDS))


#: Logit of an untrained model, a score of 0.25.
UNTRAINED = float(-np.log(3))


@dataclass(frozen=True)
class Settings:
    #: Bound on the labelled rows of each class that fitting reads.
    per_class: int = 6000
    #: Bound on the bytes of each class's texts.
    class_bytes: int = 24 << 20
    #: Rows of the embedding table; hashes are kept in 16 bits.
    buckets: int = 1 << 16
    #: Lengths in bytes of the beginnings of words that have rows of their own.
    heads: tuple[int, ...] = (3, 5)
    dimensions: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    #: Passes over the sample, and the steps that fitting takes at least.
    epochs: int = 6
    least_steps: int = 600
    batch: int = 32
    rate: float = 0.01
    #: Weight decay of the embedding rows that a step touches.
    decay: float = 0.2
    #: Parts of which each is scored by a network trained on the others.
    parts: int = 3
    #: Ridge on the languages' shifts of the threshold.
    shrink: float = 4.0
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    #: buckets x dimensions
    embedding: np.ndarray
    #: For each width: places x dimensions x filters.
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    bias: float
    #: By language: the logit that becomes a score of 0.5, and the slope.
    cuts: dict[str, tuple[float, float]]


def _ids(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets (words x rows) and the text number of each word, and the language number of each text."""
    h, doc, starts, ends = words(data, offsets, PUNCTUATED)
    n = len(offsets) - 1
    votes = np.zeros((n, len(LANGUAGES)), np.int64)
    keys, owner = _function_hashes()
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == h)
    for k in range(len(LANGUAGES) - 1):
        votes[:, k + 1] = np.bincount(doc[hit[owner[at[hit], k]]], minlength=n)
    language = np.where(votes.max(1) > 0, votes.argmax(1), 0) if n else np.zeros(0, np.int64)
    low = LOWER[data]
    heads = [mix(hashes(low, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in s.heads]
    return np.column_stack([x % np.uint64(s.buckets) for x in (h, *heads)]).astype(np.uint16), doc, language


_HASHES: list = []


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all function words, and which languages use each."""
    if not _HASHES:
        owners: dict[int, list[bool]] = {}
        for k, name in enumerate(LANGUAGES[1:]):
            data, offsets = raw(pa.array(FUNCTION_WORDS[name].split()))
            for h in words(data, offsets)[0].tolist():
                owners.setdefault(h, [False] * (len(LANGUAGES) - 1))[k] = True
        order = sorted(owners)
        _HASHES.append((np.array(order, np.uint64), np.array([owners[h] for h in order])))
    return _HASHES[0]


def _pooled(ids: np.ndarray, doc: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Max-pooled, rectified filter answers: n x all filters; 0 where a text is too short."""
    out = []
    x = model.embedding[ids].sum(1)
    for width, kernel, bias in zip(model.settings.widths, model.kernels, model.biases, strict=True):
        pooled = np.zeros((n, model.settings.filters), np.float32)
        count = len(ids) - width + 1
        if count > 0:
            own = doc[:count] == doc[width - 1 :]
            answers = x[:count] @ kernel[0]
            for k in range(1, width):
                answers += x[k : k + count] @ kernel[k]
            answers = answers[own] if width > 1 else answers
            at = doc[:count][own]
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                pooled[at[first]] = np.maximum(np.maximum.reduceat(answers, first, axis=0) + bias, 0)
        out.append(pooled)
    return np.concatenate(out, 1)


def _logits(ids: np.ndarray, doc: np.ndarray, n: int, model: Model) -> np.ndarray:
    return _pooled(ids, doc, n, model).astype(np.float64) @ model.output + model.bias


def _train(texts: list[tuple[np.ndarray, int, int]], s: Settings) -> Model:
    """Stochastic gradient descent with Adam on the rows that a batch touches."""
    rng = np.random.default_rng(s.seed)
    e = rng.normal(0, 0.02, (s.buckets, s.dimensions)).astype(np.float32)
    f = [rng.normal(0, (2 / (w * s.dimensions)) ** 0.5, (w, s.dimensions, s.filters)).astype(np.float32) for w in s.widths]
    b = [np.zeros(s.filters, np.float32) for _ in s.widths]
    o = rng.normal(0, 0.3, len(s.widths) * s.filters).astype(np.float32)
    c = np.zeros(1, np.float32)
    params = [*f, *b, o, c]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    em, ev = np.zeros_like(e), np.zeros(s.buckets, np.float32)
    step = 0
    # Every language and class weighs alike, or a rare language would go unlearned.
    groups = Counter((y, k) for _, y, k in texts)
    weights = {g: min(8.0, len(texts) / (len(groups) * c)) for g, c in groups.items()}
    order = np.arange(len(texts))
    epochs = max(s.epochs, -(-s.least_steps * s.batch // len(texts)))
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = s.rate * (1 - epoch / epochs)
        for at in range(0, len(order), s.batch):
            rows = [texts[i] for i in order[at : at + s.batch]]
            ids = np.concatenate([r[0] for r in rows]).astype(np.int64)
            size = np.array([len(r[0]) for r in rows])
            doc, n = np.repeat(np.arange(len(rows)), size), len(rows)
            y = np.array([r[1] for r in rows], np.float32)
            x = e[ids].sum(1)
            pooled, chosen = [], []
            for width, kernel, bias in zip(s.widths, f, b, strict=True):
                count = len(ids) - width + 1
                p, best = np.zeros((n, s.filters), np.float32), np.full((n, s.filters), -1)
                if count > 0:
                    answers = sum(x[k : k + count] @ kernel[k] for k in range(width)) + bias
                    for i, (lo, hi) in enumerate(zip(np.cumsum(size) - size, np.cumsum(size), strict=True)):
                        if hi - width + 1 > lo:
                            a = answers[lo : hi - width + 1]
                            top = a.argmax(0)
                            value = a[top, np.arange(s.filters)]
                            p[i], best[i] = np.maximum(value, 0), np.where(value > 0, top + lo, -1)
                pooled.append(p)
                chosen.append(best)
            z = np.concatenate(pooled, 1)
            q = 1 / (1 + np.exp(-np.clip(z @ o + c[0], -30, 30)))
            dz = (q - y) * np.array([weights[r[1:]] for r in rows], np.float32) / n
            do, dc = z.T @ dz, np.array([dz.sum()], np.float32)
            dp = dz[:, None] * o[None, :]
            df, db, at_e, de = [], [], [], []
            for j, (width, kernel) in enumerate(zip(s.widths, f, strict=True)):
                g, best = dp[:, j * s.filters : (j + 1) * s.filters], chosen[j]
                i, k = np.nonzero(best >= 0)
                pos, value = best[i, k], g[i, k]
                grad = np.zeros_like(kernel)
                for place in range(width):
                    vectors = x[pos + place]
                    np.add.at(grad[place].T, k, vectors * value[:, None])
                    at_e += list(ids[pos + place].T)
                    de += [kernel[place].T[k] * value[:, None]] * ids.shape[1]
                df.append(grad)
                bias = np.zeros(s.filters, np.float32)
                np.add.at(bias, k, value)
                db.append(bias)
            step += 1
            for p, g, u, v in zip(params, [*df, *db, do, dc], m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if at_e and sum(map(len, at_e)):
                rows_e, inverse = np.unique(np.concatenate(at_e), return_inverse=True)
                grad = np.zeros((len(rows_e), s.dimensions), np.float32)
                np.add.at(grad, inverse, np.concatenate(de))
                ev[rows_e] += (grad**2).mean(1)
                e[rows_e] -= 10 * rate * grad / (np.sqrt(ev[rows_e])[:, None] + 1e-6) + rate * s.decay * e[rows_e]
    return Model(s, e, f, b, o.astype(np.float64), float(c[0]), {})


def fit(texts: list[tuple[np.ndarray, int, int]], settings: Settings = Settings(), share: float | None = None) -> Model:
    """The network learns from all texts (their words' buckets, label, language number).

    Networks trained on the other parts score every text out of fold; a logistic
    regression on those logits sets slope and threshold, and for each language a
    shift of the threshold that a ridge holds near 0 where few rows speak for it.
    Rows weigh as the classes' real shares do.
    """
    s = settings
    y = np.array([t[1] for t in texts], float)
    if not len(y) or y.min() == y.max():
        zero = [np.zeros((w, s.dimensions, s.filters), np.float32) for w in s.widths]
        empty = Model(s, np.zeros((s.buckets, s.dimensions), np.float32), zero, [np.zeros(s.filters, np.float32) for _ in s.widths], np.zeros(len(s.widths) * s.filters), UNTRAINED, {})
        return empty
    logits, part = np.zeros(len(y)), np.arange(len(y)) % s.parts
    for k in range(s.parts):
        model = _train([t for t, p in zip(texts, part, strict=True) if p != k], s)
        for i in np.flatnonzero(part == k).tolist():
            logits[i] = _logits(texts[i][0], np.zeros(len(texts[i][0]), np.int64), 1, model)[0]
    model = _train(texts, s)
    language = np.array([t[2] for t in texts])
    x = np.column_stack([logits, np.ones(len(y)), *(language == k for k in range(len(LANGUAGES)))]).astype(float)
    w = logistic(x, y, to_share(y, share), np.array([1e-3, 1e-3, *[s.shrink] * len(LANGUAGES)]))
    slope = max(w[0], 1e-3)
    model.cuts = {name: (float(-(w[1] + w[2 + k]) / slope), float(slope)) for k, name in enumerate(LANGUAGES)}
    return model


def _scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    n = len(offsets) - 1
    ids, doc, language = _ids(data, offsets, model.settings)
    logits = _logits(ids, doc, n, model)
    cut = np.array([model.cuts.get(name, (0.0, 1.0)) for name in LANGUAGES])
    return 1 / (1 + np.exp(-np.clip((logits - cut[language, 0]) * cut[language, 1], -30, 30)))


def encode(column: pa.Array, labels: list[int], s: Settings) -> list[tuple[np.ndarray, int, int]]:
    """(words' buckets, label, language number) of every text."""
    out = []
    for lo, hi, data, offsets in chunks(column):
        ids, doc, language = _ids(data, offsets, s)
        bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [(ids[bounds[i] : bounds[i + 1]], int(labels[lo + i]), int(language[i])) for i in range(hi - lo)]
    return out


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    sample, share = labelled_sample(docs, labels, "toxic", settings.per_class, settings.class_bytes)

    def run(batches):
        for batch in batches:
            ids, y, language = zip(*encode(batch.column(0), batch.column(1).to_pylist(), settings), strict=True) if batch.num_rows else ([], [], [])
            blobs = pa.array([x.tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([blobs, pa.array(y, pa.int32()), pa.array(language, pa.int32()), batch.column(2)], names=["ids", "label", "language", "place"])

    found = sample.mapInArrow(run, f"ids binary, label int, language int, place {sample.schema['place'].dataType.simpleString()}")
    rows = sorted(found.collect(), key=lambda r: r.place)  # at most per_class rows and twice class_bytes bytes a class
    width = 1 + len(settings.heads)
    return fit([(np.frombuffer(r.ids, np.uint16).reshape(-1, width), r.label, r.language) for r in rows], settings, share)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the settings

    def run(batches):
        for batch in batches:
            p = np.concatenate([_scores(data, offsets, shared.value) for _, _, data, offsets in chunks(batch.column(2))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (fold(docs["doc_id"]) == 0).alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(text)
            p = np.concatenate([_scores(data, offsets, shared.value) for _, _, data, offsets in chunks(column)] or [np.zeros(0)])
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)

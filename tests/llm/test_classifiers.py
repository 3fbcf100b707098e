"""The classifiers on real labels, held out, and against plain computations."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spindrift.llm import common, compression, toxicity

SF = "/root/testdata/sf0.1"


def scored(spark, operator, threshold):
    """The operator's rows for all documents, with labels, languages and texts."""
    docs, labels = (common.table(spark, SF, n) for n in ("documents", "labels"))
    rows = operator.score(docs, operator.train(docs, labels), threshold).toPandas()
    for name in ("documents", "labels"):
        rows = rows.merge(pq.read_table(f"{SF}/{name}.parquet").to_pandas(), on="doc_id")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    return rows[rows.held_out]


def test_toxicity_is_right_on_held_out_rows_in_every_language(spark):
    held = scored(spark, toxicity, 0.5)
    right, clean = held.predicted == held.toxic, held.toxic == 0
    assert right.mean() > clean.mean() + 0.08
    assert (held.predicted[clean] == 1).mean() < 0.03
    for language, own in held.groupby("lang"):
        if len(own) >= 50:
            assert (own.predicted == own.toxic).mean() > (own.toxic == 0).mean() + 0.03, language


def test_quality_is_right_on_held_out_rows(spark):
    held = scored(spark, compression, 0.3)
    right, good = held.predicted == held.quality, held.quality == 1
    assert right.mean() > good.mean() + 0.1
    assert (held.predicted[~good] == 1).mean() < 0.25 and (held.predicted[good] == 1).mean() > 0.98


@pytest.fixture(scope="module")
def network():
    s = toxicity.Settings(buckets=512, least_steps=40)
    texts = ["one two vile", "one two three", "", "nasty", "x", "three one vile two", "the of and to", "der die das"] * 4
    y = [1, 0, 0, 1, 0, 1, 0, 0] * 4
    encoded = toxicity.encode(pa.array(texts), y, s)
    return texts, encoded, toxicity.fit(encoded, s)


def test_pooling_equals_a_plain_convolution(network):
    _, encoded, m = network
    ids = np.concatenate([x for x, _, _ in encoded])
    doc = np.repeat(np.arange(len(encoded)), [len(x) for x, _, _ in encoded])
    got = toxicity._pooled(ids, doc, len(encoded), m)
    for i, (own, _, _) in enumerate(encoded):
        x = [sum(m.embedding[b].astype(float) for b in word) for word in own]
        for j, (width, kernel, bias) in enumerate(zip(m.settings.widths, m.kernels, m.biases, strict=True)):
            for f in range(m.settings.filters):
                answers = [sum(float(x[p + k] @ kernel[k][:, f]) for k in range(width)) + bias[f] for p in range(len(x) - width + 1)]
                assert math.isclose(got[i, j * m.settings.filters + f], max(0.0, *answers) if answers else 0.0, abs_tol=1e-4)


def test_scores_do_not_depend_on_neighbours(network):
    texts, _, m = network
    together = toxicity._scores(*common.raw(pa.array(texts)), m)
    assert np.allclose(together, [toxicity._scores(*common.raw(pa.array([t])), m)[0] for t in texts], atol=1e-6)
    assert together[3] > 0.5 > together[1]


def test_sample_is_bounded_fixed_and_takes_ids_of_any_type(spark):
    labels = [(f"d{i}", i % 2) for i in range(40)] + [("d3", 0), ("d4", 1), ("d5", None), (None, 1)]
    docs = [(f"d{i}", "word " * i) for i in range(40)] + [("d7", "another"), ("d8", None)]
    a, b = (spark.createDataFrame(rows, schema) for rows, schema in ((docs, "doc_id string, text string"), (labels, "doc_id string, toxic int")))
    seen = []
    for n in (1, 5):
        sample, share = common.labelled_sample(a.repartition(n), b.repartition(n), "toxic", 12, 500)
        seen.append(sorted(tuple(r) for r in sample.collect()))
        assert 0.3 < share < 0.7
    assert seen[0] == seen[1]
    for y in (0, 1):
        own = [t for t, label, _ in seen[0] if label == y]
        assert 0 < len(own) <= 12 and sum(map(len, own)) <= 500
    ids = {place.id: (t, y) for t, y, place in seen[0]}
    assert all(zlib.crc32(i.encode()) % 5 for i in ids)
    whole = {p.id: (t, y) for t, y, p in common.labelled_sample(a, b, "toxic", 100, 1 << 20)[0].collect()}
    assert all(whole[i] == v for i, v in {"d7": ("another", 1), "d8": ("", 0), "d3": ("word " * 3, 0), "d4": ("word " * 4, 0)}.items() if i in whole)


def test_size_difference_is_the_only_input():
    good, bad = ["a calm and even sentence of words"] * 30, ["###!!! $$$ ###!!! %%%"] * 30
    m = compression.fit([(t, 1) for t in good] + [(t, 0) for t in bad])
    p = compression.probability([[0.2, 0.1, 0.0, 0.1], [0.1] * 4], m)
    assert p[0] == p[1], "only the mean difference counts"
    c = compression.Compressor(m.pairs, m.level)
    p = compression.probability([c.differences(t.encode()) for t in (good[0], bad[0])], m)
    assert p[0] > 0.9 and p[1] < 0.1

"""The pipeline's stages on the smallest tables and on edge rows."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out = corpus_pipeline.store(out, "t")
        n = out.count()
        assert 0 < n <= seen and (name != "pii" or n == seen)
        docs, seen = out, n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == seen


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "x", "en", "s", 1), (3, "word " * 5000, None, "s", 9)]])
def test_edge_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() == 0) == (not rows)


def test_a_leaked_row_without_an_id_goes(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item, "en", "s", 1), (None, "quite another text", "en", "s", 1), (None, None, "en", "s", 0), (4, item, "en", "s", 1), (5, "clean", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "quite another text"), (5, "clean")]

"""Every pipeline stage on rows with nulls, repeats, long texts, clashing columns, and none at all."""

import pytest

import corpus_pipeline

from .conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, component long, _id string, severity double, copies int, rep long, key string, n_hit long, size int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    extra = (1, 2, "x", 0.5, 9, 3, "k", 4, 5)
    texts = [None, "", " ", "a b c d e f", "a b c d e f", "q " * 150_000, "é ü", "An idiot and a moron, pathetic scum and worthless trash."]
    rows = [(k, t, None if k % 3 == 0 else "en", [None, "s1", "", "s2"][k % 4], None, *extra) for k, t in enumerate(texts)] + [(3, "a b c d e f", "en", "s2", None, *extra), (None, "no id here", None, None, None, *extra)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "token_binary":
        assert len(got) == len(rows)
    else:
        assert out.columns == docs.columns and got and set(map(tuple, got)) <= set(rows)
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == out.columns and none.collect() == []

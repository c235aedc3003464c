"""The pipeline's stages, each on what the one before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gleaner.llm import toxicity

from .shared import base_spans, lines_kept, near_classes


@pytest.fixture(scope="module")
def kept(spark, small_dir):
    out, docs = [], spark.read.parquet(f"{small_dir}/documents.parquet")
    for _, stage in P.STAGES:
        out.append(docs)
        docs = P.pinned(stage(spark, docs, small_dir))
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(kept):
    assert all(x.columns == ["doc_id", "text", "lang", "source", "n_chars"] for x in kept[:-1])


def test_toxic_documents_go(spark, small_dir, kept):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    before, after = rows(kept[0]), rows(kept[1])
    assert after.keys() <= before.keys() and all(after[i] == before[i] for i in after)
    wrong = [i for i in before if i in labels and (i in after) == bool(labels[i])]
    assert len(wrong) <= 0.05 * len(labels)


def test_shared_lines_go(kept):
    before, after = rows(kept[1]), rows(kept[2])
    need = {i: t for i, t, _, _ in lines_kept([(i, r.text) for i, r in before.items()])}
    assert {i: r.text for i, r in after.items()} == need
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_copies_go(kept):
    before, after = rows(kept[2]), rows(kept[3])
    need = near_classes([(i, r.text) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, root in need.items() if i == root}


def test_secrets_are_masked(kept):
    before, after = rows(kept[3]), rows(kept[4])
    assert set(before) == set(after)
    for i, r in before.items():
        if not base_spans(r.text):
            assert after[i].text == r.text or "[secret]" in after[i].text
        else:
            assert not base_spans(after[i].text)


def test_everything_is_packed(kept):
    assert {r.doc_id for r in kept[5].collect()} == set(rows(kept[4]))


def test_nulls(spark, small_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0)], spark.read.parquet(f"{small_dir}/documents.parquet").schema)
    for _, stage in P.STAGES[:-1]:
        docs = P.pinned(stage(spark, docs, small_dir))
        assert docs.count() == 4
    assert docs.where("text is null").count() == 2 and P.pack(spark, docs, small_dir).where(F.col("length") == 1).count() == 4


def test_run(spark, small_dir, kept):
    assert P.run(spark, small_dir).count() == kept[5].count()
    assert isinstance(toxicity.Model, type)

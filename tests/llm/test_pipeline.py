"""The pipeline's stages: each decision against its operator, and the whole against brute force where it can be stated."""

from __future__ import annotations

import pytest

import corpus_pipeline
from geoloom.llm import decontam, pii, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again."""
    sf_dir, out = "/root/testdata/sf0.01", {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name in [n for n, _ in corpus_pipeline.STAGES][:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_decisions(spark, stages):
    sf_dir = "/root/testdata/sf0.01"
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(stages["quality_classifier"]) == ids(quality.importance_sample(stages["documents"], labels).filter("kept"))
    assert ids(stages["near_duplicates"]) == ids(simhash.near_duplicates(stages["quality_classifier"]).filter("doc_id = component_id"))
    dirty = {r.doc_id for r in decontam.contaminations(stages["near_duplicates"], bench).collect()}
    assert dirty and set(ids(stages["decontamination"])) == set(ids(stages["near_duplicates"])) - dirty
    assert ids(stages["personal_data"]) == ids(stages["decontamination"])
    for r in stages["personal_data"].collect():
        assert not [s for s in pii.base_spans(r.text) if s[0] == "email"] and r.n_chars == len(r.text)
    assert set(ids(stages["packing"])) == set(ids(stages["personal_data"]))


def test_copies_leave_one(stages):
    texts = [r.text for r in stages["near_duplicates"].collect()]
    assert len(texts) == len(set(texts))


def test_run_equals_the_stages(spark, stages):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").drop("sequence_id", "offset").collect())
    assert got == sorted(tuple(r) for r in stages["packing"].drop("sequence_id", "offset").collect())


ODD = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some text here now", "en", "s", 18), (3, "some text here now", "en", "s", 18), (None, "a mail to a.b@c.org", None, None, 5)]


def test_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(ODD, DOCS)
    first, *rest = [f for _, f in corpus_pipeline.STAGES]
    kept = quality.importance_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").count()
    assert first(spark, docs, sf_dir).count() == kept and set(map(tuple, first(spark, docs, sf_dir).collect())) <= set(ODD)
    # null and empty texts are one group, of which the smallest id stays; of repeated rows one stays
    left = [(1, None, "en", "s", 0), (3, "some text here now", "en", "s", 18), (None, "a mail to a.b@c.org", None, None, 5)]
    for stage, due in zip(rest, (left, left, [*left[:2], (None, "a mail to [EMAIL]", None, None, 17)])):
        docs = stage(spark, docs, sf_dir)
        got = sorted(map(tuple, docs.collect()), key=str)
        assert [r[:4] for r in got] == [r[:4] for r in sorted(due, key=str)]
    lengths = {r.doc_id: (r.start, r.length, r.doc_tokens) for r in rest[-1](spark, docs, sf_dir).collect()}
    assert set(lengths) == {None, 1, 3} and lengths[1] == (0, 1, 1) and all(s == 0 and n == t for s, n, t in lengths.values())


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0

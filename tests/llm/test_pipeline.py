"""The pipeline's stages against plain Python versions."""

import corpus_pipeline
import pytest

from .brute import frame, near_duplicates, sample


@pytest.fixture(scope="module")
def docs(spark):
    rows = sample(21, 40) + [(1000, "Write to someone@mail.example.com soon, please do it today, my friend, thank you. It is a good text."), (1001, "Home | About | Contact | News | More | Here")]
    rows = [(i, t if t is None else t + " end of it." * (len(t.split()) > 20)) for i, t in rows]
    return frame(spark, rows)


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "privacy", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, "")
    assert good.columns == docs.columns and good.filter("doc_id = 1001").count() == 0 and good.filter("doc_id = 1000").count() == 1
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = stage["near_duplicates"](spark, docs, "")
    expected = {i for i, (_, c) in near_duplicates(rows, 5).items() if i == c}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == expected
    safe = stage["privacy"](spark, docs, "")
    assert safe.columns == docs.columns and safe.count() == len(rows) and "[EMAIL]" in safe.filter("doc_id = 1000").first()["text"]
    mixed = stage["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = stage["packing"](spark, docs, "")
    assert packed.groupBy("doc_id").sum("length").count() == len(rows)
    for step in stage.values():
        assert step(spark, docs.limit(0), "").count() == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0

"""The pipeline's stages against what each must keep."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_duplicates import expected_groups
from tests.llm.test_safety import base_spans


def as_table(df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_run(spark, texts):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert {r["doc_id"] for r in rows} <= set(texts)


def test_near_dedup(spark, small, texts):
    docs, sf = small
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({low for _, _, low in expected_groups(sorted(texts.items()))})


def test_decontaminate_and_mask(spark, small, texts):
    docs, sf = small
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()}
    holding = {d for d, t in texts.items() if any(i in t for i in items)}
    assert not kept & holding and len(texts) - len(kept) <= len(holding) + 2
    masked = corpus_pipeline.mask_pii(spark, docs, sf)
    assert masked.columns == docs.columns and masked.count() == len(texts)
    for r in masked.collect():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not base_spans(texts[r["doc_id"]]) and r["text"] != texts[r["doc_id"]]:
            assert "<IBAN>" in r["text"] or "<SSN>" in r["text"]


def test_toxic_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    insults = {"idiot", "moron", "scum", "loser", "trash"}
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    bad = {r["doc_id"] for r in docs.collect() if insults & set(r["text"].lower().split())}
    assert len(bad & left) <= 0.1 * len(bad)
    assert docs.count() - len(left) - len(bad) <= 0.1 * docs.count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edges(spark, edges, nothing, stage, tmp_path):
    renamed = edges.withColumnRenamed("fp", "_id").withColumnRenamed("row", "_key").withColumnRenamed("piece", "toxicity")
    docs = as_table(renamed, tmp_path, "edges")
    out = stage(spark, docs, "/root/testdata/sf0.001")
    if stage is not corpus_pipeline.pack:
        assert out.columns == docs.columns
        assert out.count() == {"near_dedup": 8}.get(stage.__name__, docs.count())
    assert out.count() > 0
    assert stage(spark, as_table(nothing, tmp_path, "nothing"), "/root/testdata/sf0.001").count() == 0

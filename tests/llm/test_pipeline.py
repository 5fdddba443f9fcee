import hashlib

import pytest

import corpus_pipeline
from skyledger.llm import bpe, exact, mixing, near, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen.append(len(rows))
        ids = sorted(r.doc_id for r in rows)
        if name == "toxicity":
            assert ids == sorted(r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect())
        if name == "exact_dedup":
            assert ids == sorted(r.doc_id for r in exact.duplicate_groups(docs).where("kept").collect())
        if name == "near_dedup":
            assert ids == sorted(r.doc_id for r in near.near_duplicate_groups(docs).where("kept").collect())
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
            assert ids == sorted(i for i, n in copies.items() for _ in range(n))
        if name == "bpe":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert ids == sorted(r.doc_id for r in docs.collect())
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in rows)
        else:
            assert out.columns == names
            docs = spark.createDataFrame(rows, docs.schema)
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert total >= seen[0] >= seen[1] >= seen[2] > 0 and total > seen[2]
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def test_odd_documents(spark, make, tmp_path):
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, "x" * 100_000, "a"), (None, "no id at all", "b"), (4, "one two", "b"), (5, "one  two", "b")]
    make(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    (tmp_path / "none").mkdir()
    make([]).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

"""The pipeline's stages, each on its own input, against plain rules."""

import re

import corpus_pipeline
from loomspan.llm import language, mixing, odd_sketch, pieces, pii


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        old, new = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        if name == "language":
            model = language.fit(before)
            assert sorted(r["doc_id"] for r in new) == sorted(r["doc_id"] for r in old if not model.predict(r["text"])[2])
        if name == "near_dedup":
            ids = {r.component_id for r in odd_sketch.near_documents(before).collect()}
            assert sorted(r["doc_id"] for r in new) == sorted(ids)
        if name == "redact":
            texts = {r["doc_id"]: r["text"] for r in old}
            assert len(new) == len(old) and all(r["text"] == pii.redacted(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in new)
            assert not any(re.search(r"[a-z]@[a-z0-9]+\.[a-z]", r["text"]) for r in new)
        if name == "mix":
            copies = {r.doc_id: r["_copies"] for r in mixing.with_copies(before).select("_row.doc_id", "_copies").collect()}
            assert {d: sum(r["doc_id"] == d for r in new) for d in copies} == copies
        if name == "encode":
            vocabulary = pieces.load()
            texts = {r["doc_id"]: r["text"] for r in old}
            assert len(new) == len(old) and all(pieces.decode(r["token_ids"], vocabulary).decode() == texts[r["doc_id"]] for r in new)


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "token_ids", "exact"]

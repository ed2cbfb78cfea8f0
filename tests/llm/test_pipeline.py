"""The pipeline's stages against brute force, and the queries as they are registered."""

from __future__ import annotations

import brute
import corpus_pipeline
import public_tokenizers
import pytest

import __spark_entry__
from sheafwork.llm import pieces, quality


def test_stages(spark, sf, documents):
    docs, kept = documents, {r["doc_id"]: r["text"] for r in documents.collect()}
    items = [i["text"] for i in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for index, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        if index < 3:
            assert docs.columns == documents.columns
            found = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if index == 0:
            name = quality.judge(before)
            failed = {r["doc_id"] for r in name[0].filter(f"not {name[1]}.kept").collect()}
            assert {i for i, t in kept.items() if len(brute.words(t)) < 50} <= failed
            kept = {i: t for i, t in kept.items() if i not in failed}
        elif index == 1:
            component = brute.components(list(kept.items()), 5, 80)
            kept = {i: t for i, t in kept.items() if component[i] == i}
        elif index == 2:
            kept = {i: t for i, t in kept.items() if not any(x in t for x in items)}
        if index < 3:
            assert found == set(kept)
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = pieces.Vocabulary(path).decoded
    result = docs.collect()
    assert {r["doc_id"] for r in result} == set(kept)
    for r in result:
        assert b"".join(table[i] for i in r["ids"])[1:].decode() == kept[r["doc_id"]] and r["n_ids"] == len(r["ids"])


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"])
def test_odd_documents_through_stages(name, odd, spark, sf, tmp_path):
    """Every registered query on tables with nulls, empty and long texts, repeated rows and clashing columns."""
    folder = str(tmp_path)
    odd.write.parquet(f"{folder}/documents.parquet")
    for other in ("benchmark", "conversations", "embeddings", "pages"):
        spark.read.parquet(f"{sf}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
    result = __spark_entry__.queries()[name](spark, folder)
    assert len(result.collect()) >= (0 if name.startswith("op9") else 1)

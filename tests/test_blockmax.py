"""Block-max search of many questions against one search after the other."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sheafwork.operators import blockmax, search
from sheafwork.session import cut_lineage


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, "f", " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(40)], k=r.choice([3, 20, 80])))) for i in range(900)]
    # a few documents score far above all others, so most slices cannot enter
    docs += [(5000 + i, "f", "w0 w1 w2 " * 40) for i in range(12)] + [(7000, None, ""), (7001, "g", None)]
    return spark.createDataFrame(docs, "doc_id bigint, filename string, text string").repartition(5)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, text string")


@pytest.mark.parametrize("stemmed", [False, True])
def test_many_questions_equal_single_searches(spark, library, stemmed):
    texts = ["w0 w1", "W2 w0 w2", "w39", "nobody w0", "", None, "f w5", "w0 w1 w2 w3 w4", "g"]
    postings = search.build_text_index(library, stemmed=stemmed)
    lengths = search.text_lengths(library)
    blocks = blockmax.build_blocks(postings, lengths, slice_ids=64)
    found = blockmax.search_many(blocks, asked(spark, *texts), blockmax.corpus_numbers(lengths), k=7, stemmed=stemmed).collect()
    for i, text in enumerate(texts):
        single = search.search_fulltext(postings, text, 7, stemmed, lengths).collect() if text else []
        mine = sorted((r for r in found if r["question_id"] == i), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in mine] == [r["doc_id"] for r in single]
        assert [r["score"] for r in mine] == pytest.approx([r["score"] for r in single], abs=1e-9)
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_slices_that_cannot_enter_are_not_read(spark, library):
    postings, lengths = search.build_text_index(library, stemmed=False), search.text_lengths(library)
    blocks = blockmax.build_blocks(postings, lengths, slice_ids=16)
    counts: dict[str, int] = {}
    blockmax.search_many(blocks, asked(spark, "w0 w1 w2"), blockmax.corpus_numbers(lengths), k=10, stemmed=False, first_slices=2, counts=counts)
    assert 0 < counts["read"] < counts["candidates"] / 4


def test_blocks_hold_all_postings(spark, library):
    postings, lengths = search.build_text_index(library, stemmed=False), search.text_lengths(library)
    blocks = blockmax.build_blocks(postings, lengths, slice_ids=100).collect()
    held = {(b["term"], i, t) for b in blocks for i, t in zip(blockmax.decode_ids(b["ids"]).tolist(), np.frombuffer(b["tfs"], "<i4").tolist())}
    summed = {}
    for p in postings.collect():
        summed[p["term"], p["doc_id"]] = summed.get((p["term"], p["doc_id"]), 0) + p["tf"]
    assert held == {(*k, v) for k, v in summed.items()}
    assert len(blocks) == len({(b["term"], b["slice"]) for b in blocks}) and sum(b["n"] for b in blocks) == len(held)


def test_ids_survive_delta_coding():
    r = random.Random(4)
    for top in (1, 127, 128, 16_383, 16_384, 2**31, 2**53, 2**62):
        ids = np.array(sorted({r.randrange(top + 1) for _ in range(50)} | {top, 0}), dtype=np.int64)
        assert blockmax.decode_ids(blockmax.encode_ids(ids)).tolist() == ids.tolist()
    assert len(blockmax.encode_ids(np.arange(1000))) == 1000


def test_no_index_and_no_questions(spark, library):
    postings, lengths = search.build_text_index(library, stemmed=False), search.text_lengths(library)
    blocks = blockmax.build_blocks(postings, lengths)
    corpus = blockmax.corpus_numbers(lengths)
    assert blockmax.search_many(blocks, asked(spark, "w0").filter("false"), corpus).count() == 0
    empty = library.filter("false")
    none = blockmax.build_blocks(search.build_text_index(empty), search.text_lengths(empty))
    assert blockmax.search_many(none, asked(spark, "w0"), blockmax.corpus_numbers(search.text_lengths(empty))).count() == 0


def test_blocks_are_read_once_for_all_questions(spark, library, monkeypatch):
    """Many parts, bundles and blocks of questions give what one gives, and no block travels once per question and slice."""
    postings, lengths = search.build_text_index(library, stemmed=False), search.text_lengths(library)
    blocks, corpus = blockmax.build_blocks(postings, lengths, slice_ids=16), blockmax.corpus_numbers(lengths)
    questions = asked(spark, *[f"w{i % 7} w{i % 11}" for i in range(60)])

    def rows():
        return sorted((r["question_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in blockmax.search_many(
            blocks, questions, corpus, k=5, stemmed=False).collect())

    whole = rows()
    assert len(whole) > 250
    for name, value in (("LEAST_POSTINGS", 1500), ("BUNDLE_POSTINGS", 200), ("QUESTIONS_IN_BLOCK", 25), ("QUESTIONS_AT_ONCE", 3), ("MOST_SLOTS", 2),
                        ("MOST_DENSE", 3)):
        monkeypatch.setattr(blockmax, name, value)
    assert rows() == whole
    # what is dealt out is a row of the index for each block of questions, and the questions for each part
    dealt = []
    rated = blockmax.rated_terms(blocks, blockmax.question_terms(questions, False), corpus[0])
    stored = cut_lineage(blocks)
    monkeypatch.setattr(type(blocks), "mapInArrow", lambda df, *a, **b: dealt.append(df.count()) or df)
    blockmax.scored(stored, rated, corpus[1], 5, 4)
    assert 0 < dealt[-1] <= 3 * stored.count() + rated.count() * 3 * spark.sparkContext.defaultParallelism


def test_rows_of_one_document_are_one_document(spark):
    """Repeated rows of documents and of questions: their terms add up, and nothing is found twice."""
    docs = spark.createDataFrame([(1, "f", "a b b"), (1, "f", "a c"), (2, "g", "a b"), (2, "g", "a b"), (3, None, "b")], "doc_id bigint, filename string, text string")
    once = spark.createDataFrame([(1, "f f", "a b b a c"), (2, "g g", "a b a b"), (3, None, "b")], "doc_id bigint, filename string, text string")

    def rows(of, *texts):
        postings, lengths = search.build_text_index(of, stemmed=False), search.text_lengths(of)
        questions = spark.createDataFrame([(7, t) for t in texts], "qid int, text string")
        found = blockmax.search_many(blockmax.build_blocks(postings, lengths), questions, blockmax.corpus_numbers(lengths), k=5, stemmed=False)
        return sorted((r["rank"], r["doc_id"], round(r["score"], 9)) for r in found.collect())

    assert rows(docs, "a b", "b a", "a b") == rows(once, "a b")
    assert [r[1] for r in rows(once, "a b")] == [2, 1]

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sheafwork.functions import text as tx
from sheafwork.functions.tokens import porter
from sheafwork.operators import classify, search


def column(spark, values, expression):
    frame = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    rows = frame.select("id", expression(F.col("text")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["id"])]


def random_lines(seed, n):
    rng = random.Random(seed)
    pieces = ["Hola", "MUNDO", "x-ray", "X-Ray", "", "  ", "12", "Nº", "total:", "Ñu", "éa", "a  b", "O'Neil", "\t"]
    return [" ".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(n)]


def test_case_rules(spark):
    lines = random_lines(1, 500)
    assert column(spark, lines, tx.is_upper) == [x.isupper() for x in lines]
    assert column(spark, lines, tx.is_title) == [x == x.title() for x in lines]
    assert column(spark, lines, tx.title_case) == [x.title() for x in lines]
    assert column(spark, lines, tx.strip) == [x.strip() for x in lines]
    assert column(spark, lines, tx.collapse_spaces) == [" ".join(x.split()) for x in lines]


def heading(line):
    return len(line) > 2 and ((len(line) < 100 and (line.isupper() or line.endswith(":")))
                              or (len(line.split()) <= 6 and line == line.title()))


def model_markdown(text):
    blocks, open_block = [], []
    for line in [*(x.strip() for x in text.splitlines()), ""]:
        if line and not heading(line):
            open_block.append(line)
            continue
        if open_block:
            blocks.append(re.sub(r"\s+", " ", " ".join(open_block)))
            open_block = []
        if line:
            blocks.append(f"## {line}")
    return "\n\n".join(blocks)


def test_markdown_against_model(spark):
    rng = random.Random(2)
    texts = [rng.choice(["\n", "\r\n", "\n\n"]).join(random_lines(i, rng.randint(0, 12))) for i in range(300)]
    assert column(spark, texts, classify.to_markdown) == [model_markdown(t) for t in texts]
    assert column(spark, [None], classify.to_markdown) == [""]


def test_names(spark):
    names = ["a.pdf", "dir.x/b", ".hidden", "a.tar.gz", "/x/y/C.PNG", "noext"]
    assert column(spark, names, tx.extension) == [".pdf", "", "", ".gz", ".png", ""]
    assert column(spark, names, tx.stem_of) == ["a", "b", ".hidden", "a.tar", "C", "noext"]


def test_rooms_are_whole_words(spark):
    texts = ["Cocina y baño", "bañera", "hallway", "hall", "el salón-comedor", "ROOM"]
    assert column(spark, texts, classify.blueprint_rooms) == [
        ["Baño", "Cocina"], [], ["Pasillo"], ["Entrada"], ["Salón"], ["Dormitorio"]]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "plastered": "plaster", "hopping": "hop", "filing": "file",
             "relational": "relat", "hopefulness": "hope", "adjustment": "adjust", "controll": "control",
             "generalizations": "gener", "sky": "sky", "is": "is", "café": "café"}
    assert {w: porter(w) for w in pairs} == pairs


def model_snippet(text, wanted, size=20):
    words = text.split()
    hits = [i for i, w in enumerate(words) if re.sub(r"^\W+|\W+$", "", w.lower()) in wanted]
    best = (0, 0)
    for h in hits:
        start = max(0, min(h, len(words) - size))
        n = sum(start <= x < start + size for x in hits)
        if (-n, start) < best:
            best = (-n, start)
    start = best[1]
    shown = [f"<b>{w}</b>" if start + i in hits else w for i, w in enumerate(words[start:start + size])]
    return ("..." if start else "") + " ".join(shown) + ("..." if start + size < len(words) else "")


def test_snippet_against_model(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alfa", "beta,", "(gamma)", "delta", "uno", "dos", "tres"], k=rng.randint(1, 80)))
             for _ in range(100)]
    got = column(spark, texts, lambda c: search.snippet(c, "gamma beta"))
    assert got == [model_snippet(t, {"gamma", "beta"}) for t in texts]


def test_chunks(spark):
    texts = ["short", "", "x" * 30 + "\n\n" + "y" * 3100, "a" * 10 + "\n\n" + "b" * 10, None]
    got = column(spark, texts, search.chunks_of)
    assert got[0] == ["short"] and got[1] == []
    assert [len(c) for c in got[2]] == [30, 1500, 1500, 100]
    assert got[3] == ["a" * 10 + "\n\n" + "b" * 10]


def test_search_ranks_and_requires_all_terms(spark):
    docs = spark.createDataFrame([
        (1, "a.txt", "running dogs run"), (2, "b.txt", "a dog"), (3, "run.txt", "nothing else, only cats here at all"),
        (4, "dog-run.txt", "the dog runs and runs"),
    ], "doc_id bigint, filename string, text string")
    postings = search.build_text_index(docs)
    got = [r["doc_id"] for r in search.search_fulltext(postings, "Dogs running").collect()]
    assert got[0] == 4 and set(got) == {1, 4}
    assert search.search_fulltext(postings, " ... ").count() == 0
    assert {r["doc_id"]: r["n_terms"] for r in search.text_lengths(docs).collect()} == {
        r["doc_id"]: r["n_terms"] for r in search.document_lengths(postings).collect()}


def test_short_paragraphs_are_kept_whole(spark):
    text = "\n\n".join(f"line {i}" for i in range(700))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id_doc bigint, text string")
    got = search.chunk_text(docs).orderBy("chunk_no").collect()
    assert "".join(r["chunk"] for r in got) == text and max(len(r["chunk"]) for r in got) <= 1500
    mixed = spark.createDataFrame([(1, "short\n\n" + "long " * 10)], "id_doc bigint, text string")
    assert search.chunk_text(mixed).count() == 1 and search.chunk_text(mixed, minimum=0).count() == 2

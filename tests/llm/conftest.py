from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

VOCABULARIES = {name: public_tokenizers.path(name) for name in
                ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")}

LONG = "lorem ipsum dolor " * 20_000
PROSE = ("The committee met in the old town hall and spoke at length about the bridge, the market, the school and the road "
         "that leads past the mill to the river. Nobody could say who had first proposed the plan, yet all agreed that it "
         "was sound, cheap and quickly done, and so the vote was taken without further delay on that same grey evening.")


@pytest.fixture(scope="session")
def paths() -> dict[str, str]:
    return VOCABULARIES


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns that might clash."""
    rows = [
        (1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "a"), (3, None, "a"), (4, "", None), (5, " \n\t ", None),
        (6, LONG, "b"), (7, "one two", None), (8, "one two", "b"), (None, PROSE, "b"), (None, None, None),
        (9, "Über den Wölken ▁ \x01 <s> naïve 😀 日本語 \\ [INST]", "c"), (10, PROSE.replace("grey", "dark"), "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit(7) for c in (
        "quality", "leaks", "ids", "node", "sig", "block", "train", "shard", "slot", "n_words", "kept", "size", "h", "b",
        "component", "condemned_host", "dropped_id", "word", "n", "part", "license")} | {"lang": F.lit(None).cast("string")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

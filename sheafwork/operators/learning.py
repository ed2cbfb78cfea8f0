"""Trained document types and colour palettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    IDF, CountVectorizer, IndexToString, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.operators.classify import UNKNOWN, classify_keywords
from sheafwork.session import cut_lineage

MIN_TEXT = 20
MIN_ROWS = 5
VOCABULARY = 5000
REGULARISATION = 1e-3
ITERATIONS = 10
TYPES_AT_ONCE = 4
PALETTE = 5
SEED = 42
CELL_BITS = 8
STARTS = 10
TOLERANCE = 1e-4


def training_rows(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, type) of documents with a known type and more than 20 characters."""
    known = docs.filter(F.col("type").isNotNull() & (F.col("type") != UNKNOWN)).select("doc_id", "type")
    usable = texts.filter(F.length("text") > MIN_TEXT).select(F.col("id_doc").alias("doc_id"), "text")
    return known.join(usable, "doc_id").select("text", "type")


def train_text_classifier(rows: DataFrame, vocabulary: int = VOCABULARY, iterations: int = ITERATIONS,
                          most_rows: int | None = None) -> PipelineModel:
    """TF-IDF over the ``vocabulary`` commonest words and a linear hinge classifier per type; needs five rows.

    The rows are stored once, because every step of the fit reads them. ``most_rows`` bounds how many labelled rows are
    fitted, those with the smallest hash of their text.
    """
    if most_rows is not None:
        rows = rows.orderBy(F.xxhash64("text", "type")).limit(most_rows)
    rows = cut_lineage(rows)
    found = rows.limit(MIN_ROWS).count()
    if found < MIN_ROWS:
        raise ValueError(f"not enough data to train: {found} rows, {MIN_ROWS} needed")
    indexer = StringIndexer(inputCol="type", outputCol="label", handleInvalid="skip").fit(rows)
    steps = [
        indexer,
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True),
        CountVectorizer(inputCol="words", outputCol="counts", vocabSize=vocabulary),
        IDF(inputCol="counts", outputCol="weights"),
        Normalizer(inputCol="weights", outputCol="features"),
        OneVsRest(classifier=LinearSVC(regParam=REGULARISATION, maxIter=iterations), featuresCol="features",
                  labelCol="label", predictionCol="prediction", parallelism=TYPES_AT_ONCE),
    ]
    trained = Pipeline(stages=steps).fit(rows)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return PipelineModel(stages=[*trained.stages[1:], names])


def predict_type(texts: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Add ``type`` and ``tag``: the model's answer tagged AI, or the keyword rules without a model or without text."""
    rules = classify_keywords(F.col("text"))
    if model is None:
        return texts.withColumn("_c", rules).withColumns({"type": F.col("_c.type"), "tag": F.col("_c.tag")}).drop("_c")
    kept = list(texts.columns)
    answered = model.transform(texts.withColumn("text", F.coalesce("text", F.lit(""))))
    has_text = F.length("text") > 0
    return answered.select(*kept, F.when(has_text, F.col("predicted")).otherwise(UNKNOWN).alias("type"),
                           F.when(has_text, "AI").alias("tag"))


def _hex(centre: np.ndarray) -> str:
    return "#" + "".join(f"{int(c):02x}" for c in centre)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one row per point."""
    squares = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T
    return np.maximum(squares, 0.0)


def _lloyd(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.RandomState) -> tuple[float, np.ndarray]:
    """Weighted k-means from one k-means++ start."""
    centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < k:
        gap = _distances(points, centres).min(1) * weights
        if gap.sum() == 0:
            break
        centres = np.vstack([centres, points[rng.choice(len(points), p=gap / gap.sum())]])
    settled = TOLERANCE * np.average((points - np.average(points, axis=0, weights=weights)) ** 2, axis=0,
                                     weights=weights).mean()
    for _ in range(300):
        nearest = _distances(points, centres).argmin(1)
        mass = np.bincount(nearest, weights, len(centres))
        sums = np.stack([np.bincount(nearest, weights * points[:, c], len(centres)) for c in range(3)], axis=1)
        moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-12)[:, None], centres)
        shift = ((moved - centres) ** 2).sum()
        centres = moved
        if shift <= settled:
            break
    return (_distances(points, centres).min(1) * weights).sum(), centres


def color_cells(pixels: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """Pixels summed into cells of the colour cube: image_id, mean r, g, b and pixel count.

    All pixels count. Sums combine on the map side, and an image has at most 2^(3·bits) cells, so what its clustering
    gathers is bounded however large the image is.
    """
    step = 2 ** (8 - bits)
    cell = [F.floor(F.col(c) / step).alias(f"_{c}") for c in "rgb"]
    sums = [F.avg(c).alias(c) for c in "rgb"]
    return pixels.groupBy("image_id", *cell).agg(*sums, F.count("*").alias("n")).drop("_r", "_g", "_b")


def color_palette(pixels: DataFrame, k: int = PALETTE, bits: int = CELL_BITS) -> DataFrame:
    """(image_id, rank, hex, share): k-means centres of every image's colours, largest cluster first.

    By default every colour is a cell of its own, which gives the clusters of the pixels; fewer ``bits`` cluster the means
    of coarser cells, for images of very many colours.
    """
    def palette(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        points, weights = cells[["r", "g", "b"]].to_numpy("float64"), cells["n"].to_numpy("float64")
        rng = np.random.RandomState(SEED)
        _, centres = min((_lloyd(points, weights, k, rng) for _ in range(STARTS)), key=lambda x: x[0])
        share = np.bincount(_distances(points, centres).argmin(1), weights, len(centres)) / weights.sum()
        order = np.lexsort(([_hex(c) for c in centres], -share))
        return pd.DataFrame({"image_id": key[0], "rank": np.arange(1, len(order) + 1),
                             "hex": [_hex(centres[i]) for i in order], "share": share[order]})

    return color_cells(pixels, bits).groupBy("image_id").applyInPandas(
        palette, "image_id bigint, rank bigint, hex string, share double")


def corpus_palette(pixels: DataFrame, k: int = PALETTE) -> DataFrame:
    """One palette for a whole corpus, by distributed k-means over weighted colour cells."""
    cells = color_cells(pixels.withColumn("image_id", F.lit(0)), bits=8)
    ready = VectorAssembler(inputCols=["r", "g", "b"], outputCol="features").transform(cells).withColumn(
        "n", F.col("n").cast("double"))
    model = KMeans(k=k, seed=SEED, weightCol="n").fit(ready)
    rows = [(_hex(c),) for c in model.clusterCenters()]
    return pixels.sparkSession.createDataFrame(rows, "hex string")

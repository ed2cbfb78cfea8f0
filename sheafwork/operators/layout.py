"""Blocks and tables of a page: reading order, selection, and grids rebuilt from cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions.text import stem_of, strip
from sheafwork.operators.fusion import TEXT_BLOCK_TYPES

DENSITY_PAGES = 3
DENSITY_CHARACTERS = 50


def sort_blocks(blocks: DataFrame) -> DataFrame:
    """Reading order within each document: page, top, left; missing ids become the position.

    Positions are counted within a page first and shifted by the blocks on earlier pages, so the unit of sorting is a
    page and not a document.
    """
    page = F.coalesce("page", F.lit(0))
    blocks = blocks.withColumn("page", page)
    order = ["top", "left", *[c for c in ("block_id", "seq") if c in blocks.columns]]
    on_page = Window.partitionBy("doc_id", "page").orderBy(*order)
    sizes = blocks.groupBy("doc_id", "page").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("doc_id", "page", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    placed = blocks.withColumn("_at", F.row_number().over(on_page) - 1).join(shift, ["doc_id", "page"])
    position = (F.col("_at") + F.col("_shift")).cast("bigint")
    return placed.withColumn("position", position).withColumn(
        "block_id", F.coalesce("block_id", "position")).drop("_at", "_shift")


def text_density_gate(pages: DataFrame) -> DataFrame:
    """Per document NATIVE or SCAN, from the mean characters of its first three pages (0-based ``page``).

    The page count a document has may be below three; only pages that exist are averaged.
    """
    first = pages.filter((F.col("page") >= 0) & (F.col("page") < DENSITY_PAGES))
    mean = F.avg(F.length(F.coalesce("text", F.lit(""))))
    return first.groupBy("doc_id").agg(mean.alias("mean_chars")).withColumn(
        "kind", F.when(F.col("mean_chars") < DENSITY_CHARACTERS, "SCAN").otherwise("NATIVE"))


def select_text_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Text-like blocks; a document with none gets one full-page block per page.

    ``blocks``: doc_id, block_id, page, type, bbox. ``pages``: doc_id, page, width, height.
    """
    textual = blocks.filter(F.lower("type").isin(*TEXT_BLOCK_TYPES)).select("doc_id", "block_id", "page", "type", "bbox")
    bare = pages.join(textual.select("doc_id"), "doc_id", "left_anti")
    whole = bare.select(
        "doc_id", F.col("page").alias("block_id"), "page", F.lit("text").alias("type"),
        F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.col("width").cast("bigint"),
                F.col("height").cast("bigint")).alias("bbox"),
    )
    return textual.unionByName(whole)


def rebuild_table_grid(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells with spans → every position of the dense grid with its text.

    ``cells``: keys, row_no, col_no, row_span, col_span, txt, seq (order of overlapping cells). Texts that overlap are
    joined by a space in ``seq`` order, uncovered positions are empty. Each table's grid is generated from its own
    extent, not by crossing tables with positions.
    """
    spans = cells.withColumns({
        "row_span": F.when(F.coalesce("row_span", F.lit(0)) == 0, 1).otherwise(F.col("row_span")),
        "col_span": F.when(F.coalesce("col_span", F.lit(0)) == 0, 1).otherwise(F.col("col_span")),
        "txt": strip(F.coalesce("txt", F.lit(""))),
    })
    rows = F.sequence(F.col("row_no"), F.col("row_no") + F.col("row_span") - 1)
    cols = F.sequence(F.col("col_no"), F.col("col_no") + F.col("col_span") - 1)
    covered = spans.select(*keys, F.explode(rows).alias("r"), cols.alias("cols"), "seq", "col_no", "txt").select(
        *keys, "r", F.explode("cols").alias("c"), "seq", "col_no", "txt")
    written = covered.filter("txt <> ''").select(*keys, "r", "c", F.struct("seq", "col_no", "txt").alias("part"))
    extent = spans.groupBy(*keys).agg(
        F.max(F.col("row_no") + F.col("row_span")).alias("_rows"), F.max(F.col("col_no") + F.col("col_span"))
        .alias("_cols"))
    grid = extent.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("r"), "_cols").select(
        *keys, "r", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("c"))
    # empty positions and texts meet in one aggregation; a position's missing part is not collected
    empty = grid.withColumn("part", F.lit(None).cast(written.schema["part"].dataType))
    texts = written.unionByName(empty).groupBy(*keys, "r", "c").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return texts.select(*keys, "r", "c", F.array_join(F.transform("parts", lambda p: p["txt"]), " ").alias("text"))


def table_identity(path: Column, page: Column, index: Column) -> Column:
    """``{stem}_{sha1 of path, 8 digits}_pNN_tNN``."""
    return F.concat(stem_of(path), F.lit("_"), F.substring(F.sha1(path), 1, 8),
                    F.format_string("_p%02d_t%02d", page, index))


def number_tables(blocks: DataFrame) -> DataFrame:
    """Table blocks numbered within their page, with their identifier. ``blocks``: doc_id, path, page, block_id, type."""
    on_page = Window.partitionBy("doc_id", "page").orderBy("block_id")
    numbered = blocks.filter(F.col("type") == "table").withColumn(
        "table_index", (F.row_number().over(on_page) - 1).cast("bigint"))
    return numbered.withColumn("table_id", table_identity(F.col("path"), F.col("page"), F.col("table_index")))

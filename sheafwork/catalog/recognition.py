"""Fusion of engine outputs, layout and table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.operators import fusion, layout



SQL_CLEAN = """, clean as (select doc_id, block_id, trim(text_a, chr(9) || chr(10) || chr(13) || ' ') as a, conf_a as ca,
    trim(text_b, chr(9) || chr(10) || chr(13) || ' ') as b, conf_b as cb from blocks)"""
_PATTERNS = (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\b",
             r"(?i)\b[A-Z]\d{7}[A-Z]\b", r"(?i)\b(?:invoice|factura)[- ]?\d+\b")


def sql_pattern_score(column: str) -> str:
    return "(" + " + ".join(f"regexp_matches({column}, '{p}')::int" for p in _PATTERNS) + ")"


def sql_fuse(both_text: str, both_conf: str) -> str:
    return f"""select doc_id, block_id, md5(case when a <> '' and b = '' then a when b <> '' and a = '' then b
        when a = '' and b = '' then '' else {both_text} end) as text_md5,
      round(case when a <> '' and b = '' then ca when b <> '' and a = '' then cb when a = '' and b = '' then 0.0
        else {both_conf} end, 6) as confidence"""


def sides() -> list:
    return [F.col(c) for c in ("text_a", "conf_a", "text_b", "conf_b")]


def fused(df: DataFrame, column: str = "fused") -> DataFrame:
    return df.select("doc_id", "block_id", F.md5(F.col(f"{column}.text")).alias("text_md5"),
                     F.round(F.col(f"{column}.confidence"), 6).alias("confidence"))


@query("fuse_confidence_vote", ctes("blocks") + SQL_CLEAN + f"""
    , scored as (select *, {sql_pattern_score('a')} as pa, {sql_pattern_score('b')} as pb,
        length(regexp_replace(a, '[^A-Za-z0-9]', '', 'g')) as na, length(regexp_replace(b, '[^A-Za-z0-9]', '', 'g'))
        as nb from clean),
      chosen as (select *, case when ca >= 0.6 then 'p' when cb >= ca + 0.05 then 's' when pa > pb then 'P'
        when pb > pa then 'S' when abs(ca - cb) <= 0.05 and na > nb then 'P' when abs(ca - cb) <= 0.05 and nb > na
        then 'S' when ca >= cb then 'p' else 's' end as k from scored)
    """ + sql_fuse("case when k in ('p', 'P') then a else b end",
                   "case k when 'p' then ca when 's' then cb else greatest(ca, cb) end") + " from chosen")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "blocks")
    return fused(blocks.withColumn("fused", fusion.fuse_confidence_vote(*sides())))


@query("fuse_cascade", ctes("blocks") + SQL_CLEAN + sql_fuse(
    "case when ca >= 0.6 then a else b end", "case when ca >= 0.6 then ca else cb end") + " from clean")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "blocks")
    return fused(blocks.withColumn("fused", fusion.fuse_cascade(*sides())))


@query("fuse_similarity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fused(fusion.fuse_similarity(frame(spark, sf, "blocks"), "first", "second", ("second", "first")))


@query("pattern_score", ctes("blocks", "invoices") + f"""
    select doc_id, block_id, {sql_pattern_score('text_a')} as score from blocks
    union all select -1 - o_orderkey, 0, {sql_pattern_score('text')} from invoices""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "blocks").select("doc_id", "block_id", F.col("text_a").alias("text"))
    invoices = frame(spark, sf, "invoices").select(
        (-1 - F.col("o_orderkey")).alias("doc_id"), F.lit(0).cast("bigint").alias("block_id"), "text")
    return blocks.unionByName(invoices).select("doc_id", "block_id", fusion.pattern_score(F.col("text")).alias("score"))


@query("alnum_score", ctes("blocks") + """
    select doc_id, block_id, cast(length(regexp_replace(text_b, '[^A-Za-z0-9]', '', 'g')) as bigint) as score
    from blocks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    score = fusion.alnum_score(F.col("text_b")).cast("bigint")
    return frame(spark, sf, "blocks").select("doc_id", "block_id", score.alias("score"))


@query("recheck_selection", ctes("blocks") + """
    select doc_id, block_id, conf_a as confidence from blocks where conf_a < 0.5""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "blocks").select("doc_id", "block_id", F.col("conf_a").alias("confidence"))
    return fusion.recheck_selection(blocks, 0.5)


@query("engine_cascade", ctes("blocks") + """
    select doc_id, block_id, md5(coalesce(nullif(trim(case when block_id % 4 = 0 then '  ' else text_a end,
        chr(9) || chr(10) || chr(13) || ' '), ''), nullif(trim(text_b, chr(9) || chr(10) || chr(13) || ' '), ''),
      nullif('page ' || page, ''), '')) as text_md5 from blocks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.col("block_id") % 4 == 0, "  ").otherwise(F.col("text_a"))
    third = F.concat(F.lit("page "), "page")
    return frame(spark, sf, "blocks").select(
        "doc_id", "block_id", F.md5(fusion.engine_cascade(first, F.col("text_b"), third)).alias("text_md5"))


@query("page_engine_choice", ctes("blocks") + """
    select doc_id, block_id, md5(case when u then text_b else text_a end) as text_md5,
      case when u then conf_b else conf_a end as confidence
    from (select *, conf_a < 0.6 and text_b <> '' and conf_b > conf_a as u from blocks)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fused(frame(spark, sf, "blocks").withColumn("fused", fusion.page_engine_choice(*sides())))


@query("pair_engines", ctes("blocks") + """
    select doc_id, block_id, md5(text_a) as md5_a, conf_a, md5(text_b) as md5_b, conf_b from blocks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "blocks")
    long = [blocks.select("doc_id", "block_id", F.lit(e).alias("engine"), F.col(f"text_{e}").alias("text"),
                          F.col(f"conf_{e}").alias("confidence")) for e in "ab"]
    paired = fusion.pair_engines(long[0].unionByName(long[1]), "a", "b")
    return paired.select("doc_id", "block_id", F.md5("text_a").alias("md5_a"), "conf_a", F.md5("text_b").alias("md5_b"),
                         "conf_b")


PLACED = """, placed as (select l_orderkey as doc_id, cast(l_linenumber // 3 as bigint) as page,
      cast(l_quantity as bigint) as top, l_suppkey as "left", concat(l_partkey, '_', l_linenumber, '_',
        l_extendedprice) as seq, case when l_partkey % 3 = 0 then null else l_partkey end as block_id from lineitem)"""


@query("sort_blocks", "with x as (select 1)" + PLACED + """
    select doc_id, page, seq, position, coalesce(block_id, position) as block_id
    from (select *, row_number() over (partition by doc_id order by page, top, "left", block_id nulls first, seq) - 1
      as position from placed)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    placed = frame(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.expr("cast(l_linenumber div 3 as bigint)").alias("page"),
        F.col("l_quantity").cast("bigint").alias("top"), F.col("l_suppkey").alias("left"),
        F.concat_ws("_", "l_partkey", "l_linenumber", "l_extendedprice").alias("seq"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("block_id"))
    return layout.sort_blocks(placed).select("doc_id", "page", "seq", "position", "block_id")


@query("text_density_gate", ctes("blocks") + """
    select doc_id, round(avg(length(text_a)), 6) as mean_chars, case when avg(length(text_a)) < 50 then 'SCAN' else
      'NATIVE' end as kind from blocks where block_id < 3 group by doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = frame(spark, sf, "blocks").select("doc_id", F.col("block_id").alias("page"), F.col("text_a").alias("text"))
    return layout.text_density_gate(pages).withColumn("mean_chars", F.round("mean_chars", 6))


@query("select_text_blocks", ctes("blocks") + """, typed as (select doc_id, block_id, page, case when doc_id % 3 = 0
        then 'figure' when block_id % 4 = 0 then 'Title' when block_id % 4 = 1 then 'table' else 'text' end as type,
      concat('0,', block_id, ',600,', block_id + 1) as bbox from blocks),
      textual as (select * from typed where lower(type) in ('text', 'title', 'other'))
    select * from textual union all
    select distinct doc_id, page, page, 'text', '0,0,600,800' from blocks
    where doc_id not in (select doc_id from textual)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("block_id") % 4
    type_ = F.when(F.col("doc_id") % 3 == 0, "figure").when(key == 0, "Title").when(key == 1, "table").otherwise("text")
    big = lambda n: F.lit(n).cast("bigint")
    blocks = frame(spark, sf, "blocks").select(
        "doc_id", "block_id", "page", type_.alias("type"),
        F.array(big(0), F.col("block_id"), big(600), F.col("block_id") + 1).alias("bbox"))
    pages = blocks.select("doc_id", "page").distinct().withColumns({"width": F.lit(600), "height": F.lit(800)})
    return layout.select_text_blocks(blocks, pages).withColumn("bbox", F.array_join("bbox", ","))


@query("rebuild_table_grid", ctes("cells") + """
    , covered as (select doc_id, r, unnest(generate_series(col_no, col_no + col_span - 1)) as c, seq, col_no, txt
      from (select *, unnest(generate_series(row_no, row_no + row_span - 1)) as r from cells)),
    texts as (select doc_id, r, c, string_agg(txt, ' ' order by seq, col_no, txt) as text from covered where txt <> ''
      group by all),
    grid as (select doc_id, r, unnest(generate_series(0, cols - 1)) as c from (select doc_id, cols,
      unnest(generate_series(0, nrows - 1)) as r from (select doc_id, max(row_no + row_span) as nrows,
        max(col_no + col_span) as cols from cells group by doc_id)))
    select doc_id, r, c, coalesce(text, '') as text from grid left join texts using (doc_id, r, c)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return layout.rebuild_table_grid(frame(spark, sf, "cells"), "doc_id")


@query("table_identity", """
    select doc_id, page, block_id, table_index, concat('doc_', doc_id, '_', substr(sha1(path), 1, 8),
      printf('_p%02d_t%02d', page, table_index)) as table_id
    from (select *, row_number() over (partition by doc_id, page order by block_id) - 1 as table_index
      from (select user_id as doc_id, concat('/in/doc_', user_id, '.pdf') as path, event_id % 5 as page,
        event_id as block_id from events where event_type = 'view'))""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.concat(F.lit("/in/doc_"), "user_id", F.lit(".pdf")).alias("path"),
        (F.col("event_id") % 5).alias("page"), F.col("event_id").alias("block_id"),
        F.when(F.col("event_type") == "view", "table").otherwise("text").alias("type"))
    return layout.number_tables(blocks).select("doc_id", "page", "block_id", "table_index", "table_id")

"""Registry listings, joins, counts and top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.operators import linking, listing, reports

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(column: str | Column = "datetime") -> Column:
    return F.date_format(column, STAMP)


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns or ("datetime",):
        df = df.withColumn(column, stamp(column))
    return df


def joined_tags(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", "|"))


# A JSON array of strings, or nothing: the SQL twin of the tag decoding.
SQL_TAGS = ("coalesce(array_to_string(cast(case when json_valid(tags) then tags else '[]' end as json)::varchar[], '|'),"
            " '')")
SQL_STAMP = "strftime(datetime, '%Y-%m-%d %H:%M:%S') as datetime"
DOC_COLUMNS = ("doc_id", "filename", "path", "type", "status", "datetime", "duration", "error_message")
SQL_DOC = f"doc_id, filename, path, type, status, {SQL_STAMP}, duration, error_message"


@query("list_documents", ctes("docs") + f"""
    select {SQL_DOC} from docs where status = 'OK' and (filename ilike '%doc_1%' or type ilike '%doc_1%')
    order by docs.datetime desc, doc_id desc limit 20 offset 40""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    page = listing.list_documents(frame(spark, sf, "docs"), status="OK", search="DOC_1", page=3)
    return stamped(page.select(*DOC_COLUMNS))


@query("list_documents_pages", ctes("docs") + """
    select count(*) as total, greatest(1, cast(ceil(count(*) / 20.0) as bigint)) as pages from docs
    where type = 'contract' and (filename ilike '%7%' or type ilike '%7%')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return listing.page_count(frame(spark, sf, "docs"), type_="contract", search="7")


@query("keyword_documents", ctes("docs", "texts") + f"""
    select {SQL_DOC} from docs left join texts on doc_id = id_doc
    where filename ilike '%ation%' or text ilike '%ation%' order by docs.datetime desc, doc_id desc limit 100""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = listing.keyword_documents(frame(spark, sf, "docs"), frame(spark, sf, "texts"), "ATION")
    return stamped(found.select(*DOC_COLUMNS))


@query("verification_queue", ctes("docs", "texts") + f"""
    select doc_id, filename, {SQL_STAMP}, confidence, type from docs left join texts on doc_id = id_doc
    where workflow_state = 'pending'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(listing.verification_queue(frame(spark, sf, "docs"), frame(spark, sf, "texts")))


@query("active_work", ctes("docs") + """
    select concat('DOC-', doc_id) as id, concat('Procesando: ', filename) as name,
      concat('Tipo: ', coalesce(nullif(type, ''), 'Detectando...')) as args, 'active' as status,
      cast(50 as bigint) as progress
    from docs where status = 'processing' order by doc_id limit 50""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return listing.active_work(frame(spark, sf, "docs"))


@query("gallery_recent", ctes("docs") + f"""
    select doc_id, filename, path, cast(0.0 as double) as score, {SQL_STAMP}, {SQL_TAGS} as tags
    from (select * from docs order by doc_id desc limit 50) docs where lower(path) like '%.png'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return joined_tags(stamped(listing.gallery_recent(frame(spark, sf, "docs"), 50)))


def providers(spark: SparkSession, sf: str) -> DataFrame:
    nation = frame(spark, sf, "nation")
    return frame(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("canonical_name"),
        F.array(F.concat(F.lit("Prov "), "s_suppkey"), F.upper("n_name")).alias("aliases"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("B"), "s_suppkey")).alias("vat_number"),
        F.col("n_name").alias("category"),
    )


@query("provider_lookup", """
    select s_suppkey as id, s_name as name, case when s_suppkey % 2 = 0 then concat('B', s_suppkey) else '' end as vat,
      n_name as category from supplier join nation on s_nationkey = n_nationkey
    where contains(lower(s_name), 'v 1') or contains(lower(concat('Prov ', s_suppkey)), 'v 1')
      or contains(lower(n_name), 'v 1') order by s_suppkey limit 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return listing.provider_lookup(providers(spark, sf), "V 1")


@query("map_language", """
    select doc_id, coalesce(case lower(trim(code)) when 'spa' then 'es' when 'esp' then 'es' when 'spanish' then 'es'
      when 'eng' then 'en' when 'english' then 'en' when '' then 'en' else lower(trim(code)) end, 'en') as language
    from (select doc_id, case doc_id % 6 when 0 then ' SPA' when 1 then 'english' when 2 then '' when 3 then 'Esp'
      when 4 then null else lang end as code from documents)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id") % 6
    code = F.when(key == 0, " SPA").when(key == 1, "english").when(key == 2, "").when(key == 3, "Esp").when(
        key == 4, F.lit(None).cast("string")).otherwise(F.col("lang"))
    return frame(spark, sf, "documents").select("doc_id", listing.map_language(code).alias("language"))


@query("normalise_layout_label", """
    select block, case block when 'header' then 'title' when 'footer' then 'other' when 'caption' then 'text'
      when 'list' then 'text' when 'figure_caption' then 'figure' when 'equation' then 'other'
      when 'text' then 'text' when 'table' then 'table' when 'seal' then 'seal' when 'signature' then 'signature'
      when 'figure' then 'figure' when 'title' then 'title' else 'other' end as label, n
    from (select ['text','header','footer','caption','list','figure_caption','equation','seal','click','table',
        'figure','signature','title'][1 + (event_id % 13)] as block, count(*) as n from events group by all)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    labels = ["text", "header", "footer", "caption", "list", "figure_caption", "equation", "seal", "click", "table",
              "figure", "signature", "title"]
    block = F.get(F.array(*[F.lit(x) for x in labels]), (F.col("event_id") % 13).cast("int"))
    counts = frame(spark, sf, "events").groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    return counts.withColumn("label", listing.normalise_layout_label(F.col("block")))


@query("normalise_bbox", """
    with p as (select vec_id, cast(embedding[1] * 400 as double) as a, cast(embedding[2] * 400 as double) as b,
        cast(embedding[3] * 400 as double) as c, cast(embedding[4] * 400 as double) as d,
        cast(embedding[5] * 400 as double) as e, cast(embedding[6] * 400 as double) as f,
        cast(embedding[7] * 400 as double) as g, cast(embedding[8] * 400 as double) as h from embeddings)
    select vec_id, case vec_id % 3 when 0 then concat_ws(',', cast(round_even(a, 0) as int), cast(round_even(b, 0) as
        int), cast(round_even(c, 0) as int), cast(round_even(d, 0) as int))
      when 1 then concat_ws(',', cast(round_even(least(a, c, e, g), 0) as int), cast(round_even(least(b, d, f, h), 0)
        as int), cast(round_even(greatest(a, c, e, g), 0) as int), cast(round_even(greatest(b, d, f, h), 0) as int))
      end as bbox from p""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("vec_id") % 3 == 0, 4).when(F.col("vec_id") % 3 == 1, 8).otherwise(5)
    numbers = F.transform(F.slice("embedding", F.lit(1), size), lambda x: (x * F.lit(400).cast("float")).cast("double"))
    boxes = frame(spark, sf, "embeddings").select("vec_id", listing.normalise_bbox(numbers).alias("box"))
    return boxes.select("vec_id", F.when(F.col("box").isNotNull(), F.array_join("box", ",")).alias("bbox"))


@query("visual_kind", ctes("docs") + """
    select case when lower(filename) like '%.png' then 'image' when lower(filename) like '%.pdf' then 'pdf'
      else 'other' end as kind, count(*) as n from docs group by all""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kind = listing.visual_kind(F.col("filename"))
    return frame(spark, sf, "docs").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("parse_json_columns", """
    select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k from events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = listing.parse_json(F.col("props"), "struct<k: bigint>")["k"]
    return frame(spark, sf, "events").select("event_id", F.coalesce(k, F.lit(-1).cast("bigint")).alias("k"))


@query("document_detail", ctes("docs", "texts") + f"""
    select {SQL_DOC}, {SQL_TAGS} as tags, md5(text) as text_md5, language, confidence
    from docs left join texts on doc_id = id_doc""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    detail = linking.document_detail(frame(spark, sf, "docs"), frame(spark, sf, "texts"))
    return joined_tags(stamped(detail.select(*DOC_COLUMNS, "tags", F.md5("text").alias("text_md5"), "language",
                                             "confidence")))


def texts_with_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose documents have tables: one per parity, named after the document."""
    table = lambda n: F.struct(F.concat(F.lit(f"/out/t{n}_"), "id_doc", F.lit(".csv")).alias("csv_path"))
    tables = F.when(F.col("id_doc") % 4 == 0, F.array(table(0), table(1))).when(
        F.col("id_doc") % 4 == 1, F.array(table(0)))
    return frame(spark, sf, "texts").withColumn("tables", tables)


@query("recent_tables", ctes("docs", "texts") + f"""
    select doc_id, filename, {SQL_STAMP}, cast(i as bigint) as index,
      concat('/out/t', i, '_', doc_id, '.csv') as csv_path
    from (select * from docs join texts on doc_id = id_doc where id_doc % 4 in (0, 1)
      order by docs.datetime desc, doc_id desc limit 10) docs, (values (0), (1)) v(i) where i = 0 or doc_id % 4 = 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    tables = linking.recent_tables(frame(spark, sf, "docs"), texts_with_tables(spark, sf))
    return stamped(tables.select("doc_id", "filename", "datetime", "index", F.col("table.csv_path").alias("csv_path")))


@query("indexable_texts", ctes("docs", "texts") + """
    select doc_id, filename, md5(text) as text_md5 from docs join texts on doc_id = id_doc where text is not null""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    usable = linking.indexable_texts(frame(spark, sf, "docs"), frame(spark, sf, "texts"))
    return usable.select("doc_id", "filename", F.md5("text").alias("text_md5"))


@query("ocr_coverage", ctes("docs", "texts") + """
    select doc_id, filename, id_doc is not null as has_text from docs left join texts on doc_id = id_doc""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    covered, bare = linking.ocr_coverage(frame(spark, sf, "docs").select("doc_id", "filename"),
                                         frame(spark, sf, "texts"))
    return covered.withColumn("has_text", F.lit(True)).unionByName(bare.withColumn("has_text", F.lit(False)))


@query("select_by_ids", ctes("docs") + """
    select doc_id, filename from docs where doc_id in (select o_custkey from orders where o_orderstatus = 'P')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wanted = frame(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return linking.select_by_ids(frame(spark, sf, "docs").select("doc_id", "filename"), wanted)


@query("enrich_hits", ctes("docs") + f"""
    select doc_id, filename, path, value as score, {SQL_TAGS} as tags
    from (select concat('/inbox/', event_id % 7, '/doc_', event_id, '.pdf') as hit, value from events) h
    join docs on hit = path where hit <> '/inbox/0/doc_0.pdf'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/inbox/"), F.col("event_id") % 7, F.lit("/doc_"), "event_id", F.lit(".pdf"))
    hits = frame(spark, sf, "events").select(path.alias("path"), F.col("value").alias("score"))
    return joined_tags(linking.enrich_hits(hits, frame(spark, sf, "docs"), "/inbox/0/doc_0.pdf"))


@query("merge_block_results", ctes("blocks") + """
    select doc_id, block_id, page, case when block_id % 3 <> 1 then text_a else '' end as text,
      case when block_id % 3 <> 1 then conf_a else 0.0 end as confidence from blocks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "blocks")
    results = blocks.filter("block_id % 3 <> 1").select(
        "doc_id", "block_id", F.col("text_a").alias("text"), F.col("conf_a").alias("confidence"))
    return linking.merge_block_results(blocks.select("doc_id", "block_id", "page"), results)


@query("match_vendor_fuzzy", ctes("names") + """
    select name_id, name, case when name in ('Amazon', 'amzn', 'Amazon Mkts') or trim(name) = 'AWS' then 'Amazon'
      when name in ('leroymerlim', 'Leroy  Merlin', 'L Merlin', 'Leroy Merlin', 'leroy merlyn') then 'Leroy Merlin'
      when name in ('IKEA Iberica', 'Ikea Ibérica') then 'IKEA' else name end as vendor from names""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    names = frame(spark, sf, "names")
    return names.select("name_id", "name", linking.match_vendor_fuzzy(F.col("name")).alias("vendor"))


@query("tag_vendors", ctes("letters") + """
    select doc_id, concat_ws('|',
      case when contains(t, 'amazon') or contains(t, 'amzn') or contains(t, 'aws') then 'Vendor: Amazon' end,
      case when contains(t, 'leroy') or contains(t, 'l. merlin') then 'Vendor: Leroy Merlin' end,
      case when contains(t, 'ikea') then 'Vendor: IKEA' end) as tags
    from (select doc_id, lower(text) as t from letters)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    letters = frame(spark, sf, "letters")
    return letters.select("doc_id", F.array_join(linking.vendor_tags(F.col("text")), "|").alias("tags"))


@query("exact_duplicates", """
    select doc_id, md5_hash, first_id from (select doc_id, md5(text) as md5_hash,
      min(doc_id) over (partition by md5(text)) as first_id from documents) where doc_id <> first_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = frame(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5_hash"))
    return linking.exact_duplicates(docs)


@query("corpus_overview", ctes("docs") + """
    select count(*) as total, count(*) filter (workflow_state = 'pending') as pending from docs""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.corpus_overview(frame(spark, sf, "docs"))


@query("status_counts", ctes("docs") + "select status, count(*) as n from docs group by status")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.status_counts(frame(spark, sf, "docs"))


@query("type_counts_top10", ctes("docs") + """
    select array_to_string(list_transform(regexp_extract_all(trim(type), '(\\p{L}+|\\P{L}+)'),
      lambda r: concat(upper(r[1]), lower(r[2:]))), '') as clean_type, count(*) as n
    from docs where type is not null group by all order by n desc, clean_type limit 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.type_counts(frame(spark, sf, "docs"))


@query("failure_reasons", ctes("docs") + """
    select error_message, count(*) as n from docs where status = 'FAILED' group by all""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failure_reasons(frame(spark, sf, "docs"))


@query("failed_samples", ctes("docs") + """
    select doc_id, filename, path from docs where status = 'FAILED' order by doc_id limit 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failed_samples(frame(spark, sf, "docs"))


SQL_METRICS = """
    select batch, ok_docs, failed_docs, case when ok_docs + failed_docs = 0 then 0.0 else spent / (ok_docs + failed_docs)
        end as avg_time,
      case when ok_docs + failed_docs = 0 then 0.0 else ok_docs / (ok_docs + failed_docs) * 100.0 end as reliability_pct
    from (select batch, count(*) filter (status = 'OK') as ok_docs, count(*) filter (status = 'FAILED') as failed_docs,
      sum(duration) as spent from records group by batch)"""


@query("batch_metrics", ctes("records") + f"""
    select strftime(batch, '%Y-%m-%d') as batch, ok_docs, failed_docs, round(avg_time, 6) as avg_time,
      round(reliability_pct, 6) as reliability_pct from ({SQL_METRICS})""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    metrics = reports.batch_metrics(frame(spark, sf, "records"), "batch")
    return metrics.select(F.date_format("batch", "yyyy-MM-dd").alias("batch"), "ok_docs", "failed_docs",
                          F.round("avg_time", 6).alias("avg_time"), F.round("reliability_pct", 6).alias("reliability_pct"))


@query("metrics_history", ctes("records") + f"""
    select strftime(batch, '%Y-%m-%d') as date, ok_docs as ok, failed_docs as failed, round(avg_time, 2) as avg_time,
      round(reliability_pct, 1) as reliability from ({SQL_METRICS}) order by batch desc limit 20""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    metrics = reports.batch_metrics(frame(spark, sf, "records"), "batch").withColumnRenamed("batch", "datetime")
    return listing.metrics_history(metrics).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("document_text_and_confidence", ctes("blocks") + """
    select doc_id, md5(trim(string_agg(text_a, chr(10) order by block_id), chr(10) || chr(9) || chr(13) || ' '))
      as text_md5, round(avg(conf_a), 6) as confidence, 'es' as language from blocks where text_a <> ''
    group by doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = frame(spark, sf, "blocks").select("doc_id", "block_id", "page", F.col("text_a").alias("text"),
                                               F.col("conf_a").alias("confidence"))
    whole = reports.document_text_and_confidence(blocks)
    return whole.select("doc_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"),
                        "language")


@query("store_reconciliation", ctes("docs", "texts") + """
    select 'documents' as "table", count(*) as count_a, count(*) filter (doc_id % 10 <> 3) as count_b,
      count(*) filter (doc_id % 10 = 3) as delta from docs
    union all select 'texts', count(*), count(*) filter (id_doc % 10 <> 3), count(*) filter (id_doc % 10 = 3)
    from texts""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs, texts = frame(spark, sf, "docs"), frame(spark, sf, "texts")
    return reports.store_reconciliation((docs, texts), (docs.filter("doc_id % 10 <> 3"), texts.filter("id_doc % 10 <> 3")))


@query("dominant_colors", ctes("pixels") + """
    select image_id, rank, hex, n from (select *, row_number() over (partition by image_id order by n desc, hex) as rank
      from (select image_id, printf('#%02x%02x%02x', r // 32 * 32, g // 32 * 32, b // 32 * 32) as hex, count(*) as n
        from pixels group by all)) where rank <= 5""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.dominant_colors(frame(spark, sf, "pixels"))


@query("auto_verify", ctes("docs", "texts") + """
    select doc_id, case when confidence >= 0.8 then 'OK' else status end as status,
      case when confidence >= 0.8 then 'verified' else workflow_state end as workflow_state,
      coalesce(confidence >= 0.8, false) as verified from docs left join texts on doc_id = id_doc""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    done = reports.auto_verify(frame(spark, sf, "docs"), frame(spark, sf, "texts"))
    return done.select("doc_id", "status", "workflow_state", "verified")


@query("auto_verify_tally", ctes("docs", "texts") + """
    select count(*) filter (coalesce(confidence, 0) >= 0.8) as verified,
      count(*) filter (coalesce(confidence, 0) < 0.8) as skipped from docs left join texts on doc_id = id_doc""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.auto_verify_tally(reports.auto_verify(frame(spark, sf, "docs"), frame(spark, sf, "texts")))


@query("page_confidence", ctes("blocks") + """
    select doc_id, round(avg(conf_a), 6) as confidence, max(conf_b) > 0.5 as handwritten from blocks group by doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = frame(spark, sf, "blocks").select("doc_id", F.col("conf_a").alias("confidence"),
                                              F.col("conf_b").alias("handwriting"))
    return reports.page_confidence(pages).withColumn("confidence", F.round("confidence", 6))


@query("recent_documents", ctes("docs") + f"""
    select {SQL_DOC} from docs order by docs.datetime desc, doc_id desc limit 100""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(listing.recent_documents(frame(spark, sf, "docs").select(*DOC_COLUMNS), 100))


@query("recent_logs", """
    select strftime(ts, '%Y-%m-%d %H:%M:%S') as datetime, event_type as event, props as detail,
      case when event_type = 'error' then 'ERROR' else 'INFO' end as level
    from events order by ts desc, event_id desc limit 100""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    logs = frame(spark, sf, "events").select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("datetime"), F.col("event_type").alias("event"),
        F.col("props").alias("detail"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"))
    return stamped(listing.recent_logs(logs))

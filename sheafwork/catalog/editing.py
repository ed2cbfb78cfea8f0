"""Edits, versions, histories and context packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.catalog.reading import SQL_STAMP, stamped
from sheafwork.operators import changes, conversation, linking, listing

PATCHES = """(select o_custkey as doc_id, case when o_custkey % 4 = 0 then concat('renamed_', o_custkey, '.pdf')
      when o_custkey % 4 = 1 then '' end as filename, case when o_custkey % 3 = 0 then 'Letter' end as type,
    case when o_custkey % 5 = 0 then 'OK' end as status, case when o_custkey % 7 = 0 then '["edited"]' end as tags,
    case when o_custkey % 2 = 0 then concat('text ', o_custkey) end as text, cast(null as string) as markdown,
    case when o_custkey % 6 = 0 then '2024-02-30' when o_custkey % 6 = 1 then '2024-02-03' end as date,
    case when o_custkey % 6 < 3 then cast(o_custkey as string) end as total, '' as supplier
  from (select distinct o_custkey from @orders@ where o_custkey % 3 <> 1))"""


def patches(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"select * from {PATCHES.replace('@orders@', f'parquet.`{sf}/orders.parquet`')}")


def editable_texts(spark: SparkSession, sf: str) -> DataFrame:
    data = F.when(F.col("id_doc") % 2 == 0, F.create_map(F.lit("date"), F.lit("old"), F.lit("note"), F.lit("n")))
    return frame(spark, sf, "texts").withColumns({"markdown_text": F.concat(F.lit("# "), "text"), "data": data})


SQL_PATCHES = f", patches as (select * from {PATCHES.replace('@orders@', 'orders')}), ok as (select * from patches " \
              "where date is null or try_strptime(date, '%Y-%m-%d') is not null)"


@query("apply_document_patch", ctes("docs") + SQL_PATCHES + """
    select doc_id, coalesce(nullif(ok.filename, ''), docs.filename) as filename, coalesce(ok.type, docs.type) as type,
      coalesce(ok.status, docs.status) as status, coalesce(ok.tags, docs.tags) as tags
    from docs left join ok using (doc_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, _ = changes.apply_document_patch(frame(spark, sf, "docs"), editable_texts(spark, sf), patches(spark, sf))
    return docs.select("doc_id", "filename", "type", "status", "tags")


@query("apply_document_patch_texts", ctes("texts") + SQL_PATCHES + """
    select id_doc, md5(coalesce(ok.text, texts.text)) as text_md5, md5(concat('# ', texts.text)) as markdown_md5,
      coalesce(ok.date, case when id_doc % 2 = 0 then 'old' end) as date, ok.total as total,
      case when id_doc % 2 = 0 then 'n' end as note from texts left join ok on id_doc = doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, texts, _ = changes.apply_document_patch(frame(spark, sf, "docs"), editable_texts(spark, sf), patches(spark, sf))
    return texts.select("id_doc", F.md5("text").alias("text_md5"), F.md5("markdown_text").alias("markdown_md5"),
                        *[F.element_at("data", k).alias(k) for k in ("date", "total", "note")])


@query("rejected_patches", "with x as (select 1)" + SQL_PATCHES + """
    select doc_id, date from patches where date is not null and try_strptime(date, '%Y-%m-%d') is null""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, _, bad = changes.apply_document_patch(frame(spark, sf, "docs"), editable_texts(spark, sf), patches(spark, sf))
    return bad.select("doc_id", "date")


@query("bulk_set", ctes("docs") + """
    select doc_id, case when doc_id in (select o_custkey from orders where o_orderstatus = 'P') then 'verified'
      else workflow_state end as workflow_state from docs""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ids = frame(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return changes.bulk_set(frame(spark, sf, "docs"), ids, "workflow_state", "verified").select(
        "doc_id", "workflow_state")


def structured(spark: SparkSession, sf: str) -> DataFrame:
    """Structured data of every document: a vendor field and two anomaly codes."""
    anomalies = F.array(F.lit("weekend_date"), F.concat(F.lit("code_"), F.col("id_doc") % 3))
    data = F.struct(F.struct(F.col("language").alias("vendor")).alias("fields"), anomalies.alias("anomalies"))
    return frame(spark, sf, "texts").select("id_doc", data.alias("structured_data"))


@query("replace_fields", ctes("texts") + """
    select id_doc, case when id_doc in (select o_custkey from orders) then concat('new ', id_doc) else language end as
      vendor, concat('weekend_date|code_', id_doc % 3) as anomalies from texts""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    edited = frame(spark, sf, "orders").select(F.col("o_custkey").alias("id_doc")).distinct()
    new = edited.select("id_doc", F.struct(F.concat(F.lit("new "), "id_doc").alias("vendor")).alias("fields"))
    done = changes.replace_fields(structured(spark, sf), new)
    return done.select("id_doc", F.col("structured_data.fields.vendor").alias("vendor"),
                       F.array_join("structured_data.anomalies", "|").alias("anomalies"))


@query("dismiss_anomaly", ctes("texts") + """
    select id_doc, concat_ws('|', 'weekend_date', case when id_doc % 3 <> 1 or id_doc not in (select o_custkey from
      orders) then concat('code_', id_doc % 3) end) as anomalies from texts""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = structured(spark, sf).select("id_doc", F.col("structured_data.anomalies").alias("anomalies"))
    gone = frame(spark, sf, "orders").select(F.col("o_custkey").alias("id_doc"), F.lit("code_1").alias("code"))
    return changes.dismiss_anomaly(texts, gone).withColumn("anomalies", F.array_join("anomalies", "|"))


@query("delete_cascade", ctes("docs", "texts") + """
    , gone as (select distinct o_custkey from orders where o_orderstatus = 'P')
    select 'documents' as "table", doc_id from docs where doc_id not in (select o_custkey from gone)
    union all select 'texts', id_doc from texts where id_doc not in (select o_custkey from gone)
    union all select 'embeddings', vec_id from embeddings where vec_id not in (select o_custkey from gone)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ids = frame(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    left = changes.delete_cascade({
        "documents": (frame(spark, sf, "docs"), "doc_id"), "texts": (frame(spark, sf, "texts"), "id_doc"),
        "embeddings": (frame(spark, sf, "embeddings"), "vec_id")}, ids)
    keys = {"documents": "doc_id", "texts": "id_doc", "embeddings": "vec_id"}
    parts = [left[t].select(F.lit(t).alias("table"), F.col(k).alias("doc_id")) for t, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(stored versions, new snapshots): events as edits of the document numbered like their user."""
    edits = frame(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.col("ts").alias(
        "created_at"), F.col("event_type").alias("change_reason"))
    stored = changes.next_version(spark.createDataFrame([], "doc_id bigint, version_number bigint"),
                                  edits.filter("event_id % 3 = 0"), "event_id")
    return stored, edits.filter("event_id % 3 <> 0")


SQL_VERSIONS = """with versions as (select user_id as doc_id, event_id, ts as datetime, event_type as change_reason,
    row_number() over (partition by user_id order by event_id % 3 > 0, event_id) as version_number from events)"""


@query("next_version", SQL_VERSIONS + """
    select doc_id, event_id, change_reason, version_number from versions where event_id % 3 <> 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    stored, new = versions(spark, sf)
    return changes.next_version(stored, new, "event_id").select("doc_id", "event_id", "change_reason", "version_number")


@query("version_history", SQL_VERSIONS + f"""
    select doc_id, version_number, {SQL_STAMP}, 'System' as created_by, change_reason from versions
    where event_id % 3 = 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    stored, _ = versions(spark, sf)
    history = listing.version_history(stored.withColumn("created_by", F.lit("System")))
    return stamped(history.withColumnRenamed("created_at", "datetime"))


def stored_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of every text with an even id, with a shortened text each."""
    texts = frame(spark, sf, "texts").filter("id_doc % 2 = 0")
    n = F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    return texts.select("*", n.alias("version_number")).select(
        F.col("id_doc").alias("doc_id"), "version_number",
        F.concat(F.lit("v"), "version_number", F.lit(" "), "language").alias("text_content"),
        F.lit("md").alias("markdown_content"), F.lit("{}").alias("structured_data"), F.lit("2024-01-01").alias(
            "created_at"), F.lit("System").alias("created_by"), F.lit("seed").alias("change_reason"))


@query("snapshot_version", ctes("docs", "texts") + """
    select doc_id, case when id_doc % 2 = 0 then 3 else 1 end as version_number, md5(text) as text_md5,
      'Manual Save' as change_reason from docs left join texts on doc_id = id_doc
    where doc_id in (select o_custkey from orders)
    union all select id_doc, v, md5(concat('v', v, ' ', language)), 'seed' from texts, (values (1), (2)) t(v)
    where id_doc % 2 = 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = frame(spark, sf, "texts").withColumns({"markdown_text": F.lit("md"), "structured_data": F.lit("{}")})
    detail = linking.document_detail(frame(spark, sf, "docs"), texts)
    ids = frame(spark, sf, "orders").select("o_custkey")
    shots = changes.snapshot_version(detail, stored_versions(spark, sf), ids, F.lit("2024-02-01"), "Manual Save",
                                     "System")
    return shots.select("doc_id", "version_number", F.md5("text_content").alias("text_md5"), "change_reason")


@query("restore_version", ctes("texts") + """
    select id_doc, md5(case when id_doc % 4 = 0 then concat('v1 ', language) else text end) as text_md5,
      case when id_doc % 4 = 0 then '{}' else '{"a":1}' end as structured_data from texts""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = frame(spark, sf, "texts").withColumns({"markdown_text": F.lit("x"), "structured_data": F.lit('{"a":1}')})
    stored = stored_versions(spark, sf)
    chosen = stored.filter("version_number = 1 and doc_id % 4 = 0").select("doc_id", "version_number")
    return changes.restore_version(texts, stored, chosen).select(
        "id_doc", F.md5("text").alias("text_md5"), "structured_data")


@query("append_rows", """
    select case when event_id % 4 = 0 then event_id + 1 else top + row_number() over (partition by event_id % 4 = 0
      order by event_id) end as log_id, event_type as event, event_id as source_id
    from events, (select max(event_id) + 1 as top from events where event_id % 4 = 0)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = frame(spark, sf, "events")
    table = events.filter("event_id % 4 = 0").select(
        (F.col("event_id") + 1).alias("log_id"), F.col("event_type").alias("event"), F.col("event_id").alias("source_id"))
    new = events.filter("event_id % 4 <> 0").select(F.col("event_type").alias("event"), F.col("event_id").alias("source_id"))
    return changes.append_rows(table, new, "log_id", "source_id")


@query("ensure_columns", """
    select doc_id, lang, cast(0 as bigint) as folder_id, 'new' as workflow_state from documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"lang": (T.StringType(), "xx"), "folder_id": (T.LongType(), 0), "workflow_state": (T.StringType(), "new")}
    return changes.ensure_columns(frame(spark, sf, "documents").select("doc_id", "lang"), wanted)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.md5("text").alias("content_md5"))


@query("session_history", """
    select conv_id as session_id, turn, role, md5(text) as content_md5 from conversations
    qualify row_number() over (partition by conv_id order by turn desc) <= 3""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.session_history(messages(spark, sf), limit=3)


SQL_HYBRID = ctes("docs", "texts") + """
    , visual as (select o_custkey as question_id, row_number() over (partition by o_custkey order by o_orderkey) as rank,
        o_orderkey as doc_id, o_totalprice as score from orders),
    textual as (select l_suppkey as question_id, row_number() over (partition by l_suppkey order by l_orderkey,
        l_linenumber, l_partkey, l_extendedprice) as rank, l_orderkey as doc_id from lineitem),
    hybrid as (select question_id, 0 as source_order, rank, doc_id, filename, substr(coalesce(text, ''), 1, 300) as
        snippet, score, 'visual' as type from visual join docs using (doc_id) left join texts on doc_id = id_doc
      union all select question_id, 1, rank, doc_id, filename, concat('hit ', rank), 1.0, 'text' from textual
        join docs using (doc_id))"""


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    docs = frame(spark, sf, "docs").select("doc_id", "filename")
    texts = frame(spark, sf, "texts").select(F.col("id_doc").alias("doc_id"), "text")
    orders = spark.sql(f"""select o_custkey as question_id, o_orderkey as doc_id, o_totalprice as score,
        row_number() over (partition by o_custkey order by o_orderkey) as rank from parquet.`{sf}/orders.parquet`""")
    lines = spark.sql(f"""select question_id, rank, doc_id, concat('hit ', rank) as snippet from (select l_suppkey as
        question_id, l_orderkey as doc_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber,
          l_partkey, l_extendedprice) as rank from parquet.`{sf}/lineitem.parquet`)""")
    return conversation.hybrid_results(orders.join(docs, "doc_id").join(texts, "doc_id", "left"),
                                       lines.join(docs, "doc_id"))


@query("hybrid_results", SQL_HYBRID + """
    select question_id, source_order, rank, doc_id, filename, md5(snippet) as snippet_md5, score, type from hybrid""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = hybrid(spark, sf).withColumn("snippet_md5", F.md5("snippet")).drop("snippet")
    return both.withColumns({c: F.col(c).cast("bigint") for c in ("source_order", "rank")})


@query("pack_context", SQL_HYBRID + """
    , entries as (select question_id, rank, concat('[ID: ', doc_id, ' Archivo: ', filename, ']:', chr(10), snippet,
        chr(10), chr(10)) as entry from hybrid where type = 'text'),
    sized as (select *, sum(length(entry)) over (partition by question_id order by rank) as size from entries)
    select question_id, count(*) as n_hits, md5(string_agg(entry, '' order by rank)) as context_md5 from sized
    where size <= 10000 group by question_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    packed = conversation.pack_context(hybrid(spark, sf).filter("type = 'text'"))
    return packed.select("question_id", "n_hits", F.md5("context").alias("context_md5"))

"""Sources, sinks, learning and the batch twins of the streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.catalog.reading import SQL_STAMP, stamp, stamped
from sheafwork.catalog.searching import SQL_POSTINGS
from sheafwork.functions.tokens import MARKED, PLAIN
from sheafwork.operators import learning
from sheafwork.sources import files, mail, sinks
from sheafwork.session import cut_lineage, shared_folder
from sheafwork.streaming import history, jobs


def file_rows(documents: DataFrame) -> DataFrame:
    """Documents as (path, content) rows: even ones UTF-8 text files, odd ones Latin-1, every fifth of unknown kind."""
    even = F.col("doc_id") % 2 == 0
    content = F.when(even, F.encode("text", "UTF-8")).otherwise(
        F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1"))
    name = F.concat(F.lit("/in/"), F.when(F.col("doc_id") % 11 == 0, ".hidden/").otherwise(""), "doc_id",
                    F.when(F.col("doc_id") % 5 == 0, ".dat").otherwise(".TXT"))
    return documents.select("doc_id", name.alias("path"), content.alias("content"))


@query("scan_corpus", """
    select doc_id from documents where doc_id % 11 <> 0 and doc_id % 5 <> 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return file_rows(frame(spark, sf, "documents")).filter(files.allowed(F.col("path"))).select("doc_id")


@query("stream_hot_folder", """
    select doc_id, md5(case when doc_id % 2 = 0 then text else regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') end)
      as text_md5 from documents where doc_id % 11 <> 0 and doc_id % 5 <> 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Runs the stream twice over the documents file: the second run finds nothing new."""
    schema = frame(spark, sf, "documents").schema
    folder = f"{shared_folder(spark)}/sheafwork-{uuid.uuid4().hex}"
    for _ in range(2):
        arriving = file_rows(spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet"))
        jobs.take_into(arriving, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    taken = spark.read.schema("doc_id bigint, path string, content binary").parquet(f"{folder}/store")
    return files.decode_text_files(taken).select("doc_id", F.md5("text").alias("text_md5"))


@query("hash_files", """
    select doc_id, md5(text) as md5, sha256(text) as sha256 from documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    md5 = files.hash_files(rows).withColumnRenamed("hash", "md5")
    return files.hash_files(md5, "sha256").select("doc_id", "md5", F.col("hash").alias("sha256"))


@query("decode_text_files", """
    select doc_id, md5(case when doc_id % 2 = 0 then text else regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') end)
      as text_md5, case when doc_id % 5 = 0 then 0.2 else 1.0 end::double as confidence from documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    decoded = files.decode_text_files(file_rows(frame(spark, sf, "documents")))
    return decoded.select("doc_id", F.md5("text").alias("text_md5"), "confidence")


HTML_TOKENS = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+"
SQL_ENTITIES = "t"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    SQL_ENTITIES = f"replace({SQL_ENTITIES}, '{_entity}', '{_char}')"


@query("html_corpus_to_text", f"""
    with tokens as (select page_id, unnest(regexp_extract_all(html, '{HTML_TOKENS}')) as t,
        generate_subscripts(regexp_extract_all(html, '{HTML_TOKENS}'), 1) as i from pages),
    data as (select page_id, i, trim(case when regexp_matches(t, '(?is)^<(script|style)') then regexp_extract(t,
          '(?is)^<[^>]*>(.*)</', 1) when starts_with(t, '<') then '' else {SQL_ENTITIES} end,
        chr(9) || chr(10) || chr(13) || ' ') as d from tokens),
    texts as (select page_id, coalesce(string_agg(d, ' ' order by i) filter (d <> ''), '') as text from data
      group by page_id)
    select page_id, length(text) as n_chars, md5(text) as text_md5 from texts""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = mail.html_corpus_to_text(frame(spark, sf, "pages"))
    return pages.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def mails(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as mail files: plain text, and for even turns a text file attached."""
    head = F.concat(F.lit("Subject: Turn "), "turn", F.lit(": of <"), "conv_id", F.lit(">\nFrom: "), "role", F.lit(
        "@example.com\nTo: desk@example.com\nMIME-Version: 1.0\n"))
    plain = F.concat(F.lit('Content-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'), "text",
                     F.lit("\n"))
    attached = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="=="\n\n--==\n'), plain,
        F.lit('--==\nContent-Type: text/csv\nContent-Disposition: attachment; filename="a?'), "turn",
        F.lit('.CSV"\n\nk,v\n--==\nContent-Type: text/x-log\nContent-Disposition: attachment; filename="b.log"\n\nx\n'),
        F.lit("--==--\n"))
    body = F.when(F.col("turn") % 2 == 0, attached).otherwise(plain)
    path = F.concat(F.lit("/mail/"), "conv_id", F.lit("_"), "turn", F.lit(".eml"))
    return frame(spark, sf, "conversations").select(
        path.alias("path"), F.encode(F.concat(head, body), "UTF-8").alias("content"))


@query("email_corpus_to_rows", """
    select concat('/mail/', conv_id, '_', turn, '.eml') as path, md5(concat('Subject: Turn ', turn, ': of <', conv_id,
      '>', chr(10), 'From: ', role, '@example.com', chr(10), 'To: desk@example.com', chr(10),
      trim(text, chr(10) || chr(13) || chr(9) || ' '))) as text_md5 from conversations""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mail.email_corpus_to_rows(mails(spark, sf)).select("path", F.md5("text").alias("text_md5"))


@query("email_attachments", """
    select concat('/mail/', conv_id, '_', turn, '.eml') as path, concat('Email_1700000000_',
      substr(concat('Turn ', turn, ' of ', conv_id), 1, 20), '_a', turn, '.CSV') as name, 'k,v' as content
    from conversations where turn % 2 = 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = mail.email_attachments(mails(spark, sf), F.lit(1_700_000_000))
    return found.select("path", "name", F.trim(F.decode("content", "UTF-8")).alias("content"))


@query("append_documents", ctes("docs", "texts") + f"""
    select row_number() over (order by doc_id % 2, doc_id) as doc_id, filename, {SQL_STAMP}, length(text) as n_chars
    from docs left join texts on doc_id = id_doc and text <> ''""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Appends the even documents to a new store, then the odd ones, and reads the store."""
    texts = frame(spark, sf, "texts").select(F.col("id_doc").alias("doc_id"), "text", "language",
                                             F.col("confidence").alias("text_confidence"))
    docs = frame(spark, sf, "docs").drop("confidence", "language", "text").join(texts, "doc_id", "left")
    rows = docs.withColumnsRenamed({"doc_id": "source_id", "text_confidence": "confidence"})
    store = f"{shared_folder(spark)}/sheafwork-{uuid.uuid4().hex}"
    for parity in (0, 1):
        sinks.append_documents(spark, rows.filter(F.col("source_id") % 2 == parity), store, "source_id")
    stored = spark.read.parquet(f"{store}/texts").select(F.col("id_doc").alias("doc_id"),
                                                         F.length("text").cast("bigint").alias("n_chars"))
    kept = spark.read.parquet(f"{store}/documents").join(stored, "doc_id", "left")
    return stamped(kept.select("doc_id", "filename", "datetime", "n_chars"))


@query("export_documents_csv", ctes("docs", "texts") + f"""
    select doc_id as id, filename, type, status, workflow_state, confidence, {SQL_STAMP}, path
    from docs left join texts on doc_id = id_doc""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    confidence = frame(spark, sf, "texts").select(F.col("id_doc").alias("doc_id"), "confidence")
    docs = frame(spark, sf, "docs").join(confidence, "doc_id", "left").withColumnRenamed("doc_id", "id")
    return stamped(sinks.export_frame(docs))


@query("export_side_outputs", """
    select concat('doc_', doc_id) as stem, lang as language, md5(case when doc_id % 3 > 0 then concat('# ', text) end)
      as markdown_md5 from documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    summaries = frame(spark, sf, "documents").select(
        F.concat(F.lit("/out/doc_"), "doc_id", F.lit(".pdf")).alias("path"), F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("# "), "text")).otherwise("").alias("markdown"))
    summary, markdown = sinks.side_outputs(summaries)
    return summary.join(markdown, "stem", "left").select("stem", "language", F.md5("markdown").alias("markdown_md5"))


@query("batch_summary_report", ctes("records") + "select filename, status, duration, type from records")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report_frame(frame(spark, sf, "records"))


# the languages of the texts have words of their own, so a trained classifier gives every text its own label
@query("train_text_classifier", ctes("texts") + """
    select lang as truth, lang as predicted, count(*) as n from texts join documents on doc_id = id_doc
    where length(documents.text) > 20 group by lang""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """How the trained classifier sees its own training texts: rows per true and predicted type."""
    docs = frame(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"))
    rows = cut_lineage(learning.training_rows(docs, frame(spark, sf, "texts").select("id_doc", "text")))
    model = learning.train_text_classifier(rows)
    seen = learning.predict_type(rows.withColumnRenamed("type", "truth"), model)
    return seen.groupBy("truth", F.col("type").alias("predicted")).agg(F.count("*").alias("n"))


@query("predict_type")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = frame(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"))
    texts = frame(spark, sf, "texts").select("id_doc", "text")
    model = learning.train_text_classifier(learning.training_rows(docs, texts))  # stores its rows once
    return learning.predict_type(texts, model).select("id_doc", "type", "tag")


@query("color_palette")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return learning.color_palette(frame(spark, sf, "pixels")).withColumn("share", F.round("share", 6))


@query("corpus_palette")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return learning.corpus_palette(frame(spark, sf, "pixels"))


SQL_CELLS = ctes("pixels") + """
    select image_id, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b, count(*) as n from pixels
    group by image_id, r // {width}, g // {width}, b // {width}"""


def cells_of(spark: SparkSession, sf: str, bits: int) -> DataFrame:
    cells = learning.color_cells(frame(spark, sf, "pixels"), bits)
    return cells.select("image_id", *[F.round(c, 6).alias(c) for c in "rgb"], "n")


@query("color_cells", SQL_CELLS.format(width=1))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cells_of(spark, sf, 8)


@query("color_cells_coarse", SQL_CELLS.format(width=4))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cells_of(spark, sf, 6)


def moment(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("stream_quiet_batches", """
    with gaps as (select user_id, ts, case when ts - lag(ts) over w <= interval 2 hour then 0 else 1 end as s from events
        window w as (partition by user_id order by ts)),
    numbered as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as b
      from gaps)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last,
      count(*) as n from numbered group by user_id, b""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    batches = jobs.quiet_batches(frame(spark, sf, "events"), "user_id", "ts", 2 * 3600)
    return batches.select("user_id", moment("first").alias("first"), moment("last").alias("last"), "n")


def streamed(spark: SparkSession, rows: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the stored rows has put out once it has taken all of them."""
    folder = f"{shared_folder(spark)}/sheafwork-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    out = transform(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("stream_quiet_batches_closed", """
    with gaps as (select user_id, ts, case when ts - lag(ts) over w <= interval 2 hour then 0 else 1 end as s from events
        window w as (partition by user_id order by ts)),
    numbered as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as b
      from gaps)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last,
      count(*) as n from numbered group by user_id, b having max(ts) + interval 2 hour <= (select max(ts) from events)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The stream itself: the batches that its watermark has closed."""
    rows = frame(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    closed = streamed(spark, rows, lambda s: jobs.stream_quiet_batches(s, "user_id", "ts", "2 hours", "0 seconds"))
    return closed.select("user_id", moment("first").alias("first"), moment("last").alias("last"), "n")


@query("stream_dedup_history", """
    with hashed as (select doc_id, case when doc_id % 17 > 0 then md5(text) end as md5_hash from documents)
    select doc_id, md5_hash from hashed where md5_hash is null
    union all select min(doc_id), md5_hash from hashed where md5_hash is not null and md5_hash in (select md5_hash from hashed
      where doc_id % 3 = 0 and md5_hash is not null) and doc_id % 3 = 0 group by md5_hash
    union all select min(doc_id), md5_hash from hashed where md5_hash is not null and md5_hash not in (select md5_hash from hashed
      where doc_id % 3 = 0 and md5_hash is not null) group by md5_hash""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document is in the store first; a stream of the others adds what is new."""
    hashed = frame(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 17 > 0, F.md5("text")).alias("md5_hash"))
    folder = f"{shared_folder(spark)}/sheafwork-{uuid.uuid4().hex}"
    schema = "doc_id bigint, md5_hash string"
    for part, name in ((hashed.filter("doc_id % 3 = 0"), "first"), (hashed.filter("doc_id % 3 <> 0"), "others")):
        part.write.parquet(f"{folder}/{name}")
        history.dedup_history(spark.readStream.schema(schema).parquet(f"{folder}/{name}"), f"{folder}/store",
                              f"{folder}/checkpoint-{name}").awaitTermination()
    return history.history(spark, f"{folder}/store", schema)


@query("stream_batch_metrics", ctes("records") + """
    select strftime(batch, '%Y-%m-%d 00:00:00') as start, ok_docs, failed_docs,
      round(case when ok_docs + failed_docs = 0 then 0 else spent / (ok_docs + failed_docs) end, 6) as avg_time,
      round(case when ok_docs + failed_docs = 0 then 0 else ok_docs / (ok_docs + failed_docs) * 100.0 end, 6)
        as reliability_pct
    from (select batch, count(*) filter (status = 'OK') as ok_docs, count(*) filter (status = 'FAILED') as failed_docs,
      sum(duration) as spent from records group by batch)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    metrics = jobs.windowed_metrics(frame(spark, sf, "records"))
    return metrics.select(stamp("start").alias("start"), "ok_docs", "failed_docs",
                          F.round("avg_time", 6).alias("avg_time"), F.round("reliability_pct", 6).alias("reliability_pct"))


@query("stream_dedup", """
    with hashed as (select doc_id, case when doc_id % 17 > 0 then md5(text) end as md5_hash from documents)
    select doc_id, md5_hash from hashed where doc_id % 3 <> 0 and (md5_hash is null or not exists (select 1 from hashed h
      where h.doc_id % 3 = 0 and h.md5_hash = hashed.md5_hash))
    qualify md5_hash is null or row_number() over (partition by md5_hash order by doc_id) = 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hashed = frame(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 17 > 0, F.md5("text")).alias("md5_hash"))
    return jobs.new_to_store(hashed.filter("doc_id % 3 <> 0"), hashed.filter("doc_id % 3 = 0")).select(
        "doc_id", "md5_hash")


SQL_OLD_TERMS = SQL_POSTINGS.replace("from texts", "from texts where id_doc % 4 <> 3 and id_doc % 7 <> 2")


@query("stream_index_upkeep", ctes("texts") + SQL_OLD_TERMS + f"""
    , edited as (select id_doc as doc_id, unnest(regexp_extract_all(translate(lower(concat('edited ', text)), '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')) as term from texts where id_doc % 4 = 3)
    select * from (select term, doc_id, 'text' as field, tf from postings
      union all select term, doc_id, 'text', count(*) from edited group by all
      union all select unnest(['f', cast(id_doc as string)]), id_doc, 'filename', 1 from texts where id_doc % 4 = 3)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = frame(spark, sf, "texts").select(F.col("id_doc").alias("doc_id"), F.lit(None).cast("string").alias("filename"),
                                             "text")
    stored = jobs.build_text_index(texts, stemmed=False)
    changed = texts.filter("doc_id % 4 = 3").select(
        "doc_id", F.concat(F.lit("f "), "doc_id").alias("filename"),
        F.concat(F.lit("edited "), "text").alias("text"))
    return jobs.updated_postings(stored, changed, texts.filter("doc_id % 4 <> 3 and doc_id % 7 = 2"), stemmed=False)


@query("quarantine_unfinished", """
    select distinct concat('/in/', user_id, '_', event_id % 50) as path from events where event_type <> 'error'
    except select concat('/in/', user_id, '_', event_id % 50) from events where event_type = 'error'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), "user_id", F.lit("_"), F.col("event_id") % 50)
    events = frame(spark, sf, "events").select(path.alias("path"), "event_type")
    return jobs.quarantine_unfinished(events.filter("event_type <> 'error'"), events.filter("event_type = 'error'")
                                      ).select("path")

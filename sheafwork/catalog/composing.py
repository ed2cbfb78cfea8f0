"""Operators composed end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork import pipeline
from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.catalog.describing import SQL_KEYWORDS
from sheafwork.catalog.extraction import AS_OF, SQL_DATES, SQL_LINES, SQL_TOTALS, SQL_VENDORS
from sheafwork.operators import fields

DAY = "2026-01-05"
#: Company suffixes removed where a word begins; DuckDB's own word boundary only knows ASCII.
SUFFIXES = "".join(
    f", v{n + 1} as (select id, regexp_replace(name, '(^|[^\\p{{L}}\\p{{N}}_]){p.removeprefix(chr(92) + 'b')}', '\\1', 'gi')"
    f" as name from v{n})" for n, p in enumerate(fields.LEGAL_SUFFIXES))
#: Invoices, running texts under negative ids, and files that are empty or hold white space only.
SQL_FILES = ctes("invoices") + """, files as (
    select o_orderkey as doc_id, case o_orderkey % 101 when 0 then '' when 1 then chr(10) || ' ' else text end as text
      from invoices
    union all select -1 - doc_id, text from documents)"""


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 101 == 0, "").when(key % 101 == 1, "\n ").otherwise(F.col("text"))
    invoices = frame(spark, sf, "invoices").select(key.alias("doc_id"), text.alias("text"))
    every = invoices.unionByName(frame(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    return every.select("doc_id", F.concat(F.lit("/in/scan "), "doc_id", F.lit(".txt")).alias("path"),
                        F.encode("text", "UTF-8").alias("content"))


@query("ingest_documents", SQL_FILES + """, good as (select * from files where regexp_replace(text, '\\s', '', 'g') <> '')"""
       + SQL_LINES.format(id="doc_id", src="good") + SQL_DATES + SQL_TOTALS + SQL_VENDORS
       + ", v0 as (select id, value as name from vendors)" + SUFFIXES + f"""
    , clean as (select id, trim(regexp_replace(name, '\\s+', ' ', 'g')) as name from v8),
    named as (select id, case when regexp_matches(name, '\\p{{Lu}}') and not regexp_matches(name, '[\\p{{Ll}}\\p{{Lt}}ªº]')
      then array_to_string(list_transform(regexp_extract_all(name, '(\\p{{L}}+|\\P{{L}}+)'),
        lambda r: concat(upper(r[1]), lower(r[2:]))), '') else name end as vendor from clean),
    copies as (select doc_id as id, min(doc_id) over (partition by md5(text)) as first_id from good),
    kinds as (select doc_id as id, coalesce(split_part(k, '~', 1), 'Unknown') as type, split_part(k, '~', 2) as keyword
      from (select doc_id, {SQL_KEYWORDS} as k from (select doc_id, lower(text) as t from good))),
    tagged as (select doc_id as id,
        case when regexp_matches(text, '(?i)PRJ-[A-Z0-9]+') then upper(regexp_extract(text, '(?i)PRJ-[A-Z0-9]+'))
          when regexp_matches(text, '(?i)H-\\d{{4}}') then upper(regexp_extract(text, '(?i)H-\\d{{4}}'))
          when regexp_matches(text, '(?i)PROYECTO\\s+[A-Z0-9]+') then
            replace(upper(regexp_extract(text, '(?i)PROYECTO\\s+[A-Z0-9]+')), ' ', '-') end as project,
        regexp_matches(lower(text), 'amazon|amzn|aws') as amazon, regexp_matches(lower(text), 'leroy|l\\. merlin') as leroy,
        contains(lower(text), 'ikea') as ikea from good),
    history as (select id, value, count(value) over w as n, avg(value) over w as mean, stddev_samp(value) over w as sd
      from totals left join named using (id)
      window w as (partition by vendor order by id rows between unbounded preceding and 1 preceding)),
    flagged as (select id, concat_ws('|', case when n >= 5 and sd > 0 and abs(value - mean) > 3 * sd then 'unusual_amount' end,
      case when n >= 5 and value > mean * 10 then 'very_large_amount' end,
      case when n >= 5 and value % 100 = 0 and value >= 1000 then 'suspicious_round_number' end) as odd from history)
    select good.doc_id, nullif(first_id, good.doc_id) as duplicate_of, kinds.type, keyword,
      concat_ws('|', 'Project: ' || project, case when amazon then 'Vendor: Amazon' end,
        case when leroy then 'Vendor: Leroy Merlin' end, case when ikea then 'Vendor: IKEA' end) as tags,
      dates.value as date, totals.value as total, named.vendor,
      concat_ws('|', case when dates.id is null then 'missing_date' end, case when totals.id is null then 'missing_total' end,
        case when named.id is null then 'missing_vendor' end,
        case when cast(dates.value as timestamp) > timestamp '{AS_OF}' + interval 7 day then 'future_date' end,
        case when isodow(cast(dates.value as timestamp)) >= 6 then 'weekend_date' end,
        case when cast(dates.value as timestamp) < timestamp '{AS_OF}' - interval 1825 day then 'very_old_date' end,
        nullif(odd, '')) as anomalies,
      concat(replace(concat_ws('_', '{DAY}', case kinds.type when 'Unknown' then 'Doc' else kinds.type end,
        coalesce(project, 'NoProject'), case when amazon then 'Amazon' when leroy then 'Leroy Merlin' when ikea then 'IKEA'
          else 'NoVendor' end, concat('scan ', good.doc_id)), ' ', '_'), '.txt') as new_name
    from good join copies on copies.id = good.doc_id join kinds on kinds.id = good.doc_id
    join tagged on tagged.id = good.doc_id left join dates on dates.id = good.doc_id
    left join totals on totals.id = good.doc_id left join named on named.id = good.doc_id
    left join flagged on flagged.id = good.doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents, _ = pipeline.ingest(arriving(spark, sf), F.lit(AS_OF), F.lit(DAY))
    return documents.drop("path").withColumns({c: F.array_join(c, "|") for c in ("tags", "anomalies")})


@query("ingest_rejects", SQL_FILES + """
    select doc_id, case when text = '' then 'empty file' else 'no text' end as reason from files
    where regexp_replace(text, '\\s', '', 'g') = ''""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.ingest(arriving(spark, sf), F.lit(AS_OF), F.lit(DAY))[1].select("doc_id", "reason")

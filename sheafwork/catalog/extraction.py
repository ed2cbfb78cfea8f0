"""Field extraction, normalisation and anomaly queries over the derived invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.functions import fields as fx
from sheafwork.functions.tables import register_functions
from sheafwork.functions.text import bind
from sheafwork.operators import fields as ops
from sheafwork.operators import listing
from sheafwork.session import cut_lineage

SQL_LINES = """, lines as (select {id} as id, line, pos - 1 as i, total from (select {id},
    unnest(str_split(text, chr(10))) as line, generate_subscripts(str_split(text, chr(10)), 1) as pos,
    len(str_split(text, chr(10))) as total from {src}))"""

SQL_DATES = """, raws as (
    select id, line, i, total, 0 as p, unnest(regexp_extract_all(line, '\\b(\\d{4})-(\\d{2})-(\\d{2})\\b')) as raw,
      generate_subscripts(regexp_extract_all(line, '\\b(\\d{4})-(\\d{2})-(\\d{2})\\b'), 1) as j from lines
    union all
    select id, line, i, total, 1, unnest(regexp_extract_all(line, '\\b(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})\\b')),
      generate_subscripts(regexp_extract_all(line, '\\b(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})\\b'), 1) from lines
    union all
    select id, line, i, total, 2, unnest(regexp_extract_all(line, '\\b(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})\\b')),
      generate_subscripts(regexp_extract_all(line, '\\b(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})\\b'), 1) from lines
    union all
    select id, line, i, total, 3,
      unnest(regexp_extract_all(line, '(?i)\\b(\\d{1,2})\\s+de\\s+(\\w+)\\s+de\\s+(\\d{4})\\b')),
      generate_subscripts(regexp_extract_all(line, '(?i)\\b(\\d{1,2})\\s+de\\s+(\\w+)\\s+de\\s+(\\d{4})\\b'), 1)
    from lines),
  parsed as (select *, case p when 0 then try_strptime(raw, '%Y-%m-%d') when 1 then try_strptime(raw, '%d/%m/%Y')
      when 2 then try_strptime(raw, '%m/%d/%Y') else try_strptime(concat_ws('-', regexp_extract(raw, '(\\d{4})$', 1),
        list_position(['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre',
          'noviembre','diciembre'], lower(regexp_extract(raw, '(?i)de\\s+(\\w+)\\s+de', 1))),
        regexp_extract(raw, '^(\\d+)', 1)), '%Y-%m-%d') end as d,
      round(0.5 + case when regexp_matches(lower(line), 'fecha|date|emis|issued') then 0.3 else 0 end
        + case when i < total * 0.3 then 0.2 else 0 end, 2) as conf from raws),
  dates as (select id, strftime(d, '%Y-%m-%d') as value, cast(conf as double) as confidence, raw,
      ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', 'es_long'][p + 1] as format
    from parsed where d is not null qualify row_number() over (partition by id order by conf desc, i, p, j) = 1)"""

_AMOUNTS = (r"[€$£]\s?(\d{1,3}(?:\.\d{3})*,\d{2})", r"(\d{1,3}(?:\.\d{3})*,\d{2})\s?[€$£]",
            r"[€$£]\s?(\d{1,3}(?:,\d{3})*\.\d{2})", r"(\d{1,3}(?:,\d{3})*\.\d{2})\s?[€$£]", r"\b(\d+[.,]\d{2})\b")
SQL_TOTALS = ", araws as (" + " union all ".join(
    f"select id, line, i, total, {n} as p, unnest(regexp_extract_all(line, '{p}')) as raw, "
    f"generate_subscripts(regexp_extract_all(line, '{p}'), 1) as j from lines" for n, p in enumerate(_AMOUNTS)
) + """), aparsed as (select *, regexp_replace(raw, '[€$£\\s]', '', 'g') as digits,
      round(0.4 + case when regexp_matches(lower(line), 'total|importe|amount|suma|pagar') then 0.4 else 0 end
        + case when i > total * 0.5 then 0.2 else 0 end, 2) as conf from araws),
  avalued as (select *, round(try_cast(case when p < 2 then replace(replace(digits, '.', ''), ',', '.')
      when p < 4 then replace(digits, ',', '') else replace(digits, ',', '.') end as double), 2) as value from aparsed),
  totals as (select id, value, cast(conf as double) as confidence, trim(raw) as raw, case when contains(raw, '€') then
      'EUR' when contains(raw, '$') then 'USD' when contains(raw, '£') then 'GBP' else 'EUR' end as currency
    from avalued where value is not null qualify row_number() over (partition by id order by conf desc, i, p, j) = 1)"""

SQL_VENDORS = """, vlines as (select id, trim(line, chr(9) || chr(10) || chr(13) || ' ') as line, i from lines
    where i < greatest(1, cast(floor(total * 0.2) as int))),
  wordy as (select *, regexp_matches(line, '\\p{Lu}') and not regexp_matches(line, '[\\p{Ll}\\p{Lt}ªº]') as up,
      regexp_matches(lower(line), 'proveedor|vendor|empresa|company|razón social') as kw from vlines
    where line <> '' and not regexp_matches(line, '^[\\d\\s\\-./]+$')),
  vranked as (select *, case when length(line) >= 3 and (up or kw or i = 0) then 0 when length(line) > 5 then 1 end
    as tier from wordy),
  vendors as (select id, line as value, cast(case tier when 1 then 0.4 else round(0.6 + case when up then 0.2 else 0 end
      + case when kw then 0.2 else 0 end, 2) end as double) as confidence, line as raw
    from vranked where tier is not null qualify row_number() over (partition by id order by tier, i) = 1)"""

INVOICE_LINES = ctes("invoices") + SQL_LINES.format(id="o_orderkey", src="invoices")
# Invoices and running texts together: dates and amounts in prose are rare, in invoices they are the rule.
MIXED = """, mixed as (select o_orderkey as doc_id, text from invoices union all select -1 - doc_id, text
    from documents)"""
MIXED_LINES = ctes("invoices") + MIXED + SQL_LINES.format(id="doc_id", src="mixed")


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of invoices (id ≥ 0) and of documents (id < 0)."""
    invoices = frame(spark, sf, "invoices").select(F.col("o_orderkey").alias("doc_id"), "text")
    return invoices.unionByName(frame(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))


def found(df: DataFrame, field: Column, *keys: str) -> DataFrame:
    """The keys and the members of ``field``, for rows that have one; the field is computed once per row."""
    return df.select(*keys, F.inline(F.array_compact(F.array(field))))


@query("extract_dates", MIXED_LINES + SQL_DATES + """
    select id as doc_id, value, confidence, raw, format from dates""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return found(mixed(spark, sf), fx.extract_date(F.col("text")), "doc_id")


@query("extract_totals", MIXED_LINES + SQL_TOTALS + """
    select id as doc_id, value, confidence, raw, currency from totals""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return found(mixed(spark, sf), fx.extract_total(F.col("text")), "doc_id")


@query("extract_vendor", MIXED_LINES + SQL_VENDORS + """
    select id as doc_id, value, confidence, raw from vendors""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return found(mixed(spark, sf), fx.extract_vendor(F.col("text")), "doc_id")


@query("best_candidate", MIXED_LINES + SQL_TOTALS + """
    select id as doc_id, n, i as line, p as pattern, j - 1 as match, round(conf, 2) as confidence, value
    from (select *, count(*) over (partition by id) as n,
        row_number() over (partition by id order by conf desc, i, p, j) as rn from avalued where value is not null)
    where rn = 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    def summary(candidates: Column) -> Column:
        n = F.size(candidates).cast("bigint")
        return F.when(n > 0, F.struct(n.alias("n"), fx.best_candidate(candidates).alias("b")))

    best = found(mixed(spark, sf), bind(fx.total_candidates(F.col("text")), summary), "doc_id")
    return best.select("doc_id", "n", *[F.col(f"b.{c}").cast("bigint").alias(c) for c in ("line", "pattern", "match")],
                       (-F.col("b.rank")).alias("confidence"), "b.value")


SUFFIXES = "".join(
    f", v{n + 1} as (select id, regexp_replace(name, '{p}', '', 'gi') as name from v{n})"
    for n, p in enumerate(ops.LEGAL_SUFFIXES))


@query("normalise_vendor", ctes("names") + """, v0 as (select name_id as id, concat(case name_id % 6 when 0 then
        upper(name) else name end, case name_id % 5 when 0 then ' S.L.' when 1 then ' GmbH' when 2 then '  Ltd. ' when 3
        then ', S.A' else '' end) as name from names)""" + SUFFIXES + """
    , clean as (select id, trim(regexp_replace(name, '\\s+', ' ', 'g')) as name from v8)
    select id as name_id, case when regexp_matches(name, '\\p{Lu}') and not regexp_matches(name, '[\\p{Ll}\\p{Lt}ªº]')
      then array_to_string(list_transform(regexp_extract_all(name, '(\\p{L}+|\\P{L}+)'),
        lambda r: concat(upper(r[1]), lower(r[2:]))), '') else name end as vendor from clean""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("name_id")
    name = F.concat(F.when(key % 6 == 0, F.upper("name")).otherwise(F.col("name")), F.when(key % 5 == 0, " S.L.").when(
        key % 5 == 1, " GmbH").when(key % 5 == 2, "  Ltd. ").when(key % 5 == 3, ", S.A").otherwise(""))
    return frame(spark, sf, "names").select("name_id", ops.normalise_vendor(name).alias("vendor"))


def structured_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Every invoice with its normalised fields."""
    fields = ops.normalise_fields(fx.extract_fields(F.col("text")))
    return frame(spark, sf, "invoices").select("o_orderkey", "o_custkey", fields.alias("fields"))


@query("normalise_fields", INVOICE_LINES + SQL_DATES + SQL_TOTALS + SQL_VENDORS + """
    select o_orderkey as doc_id, dates.value as date, totals.value as total, totals.currency,
      replace(vendors.value, 'CUSTOMER', 'Customer') as vendor, vendors.confidence as vendor_confidence
    from orders left join dates on dates.id = o_orderkey left join totals on totals.id = o_orderkey
    left join vendors on vendors.id = o_orderkey""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return structured_invoices(spark, sf).select(
        F.col("o_orderkey").alias("doc_id"), F.col("fields.date.value").alias("date"),
        F.col("fields.total.value").alias("total"), F.col("fields.total.currency").alias("currency"),
        F.col("fields.vendor.value").alias("vendor"), F.col("fields.vendor.confidence").alias("vendor_confidence"))


AS_OF = "2001-03-01 00:00:00"


@query("field_anomalies", INVOICE_LINES + SQL_DATES + SQL_TOTALS + SQL_VENDORS + f"""
    select o_orderkey as doc_id, concat_ws('|', case when d is null then 'missing_date' end,
      case when totals.id is null then 'missing_total' end, case when vendors.id is null then 'missing_vendor' end,
      case when d > timestamp '{AS_OF}' + interval 7 day then 'future_date' end,
      case when isodow(d) >= 6 then 'weekend_date' end,
      case when d < timestamp '{AS_OF}' - interval 1825 day then 'very_old_date' end) as anomalies
    from orders left join (select id, cast(value as timestamp) as d from dates) dd on dd.id = o_orderkey
    left join totals on totals.id = o_orderkey left join vendors on vendors.id = o_orderkey""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    codes = ops.field_anomalies(F.col("fields"), F.lit(AS_OF))
    return structured_invoices(spark, sf).select(
        F.col("o_orderkey").alias("doc_id"), F.array_join(codes, "|").alias("anomalies"))


SQL_HISTORY = """, dated as (select o_orderkey, case when o_orderkey % 13 > 0 then o_custkey end as o_custkey, value
      from totals join orders on id = o_orderkey),
  history as (select o_orderkey, o_custkey, value, count(value) over w as n, avg(value) over w as mean,
      stddev_samp(value) over w as sd from dated
    window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding)),
  flagged as (select *, n >= 5 and sd > 0 and abs(value - mean) > 3 * sd as unusual, n >= 5 and value > mean * 10 as
      large, n >= 5 and value % 100 = 0 and value >= 1000 as round_number from history)"""


def invoice_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    invoices = frame(spark, sf, "invoices")
    totals = found(invoices, fx.extract_total(F.col("text")), "o_orderkey", "o_custkey")
    customer = F.when(F.col("o_orderkey") % 13 > 0, F.col("o_custkey"))  # some invoices name nobody
    stored = cut_lineage(totals.select("o_orderkey", customer.alias("o_custkey"), "value"))
    return ops.amount_anomalies(stored, "o_custkey", "o_orderkey", "value",
                                bounds_from=frame(spark, sf, "orders"))


@query("amount_anomalies", INVOICE_LINES + SQL_TOTALS + SQL_HISTORY + """
    select o_orderkey, o_custkey, value, concat_ws('|', case when unusual then 'unusual_amount' end,
      case when large then 'very_large_amount' end, case when round_number then 'suspicious_round_number' end)
      as anomalies from flagged""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return invoice_anomalies(spark, sf).withColumn("anomalies", F.array_join("anomalies", "|"))


@query("invoice_anomaly_counts", INVOICE_LINES + SQL_TOTALS + SQL_HISTORY + """
    select code, count(*) as n from (select unnest(list_filter([case when unusual then 'unusual_amount' end,
      case when large then 'very_large_amount' end, case when round_number then 'suspicious_round_number' end],
      lambda c: c is not null)) as code from flagged) group by code""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    codes = invoice_anomalies(spark, sf).select(F.explode("anomalies").alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))


@query("review_fields", INVOICE_LINES + SQL_DATES + SQL_TOTALS + SQL_VENDORS + """
    select o_orderkey as doc_id, dates.confidence as date_conf, totals.confidence as total_conf,
      vendors.confidence as vendor_conf, case when o_orderkey % 4 = 0 then '2000-01-01' else dates.value end as date,
      case when o_orderkey % 5 = 0 then '7.5' else cast(totals.value as string) end as total,
      replace(vendors.value, 'CUSTOMER', 'Customer') as vendor
    from orders left join dates on dates.id = o_orderkey left join totals on totals.id = o_orderkey
    left join vendors on vendors.id = o_orderkey""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    edited = structured_invoices(spark, sf).select(
        key.alias("doc_id"), "fields", F.when(key % 4 == 0, "2000-01-01").otherwise("").alias("date"),
        F.when(key % 5 == 0, "7.5").alias("total"), F.lit(None).cast("string").alias("supplier"))
    return listing.review_fields(edited)


@query("extract_fields", INVOICE_LINES + SQL_DATES + SQL_TOTALS + SQL_VENDORS + """
    select id as doc_id, 'date' as field, value, confidence, raw from dates
    union all select id, 'total', cast(value as string), confidence, raw from totals
    union all select id, 'vendor', value, confidence, raw from vendors""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL table function on every invoice."""
    register_functions(spark)
    invoices = frame(spark, sf, "invoices")
    return spark.sql("select o_orderkey as doc_id, f.* from {invoices}, lateral extract_fields(text) f",
                     invoices=invoices)

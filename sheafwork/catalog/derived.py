"""Document-shaped frames derived from the benchmark tables, and the same derivations as DuckDB CTEs.

Most derivations are one SQL text that both engines run; ``@name@`` stands for a table. The few that differ are given
twice. Names: docs (registry rows), invoices (text of one invoice per order), texts (recognised text per document),
blocks (two engines' output per line), cells, vectors, records, pixels, requests, plans, names, tagged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sheafwork.plans.sizing import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SHARED = {
    "docs": """
        select o_orderkey as doc_id,
          concat('doc_', o_orderkey, case o_orderkey % 4 when 0 then '.pdf' when 1 then '.png' when 2 then '.TXT'
            else '.eml' end) as filename,
          concat('/inbox/', o_orderkey % 7, '/doc_', o_orderkey, case o_orderkey % 4 when 0 then '.pdf'
            when 1 then '.png' when 2 then '.TXT' else '.eml' end) as path,
          case o_orderstatus when 'O' then 'OK' when 'F' then 'FAILED' else 'processing' end as status,
          case substr(o_orderpriority, 1, 1) when '1' then 'invoice' when '2' then ' Invoice' when '3' then 'contract'
            when '4' then null else 'technical plan' end as type,
          o_orderdate as datetime, round(o_totalprice / 10000, 2) as duration,
          case o_orderkey % 5 when 0 then '["color:#aabbcc","Madera Oscura (91%)"]' when 1 then '[]'
            when 2 then 'not json' when 3 then '["Project: H-2024","Color Terracota"]' end as tags,
          case when o_orderkey % 3 = 0 then 'pending' else 'verified' end as workflow_state,
          case when o_orderstatus = 'F' then concat('error ', o_orderkey % 5) end as error_message,
          o_orderkey % 7 as folder_id
        from @orders@""",
    "texts": """
        select doc_id as id_doc, text, lang as language, cast((n_chars % 101) / 100.0 as double) as confidence
        from @documents@""",
    "cells": """
        select l_orderkey as doc_id, cast(l_linenumber - 1 as bigint) as row_no, cast(0 as bigint) as col_no,
          case when l_linenumber = 2 then 2 else 1 end as row_span, 1 as col_span, l_returnflag as txt,
          concat(l_partkey, '_', l_suppkey) as seq from @lineitem@
        union all
        select l_orderkey, cast(l_linenumber - 1 as bigint), cast(1 as bigint), 1,
          case when l_linenumber = 3 then 2 else 1 end, cast(cast(l_quantity as bigint) as string),
          concat(l_partkey, '_', l_suppkey) from @lineitem@
        union all
        select l_orderkey, cast(l_linenumber - 1 as bigint), cast(2 as bigint), 1, 1, l_linestatus,
          concat(l_partkey, '_', l_suppkey) from @lineitem@""",
    "records": """
        select event_id, cast(ts as date) as batch, concat('file_', event_id) as filename,
          case event_type when 'error' then 'FAILED' when 'view' then 'DUPLICATE' else 'OK' end as status,
          value as duration, case user_id % 3 when 0 then 'Invoice' when 1 then 'Report' else 'Unknown' end as type, ts
        from @events@""",
    "pixels": """
        select l_orderkey % 50 as image_id, (l_partkey * 7) % 256 as r, (l_suppkey * 31) % 256 as g,
          (l_linenumber * 53) % 256 as b from @lineitem@""",
    "requests": """
        select o_orderkey as doc_id, o_orderkey % 11 = 0 as native_pdf,
          cast(case when o_orderkey % 41 = 0 then 1.5 else ((o_orderkey * 7) % 101) / 100.0 end as double) as confidence,
          o_orderkey % 13 <> 0 as legible, o_orderkey % 17 = 0 as handwriting, o_orderkey % 3 = 0 as graphics,
          case o_orderkey % 19 when 0 then 'Plano' when 1 then 'manuscrito' else 'factura' end as previous_type,
          case when o_orderkey % 43 = 0 then -1 else o_orderkey % 9 end as low_blocks
        from @orders@""",
    "plans": """
        select p_partkey as plan_id, concat(p_name, ' ',
          case p_partkey % 6 when 0 then 'E:1:50' when 1 then 'Escala 1/100' when 2 then 'SCALE 1:75' when 3 then
            'plan 1:200 ref' when 4 then 'sin escala' else 'E = 1:30 y 1:20' end, ' ',
          case p_size % 7 when 0 then 'Cocina y dormitorio' when 1 then 'kitchen, BATHROOM' when 2 then 'hallway; sala'
            when 3 then 'bathrooms' when 4 then 'garage + storage' when 5 then 'Living room' else 'planta' end, ' ',
          case p_partkey % 5 when 0 then '12.50 m2' when 1 then 'S.Const: 120,50' when 2 then '12.50 m2 y 12.50 m2'
            when 3 then '7,5 sq m' else 'sin superficie' end) as text
        from @part@""",
    "names": """
        select s_suppkey as name_id, case s_suppkey % 9 when 0 then 'Amazon' when 1 then 'amzn' when 2 then
            'Amazon Mkts' when 3 then 'leroymerlim' when 4 then 'Leroy  Merlin' when 5 then 'IKEA Iberica'
            when 6 then 'L Merlin' when 7 then s_name else ' AWS ' end as name
        from @supplier@
        union all select 1000000 + c_custkey, case c_custkey % 5 when 0 then 'Leroy Merlin' when 1 then 'leroy merlyn'
            when 2 then 'Ikea Ibérica' else c_name end from @customer@""",
    "letters": """
        select o_orderkey as doc_id, concat(case o_orderkey % 11 when 0 then 'Factura proforma' when 1 then
            'CONTRATO de obra' when 2 then 'Recibo de caja' when 3 then 'Ticket y Report' when 4 then 'Dear customer'
            when 5 then 'Technical drawing' when 6 then 'Presupuesto' when 7 then 'Weekly memo' when 8 then 'Bill 7'
            when 9 then '' else 'nada que ver' end, ' ',
          case o_orderkey % 7 when 0 then 'prj-a12 rev' when 1 then 'ref H-2024 y PRJ-9' when 2 then
            'Proyecto  Norte 3' when 3 then 'pedido Amzn y Leroy' when 4 then 'ikea' else '' end) as text
        from @orders@""",
}

PAIRS = {  # name: (Spark SQL, DuckDB SQL)
    "invoices": (
        """
        select o_orderkey, o_custkey, concat_ws(chr(10), upper(c_name),
          case when o_orderkey % 53 = 0 then 'Sin datos'
               else concat('Fecha: ', date_format(o_orderdate, 'dd/MM/yyyy')) end,
          concat('Factura ', o_orderkey), 'Concepto: servicios',
          concat('Total: ', replace(replace(replace(format_number(amt, 2), ',', '#'), '.', ','), '#', '.'), ' €'))
          as text
        from (select *, case when o_orderkey % 97 = 0 then round(o_totalprice * 12, 2) when o_orderkey % 89 = 0
                then cast(floor(o_totalprice / 100) * 100 as double) else o_totalprice end as amt from @orders@)
        join @customer@ on o_custkey = c_custkey""",
        """
        select o_orderkey, o_custkey, concat_ws(chr(10), upper(c_name),
          case when o_orderkey % 53 = 0 then 'Sin datos'
               else concat('Fecha: ', strftime(o_orderdate, '%d/%m/%Y')) end,
          concat('Factura ', o_orderkey), 'Concepto: servicios',
          concat('Total: ', replace(replace(replace(format('{:,.2f}', amt), ',', '#'), '.', ','), '#', '.'), ' €'))
          as text
        from (select *, case when o_orderkey % 97 = 0 then round(o_totalprice * 12, 2) when o_orderkey % 89 = 0
                then cast(floor(o_totalprice / 100) * 100 as double) else o_totalprice end as amt from @orders@)
        join @customer@ on o_custkey = c_custkey""",
    ),
    "blocks": (
        """
        select doc_id, cast(pos as bigint) as block_id, cast(pos div 20 as bigint) as page, line as text_a,
          cast((length(line) * 7 + pos) % 101 as double) / 100 as conf_a,
          case when pos % 7 = 0 then '' when pos % 5 = 0 then replace(line, 'e', '3') else line end as text_b,
          cast((length(line) * 3 + pos * 11) % 101 as double) / 100 as conf_b
        from @documents@ lateral view posexplode(split(text, '\n')) t as pos, line""",
        """
        select doc_id, cast(pos - 1 as bigint) as block_id, cast((pos - 1) // 20 as bigint) as page, line as text_a,
          cast((length(line) * 7 + pos - 1) % 101 as double) / 100 as conf_a,
          case when (pos - 1) % 7 = 0 then '' when (pos - 1) % 5 = 0 then replace(line, 'e', '3') else line end
            as text_b,
          cast((length(line) * 3 + (pos - 1) * 11) % 101 as double) / 100 as conf_b
        from (select doc_id, unnest(str_split(text, chr(10))) as line,
                generate_subscripts(str_split(text, chr(10)), 1) as pos from @documents@)""",
    ),
    "vectors": (
        """
        select vec_id as id, embedding as e, label from @embeddings@
        union all
        select vec_id + 1000000, transform(embedding, (x, i) -> cast(case when i = 0 then x * 1.01D else x end
          as float)), label from @embeddings@ where vec_id % 10 = 0
        union all select vec_id + 2000000, embedding, label from @embeddings@ where vec_id % 25 = 0""",
        """
        select vec_id as id, embedding as e, label from @embeddings@
        union all
        select vec_id + 1000000, list_prepend(cast(embedding[1] * cast(1.01 as double) as float), embedding[2:]), label
          from @embeddings@ where vec_id % 10 = 0
        union all select vec_id + 2000000, embedding, label from @embeddings@ where vec_id % 25 = 0""",
    ),
}


# tables whose rows are texts, or become texts, and the key they are distributed by when a file is too small to split
TEXT_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}
TEXT_SOURCES = {"invoices": {"orders": ("o_orderkey",)}}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table or one of the derived frames."""
    def table(source: str, keys: tuple[str, ...] | None) -> DataFrame:
        stored = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        return spread(stored, *keys) if keys else stored

    if name in TABLES:
        return table(name, TEXT_KEYS.get(name))
    sql = SHARED.get(name) or PAIRS[name][0]
    sources = {s: table(s, {**TEXT_KEYS, **TEXT_SOURCES.get(name, {})}.get(s)) for s in re.findall(r"@(\w+)@", sql)}
    return spark.sql(re.sub(r"@(\w+)@", r"{\1}", sql), **sources)


def ctes(*names: str) -> str:
    """``with a as (…), b as (…)`` for the derived frames named, in DuckDB's dialect."""
    parts = [
        f"{name} as ({re.sub(r'@(.+?)@', lambda m: m.group(1), SHARED.get(name) or PAIRS[name][1])})" for name in names
    ]
    return "with " + ",\n".join(parts)

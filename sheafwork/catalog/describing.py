"""Classification, naming, blueprint, advice and routing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.operators import classify, decisions, linking

SQL_KEYWORDS = "case " + " ".join(
    f"when contains(t, '{w}') then '{kind}~{w}'" for kind, words in classify.KEYWORDS.items() for w in words) + " end"


@query("classify_keywords", ctes("letters") + f"""
    select doc_id, coalesce(split_part(k, '~', 1), 'Unknown') as type, split_part(k, '~', 2) as tag
    from (select doc_id, {SQL_KEYWORDS} as k from (select doc_id, lower(text) as t from letters
      union all select -1 - doc_id, lower(text) from documents))""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents = frame(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    texts = frame(spark, sf, "letters").unionByName(documents)
    return texts.select("doc_id", classify.classify_keywords(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("classify_with_fallback", ctes("letters", "docs") + f"""
    , typed as (select doc_id, coalesce(split_part(k, '~', 1), 'Unknown') as type from
        (select doc_id, {SQL_KEYWORDS} as k from (select doc_id, lower(text) as t from letters))),
    scored as (select doc_id, type, doc_id % 4 in (0, 1) as visual, (doc_id * 3 % 101) / 100.0 as confidence,
      (doc_id * 7 % 101) / 100.0 as score,
      ['factura','recibo','contrato','informe','carta','mueble','decoracion'][1 + doc_id % 7] as label from typed),
    used as (select *, visual and (type = 'Unknown' or confidence < 0.6) and score > 0.7 as u from scored)
    select doc_id, case when t2 = 'Unknown' and visual then 'Imagen' else t2 end as type,
      case when u then concat('VisualClass: ', label, ' (', cast(trunc(cast(score as double) * 100) as int), '%)') end
        as tag
    from (select *, case when u then case label when 'factura' then 'Invoice' when 'recibo' then 'Receipt'
      when 'contrato' then 'Contract' when 'informe' then 'Report' when 'carta' then 'Letter' else 'Imagen' end
      else type end as t2 from used)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    labels = F.array(*[F.lit(x) for x in classify.VISUAL_TYPES])
    scored = frame(spark, sf, "letters").select(
        "doc_id", classify.classify_keywords(F.col("text"))["type"].alias("type"), (key % 4).isin(0, 1).alias("visual"),
        (key * 3 % 101 / 100.0).alias("confidence"), (key * 7 % 101 / 100.0).alias("score"),
        F.get(labels, (key % 7).cast("int")).alias("label"))
    chosen = classify.classify_with_fallback(*[F.col(c) for c in ("type", "confidence", "visual", "label", "score")])
    return scored.select("doc_id", chosen.alias("c")).select("doc_id", "c.*")


@query("to_markdown", """
    with lines as (select doc_id, pos, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') as line from (
        select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from (
          select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') as l from (
            select doc_id, concat(case doc_id % 5 when 0 then 'RESUMEN ANUAL' || chr(10) when 1 then 'Nota:' || chr(13)
              || chr(10) || chr(10) when 2 then '  12  34 ' || chr(10) else '' end, text) as text from documents)))),
    marked as (select *, length(line) > 2 and ((length(line) < 100 and ((regexp_matches(line, '\\p{Lu}') and not
          regexp_matches(line, '[\\p{Ll}\\p{Lt}ªº]')) or ends_with(line, ':'))) or (len(regexp_extract_all(line,
          '\\S+')) <= 6 and not regexp_matches(line, '(^|\\P{L})\\p{Ll}') and not regexp_matches(line,
          '\\p{L}\\p{Lu}'))) as heading from lines),
    grouped as (select *, sum(case when heading or line = '' then 1 else 0 end) over (partition by doc_id order by pos)
        as g from marked),
    parts as (select doc_id, min(pos) as pos, case when heading then '## ' || min(line)
          else trim(regexp_replace(string_agg(line, ' ' order by pos), '\\s+', ' ', 'g')) end as part
      from grouped where line <> '' group by doc_id, g, heading)
    select doc_id, md5(string_agg(part, chr(10) || chr(10) order by pos)) as markdown_md5 from parts group by doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id") % 5
    head = F.when(key == 0, "RESUMEN ANUAL\n").when(key == 1, "Nota:\r\n\n").when(key == 2, "  12  34 \n").otherwise("")
    markdown = classify.to_markdown(F.concat(head, F.col("text")))
    return frame(spark, sf, "documents").select("doc_id", F.md5(markdown).alias("markdown_md5"))


@query("project_code", ctes("letters") + """
    select doc_id, replace(upper(coalesce(nullif(regexp_extract(text, '(?i)PRJ-[A-Z0-9]+'), ''),
      nullif(regexp_extract(text, '(?i)H-\\d{4}'), ''), nullif(regexp_extract(text, '(?i)PROYECTO\\s+[A-Z0-9]+'), ''))),
      ' ', '-') as code from letters""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "letters").select("doc_id", classify.project_code(F.col("text")).alias("code"))


@query("smart_filename", ctes("docs", "letters") + """
    , named as (select docs.doc_id, filename, coalesce(type, 'Doc') as kind,
        case when regexp_matches(text, '(?i)PRJ-[A-Z0-9]+') then upper(regexp_extract(text, '(?i)PRJ-[A-Z0-9]+'))
          when regexp_matches(text, '(?i)H-\\d{4}') then upper(regexp_extract(text, '(?i)H-\\d{4}'))
          when regexp_matches(text, '(?i)PROYECTO\\s+[A-Z0-9]+') then
            replace(upper(regexp_extract(text, '(?i)PROYECTO\\s+[A-Z0-9]+')), ' ', '-') else 'NoProject' end as project,
        case when contains(lower(text), 'amzn') then 'Amazon' when contains(lower(text), 'ikea') then 'IKEA'
          else 'NoVendor' end as vendor from docs join letters using (doc_id))
    select doc_id, concat(trim(replace(concat_ws('_', '2026-01-05', kind, project, vendor,
      regexp_replace(filename, '\\.[^.]*$', '')), ' ', '_'), '_'), regexp_extract(filename, '\\.[^.]*$')) as name
    from named""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    joined = frame(spark, sf, "docs").select("doc_id", "filename", "type").join(frame(spark, sf, "letters"), "doc_id")
    tags = F.concat(F.array_compact(F.array(classify.project_tag(F.col("text")))), linking.vendor_tags(F.col("text")))
    kind = F.coalesce("type", F.lit("Unknown"))
    return joined.select("doc_id", classify.smart_filename(F.lit("2026-01-05"), kind, tags, F.col("filename"))
                         .alias("name"))


SQL_SCALES = ", ".join(
    f"case when try_cast(regexp_extract(text, '(?i){p}', 1) as bigint) in (10, 20, 50, 100, 200, 500, 1000) then "
    f"concat('1:', try_cast(regexp_extract(text, '(?i){p}', 1) as bigint)) end" for p in classify.SCALE_PATTERNS)


@query("blueprint_scale", ctes("plans") + f"select plan_id, coalesce({SQL_SCALES}) as scale from plans")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "plans").select("plan_id", classify.blueprint_scale(F.col("text")).alias("scale"))


SQL_ROOMS = ", ".join(
    f"case when regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])') "
    f"then '{room}' end" for room, words in sorted(classify.ROOMS.items()))


@query("blueprint_rooms", ctes("plans") + f"select plan_id, concat_ws('|', {SQL_ROOMS}) as rooms from plans")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rooms = F.array_join(classify.blueprint_rooms(F.col("text")), "|")
    return frame(spark, sf, "plans").select("plan_id", rooms.alias("rooms"))


@query("blueprint_areas", ctes("plans") + """
    select plan_id, array_to_string(list_sort(list_distinct(list_concat(
      regexp_extract_all(text, '(?i)(\\d+[.,]\\d{1,2})\\s?(?:m²|m2|sq\\s?m)'),
      regexp_extract_all(text, '(?i)S\\.?\\s?(?:const|bhu)?[:\\.]?\\s?(\\d+[.,]\\d{1,2})')))), '|') as areas
    from plans""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    areas = F.array_join(classify.blueprint_areas(F.col("text")), "|")
    return frame(spark, sf, "plans").select("plan_id", areas.alias("areas"))


@query("dedup_values", """
    select o_custkey, string_agg(v, '|' order by v) as kinds from (select distinct o_custkey,
      concat(o_orderstatus, substr(o_orderpriority, 1, 1)) as v from orders) group by o_custkey""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))
    sets = frame(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(kinds).alias("v"))
    return sets.select("o_custkey", F.array_join(classify.dedup_values(F.col("v")), "|").alias("kinds"))


SQL_TAG_LIST = """(select p_partkey as item_id, [case p_partkey % 4 when 0 then 'Madera Oscura (91%)' when 1 then
    'Color Terracota' when 2 then 'Estilo Industrial (7%)' else 'color:#aabbcc' end,
    case p_size % 3 when 0 then 'Color Azul Marino (55%)' when 1 then 'Color Azul Marino' else 'Otra' end] as tags
    from part)"""


def tag_list(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey") % 4, F.col("p_size") % 3
    first = F.when(key == 0, "Madera Oscura (91%)").when(key == 1, "Color Terracota").when(
        key == 2, "Estilo Industrial (7%)").otherwise("color:#aabbcc")
    second = F.when(size == 0, "Color Azul Marino (55%)").when(size == 1, "Color Azul Marino").otherwise("Otra")
    return frame(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.array(first, second).alias("tags"))


@query("decor_advice", f"""
    with clean as (select item_id, unnest(list_transform(tags, lambda t: trim(split_part(t, '(', 1)))) as t from
        {SQL_TAG_LIST}),
    advice as (select item_id, concat('💡 ', t, ': ', case t
        when 'Madera Oscura' then 'Combina con tonos crema o textiles claros para dar luminosidad.'
        when 'Color Terracota' then 'Ideal para ambientes rústicos o bohemios. Usa madera natural.'
        when 'Estilo Industrial' then 'Añade calidez con plantas y textiles suaves.'
        when 'Color Azul Marino' then 'Contrasta genial con mostaza o dorado.' end) as a from clean
      where t in ('Madera Oscura', 'Color Terracota', 'Estilo Industrial', 'Color Azul Marino')
      union select item_id, '🎨 Tip: Introduce elementos de madera para dar calidez al color.' from clean
        group by item_id having bool_or(contains(t, 'Color')) and not bool_or(contains(t, 'Madera')))
    select p_partkey as item_id, coalesce(string_agg(a, '|' order by a), '') as advice
    from part left join advice on item_id = p_partkey group by p_partkey""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    advice = F.array_join(classify.decor_advice(F.col("tags")), "|")
    return tag_list(spark, sf).select("item_id", advice.alias("advice"))


@query("merge_tags", f"""
    select item_id, concat_ws('|', array_to_string(tags, '|'), concat('silla (', trunc(((item_id * 13) % 101) / 100.0 *
      100)::int, '%)'), case when not contains(array_to_string(tags, '|'), 'color:') then 'color:#102030' end) as tags
    from {SQL_TAG_LIST}""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = F.array(F.struct(F.lit("silla").alias("label"), (F.col("item_id") * 13 % 101 / 100.0).alias("score")))
    merged = classify.merge_tags(F.col("tags"), scored, F.array(F.lit("#102030")))
    return tag_list(spark, sf).select("item_id", F.array_join(merged, "|").alias("tags"))


@query("route_interpretation", ctes("requests") + f"""
    , judged as (select *, case when not (confidence between 0 and 1 and low_blocks >= 0) then 0
      when native_pdf and confidence > 0.9 and legible then 1 when handwriting then 2
      when lower(previous_type) in ('plano', 'boceto', 'diagrama', 'manuscrito') then 3 when confidence < 0.4 then 4
      when confidence < 0.7 and graphics then 5 else 6 end as rule from requests)
    select doc_id, rule in (2, 3, 4, 5) as activate, case when rule in (2, 3, 4, 5) then '{decisions.INVOKE}'
        else '{decisions.CONTINUE}' end as action,
      case rule when 0 then '{decisions.REASON_INVALID}' when 1 then '{decisions.REASON_NATIVE}'
        when 2 then '{decisions.REASON_HANDWRITING}' when 3 then concat('Clasificación ''', previous_type,
          ''' requiere análisis visual avanzado.') when 4 then concat('Confianza OCR crítica (', printf('%.2f',
          confidence), '). Posible imagen sin texto o ruido, o escritura ilegible.')
        when 5 then '{decisions.REASON_MIXED}' else '{decisions.REASON_DEFAULT}' end as reason,
      case rule when 2 then 'manuscrito' when 3 then 'visual_complex' when 4 then 'recuperacion_ruido' when 5 then
        'mixto' end as kind,
      cast(case rule when 0 then 0.0 when 1 then 0.99 when 2 then 0.95 when 3 then 0.9 when 4 then 0.85 when 5 then 0.75
        else 0.9 end as double) as confidence from judged""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    routed = decisions.route_interpretation(frame(spark, sf, "requests"))
    return routed.select("doc_id", "decision.*")


@query("order_lines", f"""
    with items as (select item_id as doc_id, case when item_id % 10 = 0 then ['Silla', null] when item_id % 10 = 1 then []
        end as crops, case when item_id % 10 = 2 then ['color:red'] else tags end as tags from {SQL_TAG_LIST}),
    lines as (select doc_id, concat('AUTO-', upper(substr(coalesce(c, 'Item'), 1, 3)), '-', doc_id) as reference,
        coalesce(c, 'Elemento Decorativo') as description, 'Detección Visual' as origin
      from (select doc_id, unnest(crops) as c from items where crops is not null)
      union all select doc_id, 'ETIQUETA', t, 'Etiquetado Auto' from (select doc_id, unnest(tags) as t from items
        where crops is null) where not contains(t, ':'))
    select doc_id, reference, coalesce(description, 'No se detectaron elementos específicos para listar.') as description,
      coalesce(cast(case when origin is not null then 1 end as bigint), -1) as quantity,
      case when origin is not null then 'A determinar' end as supplier,
      case when origin is not null then 'Consultar' end as price,
      case when origin is not null then 'Pendiente' end as state, origin
    from items left join lines using (doc_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("item_id") % 10
    crop = lambda label: F.struct(F.lit(label).cast("string").alias("label"))
    crops = F.when(key == 0, F.array(crop("Silla"), crop(None))).when(
        key == 1, F.array().cast("array<struct<label:string>>"))
    tags = F.when(key == 2, F.array(F.lit("color:red"))).otherwise(F.col("tags"))
    items = tag_list(spark, sf).select(F.col("item_id").alias("doc_id"), crops.alias("crops"), tags.alias("tags"))
    return decisions.order_lines(items).withColumn("quantity", F.coalesce("quantity", F.lit(-1).cast("bigint")))

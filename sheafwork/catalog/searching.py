"""Index, search, chunk, neighbour and near-copy queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.catalog.core import query
from sheafwork.catalog.derived import ctes, frame
from sheafwork.functions.tables import register_functions
from sheafwork.functions.tokens import MARKED, PLAIN
from sheafwork.functions.vectors import l2_normalise
from sheafwork.operators import blockmax, cells, nearcopies, neighbours, search
from sheafwork.plans.sizing import rows_if_small
from sheafwork.session import cut_lineage

QUERY = "The tion of"
SQL_POSTINGS = f""", tokens as (select id_doc as doc_id, unnest(regexp_extract_all(translate(lower(text), '{MARKED}',
      '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')) as term from texts),
    postings as (select term, doc_id, count(*) as tf from tokens group by all)"""


def chunkable(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with paragraphs: every line of an even document is one, and every word of each seventh."""
    text = F.when(F.col("id_doc") % 7 == 0, F.replace("text", F.lit(" "), F.lit("\n\n"))).when(
        F.col("id_doc") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return frame(spark, sf, "texts").select("id_doc", text.alias("text"))


@query("chunk_text", ctes("texts") + """
    , source as (select id_doc, case when id_doc % 7 = 0 then replace(text, ' ', chr(10) || chr(10))
        when id_doc % 2 = 0 then replace(text, chr(10), chr(10) || chr(10)) else text end
        as text from texts),
    paragraphs as (select id_doc, pos, trim(p, chr(9) || chr(10) || chr(13) || ' ') as p from (select id_doc,
        unnest(str_split(text, chr(10) || chr(10))) as p,
        generate_subscripts(str_split(text, chr(10) || chr(10)), 1) as pos from source)),
    pieces as (select id_doc, pos, s, substr(p, s, 1500) as piece from (select *, unnest(generate_series(1, length(p),
        1500)) as s from paragraphs where length(p) > 20)),
    every as (select * from pieces union all select id_doc, 1, s, substr(text, s, 1500) from (select *,
        unnest(generate_series(1, length(text), 1500)) as s from source
        where text <> '' and id_doc not in (select id_doc from pieces)))
    select id_doc, row_number() over (partition by id_doc order by pos, s) - 1 as chunk_no, md5(piece) as chunk_md5
    from every""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    chunks = search.chunk_text(chunkable(spark, sf))
    return chunks.select("id_doc", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


SQL_NAMES = "concat('doc_', id_doc, case when id_doc % 3 = 0 then ' of the' else '' end, '.txt')"
SQL_INDEX = f""", named as (select id_doc, text, {SQL_NAMES} as filename from texts),
    tokens as (select id_doc as doc_id, f.field, unnest(regexp_extract_all(translate(lower(f.body), '{MARKED}', '{PLAIN}'),
      '[\\p{{L}}\\p{{N}}]+')) as term from (select id_doc, unnest([{{'field': 'text', 'body': text}}, {{'field': 'filename',
        'body': filename}}]) as f from named)),
    postings as (select term, doc_id, field, count(*) as tf from tokens group by all)"""


def searchable(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with file names, some of which hold words of the query."""
    name = F.concat(F.lit("doc_"), "id_doc", F.when(F.col("id_doc") % 3 == 0, " of the").otherwise(""), F.lit(".txt"))
    return frame(spark, sf, "texts").select(F.col("id_doc").alias("doc_id"), name.alias("filename"), "text")


def indexed(spark: SparkSession, sf: str, stemmed: bool) -> DataFrame:
    return search.build_text_index(searchable(spark, sf), stemmed=stemmed)


def searched(spark: SparkSession, sf: str, text: str, stemmed: bool) -> DataFrame:
    """A search of an index that is built and stored first, as it would be for many searches."""
    lengths = search.text_lengths(searchable(spark, sf))
    postings = cut_lineage(indexed(spark, sf, stemmed))
    return search.search_fulltext(postings, text, stemmed=stemmed, lengths=cut_lineage(lengths))


@query("build_text_index")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf, stemmed=True)


@query("build_text_index_unstemmed", ctes("texts") + SQL_INDEX + """
    select term, doc_id, field, tf from postings""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf, stemmed=False)


SQL_BEST = ctes("texts") + SQL_INDEX + """
    , lengths as (select doc_id, sum(tf) as n_terms from postings group by doc_id),
    hits as (select term, doc_id, sum(tf) as tf from postings where term in ('the', 'tion', 'of') group by term, doc_id),
    scored as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms /
        mean))) as score, count(*) as found
      from hits join (select term, count(*) as df from hits group by term) using (term) join lengths using (doc_id),
        (select count(*) as n, avg(n_terms) as mean from lengths) group by doc_id),
    best as (select doc_id, round(score, 6) as score from scored where found = 3 order by round(score, 9) desc, doc_id
      limit 50)"""


@query("search_fulltext", SQL_BEST + "select doc_id, score from best")
def _(spark: SparkSession, sf: str) -> DataFrame:
    best = searched(spark, sf, QUERY, stemmed=False)
    return best.withColumn("score", F.round("score", 6))


@query("search_fulltext_stemmed")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf, "ands THE", stemmed=True)


@query("search_substring", ctes("texts") + """
    select id_doc, md5(text) as text_md5 from texts where text ilike '%ING th%' order by id_doc limit 50""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_substring(frame(spark, sf, "texts"), "ing TH")
    return found.select("id_doc", F.md5("text").alias("text_md5"))


SQL_SNIPPETS = SQL_BEST + f"""
    , split as (select doc_id, string_split_regex(trim(text, chr(9) || chr(10) || chr(13) || ' '), '\\s+') as w
      from best join texts on doc_id = id_doc),
    words as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from split),
    marked as (select *, regexp_replace(translate(lower(word), '{MARKED}', '{PLAIN}'),
      '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') in ('the', 'tion', 'of') as hit from words),
    starts as (select distinct doc_id, greatest(0, least(i, n - 20)) as s from marked where hit),
    counted as (select starts.doc_id, s, count(*) as c from starts join marked on marked.doc_id = starts.doc_id and hit
      and i between s and s + 19 group by all),
    chosen as (select split.doc_id, coalesce(s, 0) as s from split left join (select * from counted
      qualify row_number() over (partition by doc_id order by c desc, s) = 1) using (doc_id))
, snippets as (select doc_id, concat(case when s > 0 then '...' else '' end, string_agg(case when hit then
      concat('<b>', word, '</b>') else word end, ' ' order by i), case when s + 20 < n then '...' else '' end) as snippet
    from marked join chosen using (doc_id) where i between s and s + 19 group by doc_id, s, n)"""


@query("snippet", SQL_SNIPPETS + "select doc_id, snippet from snippets")
def _(spark: SparkSession, sf: str) -> DataFrame:
    best = searched(spark, sf, QUERY, stemmed=False).join(searchable(spark, sf), "doc_id")
    return best.select("doc_id", search.snippet(F.col("text"), QUERY).alias("snippet"))


@query("search_results", SQL_SNIPPETS + f"""
    select row_number() over (order by score desc, doc_id) as rank, doc_id, {SQL_NAMES} as filename, snippet, score
    from best join snippets using (doc_id) join texts on id_doc = doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """File name, snippet and rank of the best documents, over an index of names and texts that is stored first."""
    docs = searchable(spark, sf)
    lengths = cut_lineage(search.text_lengths(docs))
    found = search.search_results(cut_lineage(indexed(spark, sf, stemmed=False)), docs, QUERY, stemmed=False,
                                  lengths=lengths)
    return found.withColumn("score", F.round("score", 6))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Words three to five of every fiftieth text, asked as a question."""
    asked = frame(spark, sf, "texts").filter("id_doc % 50 = 0")
    return asked.select(F.col("id_doc").alias("question_id"), F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("q"))


SQL_MANY = ctes("texts") + SQL_INDEX + f"""
    , asked as (select id_doc as question_id, array_to_string(string_split(text, ' ')[3:5], ' ') as q from texts where id_doc % 50 = 0),
    wanted as (select distinct question_id, unnest(regexp_extract_all(translate(lower(q), '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+'))
      as term from asked),
    lengths as (select doc_id, sum(tf) as n_terms from postings group by doc_id),
    held as (select term, doc_id, sum(tf) as tf from postings where term in (select term from wanted) group by term, doc_id),
    rarity as (select term, count(*) as df from held group by term),
    scored as (select question_id, doc_id, count(*) as found, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 /
        (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))) as score
      from wanted join held using (term) join rarity using (term) join lengths using (doc_id),
        (select count(*) as n, avg(n_terms) as mean from lengths) group by question_id, doc_id)
    select question_id, row_number() over (partition by question_id order by round(score, 9) desc, doc_id) as rank, doc_id,
      round(score, 6) as score
    from scored join (select question_id, count(*) as n_wanted from wanted group by question_id) using (question_id) where found = n_wanted
    qualify rank <= 10"""


@query("search_many", SQL_MANY)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth text's words asked of all texts and file names, by a stored block index."""
    lengths = cut_lineage(search.text_lengths(searchable(spark, sf)))
    blocks = cut_lineage(blockmax.build_blocks(indexed(spark, sf, stemmed=False), lengths))
    best = blockmax.search_many(blocks, questions(spark, sf), blockmax.corpus_numbers(lengths), k=10, stemmed=False)
    return best.withColumn("score", F.round("score", 6))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "vectors").select("id", "e")


SQL_KNN = """, asked as (select id as query_id, e as q from vectors where id % 50 = 0)
    select query_id, rank, id, round(score, 6) as score from (select query_id, id, score, row_number() over
      (partition by query_id order by {order}, id) as rank from (select query_id, id, {score} as score
        from asked, vectors)) where rank <= {k}"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).filter("id % 50 = 0")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", places))


@query("knn_l2", ctes("vectors") + SQL_KNN.format(
    order="score", k=5, score="round(list_distance(cast(q as double[]), cast(e as double[])), 9)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(neighbours.knn_l2(asked(spark, sf), vectors(spark, sf), 5))


@query("knn_cells", ctes("vectors") + SQL_KNN.format(
    order="score", k=5, score="round(list_distance(cast(q as double[]), cast(e as double[])), 9)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same neighbours by pivots."""
    return rounded(cells.knn_cells(asked(spark, sf), cells.build_cells(vectors(spark, sf)), 5))


@query("knn_inner_product", ctes("vectors") + SQL_KNN.format(
    order="score desc", k=10, score="round(list_inner_product(cast(q as double[]), cast(e as double[])), 9)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(neighbours.knn_inner_product(asked(spark, sf), vectors(spark, sf), 10))


@query("similar_documents", ctes("vectors") + """
    , asked as (select id as query_id, e as q from vectors where id % 50 = 0)
    select query_id, rank, id, round(score, 4) as score from (select *, row_number() over (partition by query_id
      order by score desc, id) as rank from (select query_id, id,
        round(list_inner_product(cast(q as double[]), cast(e as double[])), 9) as score from asked, vectors))
    where rank <= 10 and id <> query_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_documents(vectors(spark, sf), asked(spark, sf).select("id"))


@query("l2_normalise", ctes("vectors") + """
    select id, round(list_sum(list_transform(list_transform(e, lambda x: cast(x as double) / norm), lambda x: x * x)), 6)
      as squared, round(cast(e[1] as double) / norm, 6) as first
    from (select *, sqrt(list_inner_product(cast(e as double[]), cast(e as double[]))) as norm from vectors)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    unit = vectors(spark, sf).select("id", l2_normalise(F.col("e")).alias("u"))
    squared = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x)
    return unit.select("id", F.round(squared, 6).alias("squared"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("zero_shot_labels", ctes("vectors") + """
    , labels as (select concat('L', vec_id) as label, embedding as l from embeddings where vec_id < 8),
    logits as (select id, labels.label, 100 * round(list_cosine_similarity(cast(e as double[]), cast(l as double[])), 9) as s
      from vectors, labels),
    scored as (select id, label, exp(s - max(s) over (partition by id)) as w from logits)
    select id, label, round(score, 6) as score from (select id, label, w / sum(w) over (partition by id) as score
      from scored) where score > 0.05""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = rows_if_small(frame(spark, sf, "embeddings").filter("vec_id < 8").select("vec_id", "embedding"), 64)
    labels = {f"L{r['vec_id']}": r["embedding"] for r in rows}
    rated = vectors(spark, sf).select("id", F.inline(neighbours.zero_shot_labels(F.col("e"), labels)))
    return rounded(rated)


SQL_NEAR_PAIRS = ctes("vectors") + """
    select a.id, min(b.id) as first_id from vectors a join vectors b on b.id < a.id and
      list_cosine_similarity(cast(a.e as double[]), cast(b.e as double[])) >= 0.985 group by a.id"""
SQL_NEAR_GROUPS = ctes("vectors").replace("with ", "with recursive ", 1) + """
    , near as (select b.id, list(a.id) as earlier from vectors a join vectors b on a.id < b.id and
        list_cosine_similarity(cast(a.e as double[]), cast(b.e as double[])) >= 0.985 group by b.id),
    ordered as (select vectors.id, coalesce(earlier, []) as earlier, row_number() over (order by vectors.id) as i
      from vectors left join near using (id)),
    scan as (select cast(0 as bigint) as i, cast([] as bigint[]) as primaries
      union all select ordered.i, case when list_has_any(primaries, earlier) then primaries
        else list_append(primaries, id) end from scan join ordered on ordered.i = scan.i + 1),
    final as (select primaries from scan order by i desc limit 1)
    select list_min(list_intersect(primaries, earlier)) as primary_id, id as duplicate_id from ordered, final
    where list_has_any(primaries, earlier)"""


@query("near_duplicate_pairs", SQL_NEAR_PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_duplicate_pairs(vectors(spark, sf))


@query("near_duplicate_pairs_fast", SQL_NEAR_PAIRS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """By the index: on these tables it finds all of them."""
    return nearcopies.near_duplicate_pairs_fast(vectors(spark, sf))


@query("near_duplicate_groups", SQL_NEAR_GROUPS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopies.near_duplicate_groups(vectors(spark, sf))


@query("near_duplicate_groups_fast", SQL_NEAR_GROUPS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopies.near_duplicate_groups_fast(vectors(spark, sf))


def letter_counts(texts: list[str]) -> np.ndarray:
    """A stand-in encoder: how often each letter a–z occurs, as a unit vector."""
    rows = np.array([[t.lower().count(chr(c)) for c in range(97, 123)] for t in texts], dtype="float32").reshape(-1, 26)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


SQL_LETTERS = """list_transform(range(97, 123), lambda c: length({t}) - length(replace({t}, chr(c::int), '')))"""


@query("incremental_embeddings", ctes("texts") + f"""
    , counted as (select id_doc, {SQL_LETTERS.format(t='lower(text)')} as v from texts)
    select concat('/inbox/', id_doc) as path, id_doc % 7 as mtime,
      round(v[5] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 3) as e from counted""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/inbox/"), "id_doc")
    items = frame(spark, sf, "texts").select(path.alias("path"), (F.col("id_doc") % 7).alias("mtime"), "text")
    cached = neighbours.embed(items.filter("mtime <> 3"), letter_counts).select(
        "path", F.least("mtime", F.lit(5)).alias("mtime"), "embedding")
    done = neighbours.incremental_embeddings(items, cached, letter_counts)
    return done.select("path", "mtime", F.round(F.get("embedding", F.lit(4)).cast("double"), 3).alias("e"))


@query("rebuild_index", ctes("docs", "texts") + f"""
    , cut as (select doc_id, (s - 1) // 1500 as chunk_no, substr(t, s, 1500) as chunk from (select doc_id, t,
        unnest(generate_series(1, length(t), 1500)) as s from (select doc_id, trim(text, chr(9) || chr(10) || chr(13) ||
          ' ') as t from docs join texts on doc_id = id_doc where length(text) > 0))),
    counted as (select *, {SQL_LETTERS.format(t='lower(chunk)')} as v from cut)
    select doc_id, chunk_no, length(chunk) as n_chars,
      round(v[5] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 3) as e from counted""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    index = neighbours.rebuild_index(frame(spark, sf, "docs"), frame(spark, sf, "texts"), letter_counts)
    return index.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint")
                        .alias("n_chars"), F.round(F.get("embedding", F.lit(4)).cast("double"), 3).alias("e"))


@query("encode", ctes("texts") + f"""
    , counted as (select id_doc, {SQL_LETTERS.format(t='lower(text)')} as v from texts)
    select id_doc, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 3) as a,
      round(v[20] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 3) as t from counted""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL function ``embed_text`` with a model that counts letters."""
    register_functions(spark, lambda: letter_counts)
    coded = spark.sql("select id_doc, embed_text(text) as e from {texts}", texts=frame(spark, sf, "texts"))
    return coded.select("id_doc", *[F.round(F.get("e", F.lit(i)).cast("double"), 3).alias(c) for i, c in
                                    ((0, "a"), (19, "t"))])


@query("stem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary of all texts and its stems, through the SQL function."""
    register_functions(spark)
    words = indexed(spark, sf, stemmed=False).select("term").distinct()
    return spark.sql("select term, stem(term) as stem from {words}", words=words)


@query("similarity_ratio")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name against its type, through the SQL function."""
    register_functions(spark)
    return spark.sql("select p_partkey, similarity_ratio(p_name, lower(p_type)) as ratio from {part}",
                     part=frame(spark, sf, "part"))

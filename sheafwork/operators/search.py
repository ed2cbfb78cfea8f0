"""Text index, ranked search, snippets and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions.text import bind, strip
from sheafwork.functions.tokens import MARKED, PLAIN, query_terms, stem, terms

K1, B = 1.2, 0.75
SNIPPET_TERMS = 20
CHUNK_CHARACTERS = 1500
CHUNK_MINIMUM = 20


def build_text_index(docs: DataFrame, fields: tuple[str, ...] = ("filename", "text"), stemmed: bool = True
                     ) -> DataFrame:
    """Postings (term, doc_id, field, tf).

    Terms are counted inside the task that reads the text, so what is shuffled is one row per document, field and word.
    Stems are taken on those rows, once per distinct word of a batch, and never by joining on the word: a word that is
    in every document would make one huge group.
    """
    per_field = [
        docs.select("doc_id", F.lit(f).alias("field"), F.explode(terms(F.coalesce(F.col(f), F.lit("")))).alias("term"))
        for f in fields
    ]
    words = per_field[0]
    for other in per_field[1:]:
        words = words.unionByName(other)
    counted = words.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"))
    if stemmed:
        counted = counted.withColumn("term", stem("term")).groupBy("doc_id", "field", "term").agg(
            F.sum("tf").alias("tf"))
    return counted.select("term", "doc_id", "field", "tf")


def document_lengths(postings: DataFrame) -> DataFrame:
    """Number of indexed terms per document, from the postings."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("n_terms"))


def text_lengths(docs: DataFrame, fields: tuple[str, ...] = ("filename", "text")) -> DataFrame:
    """The same numbers from the texts, without grouping anything; a text without terms has 0."""
    count = F.lit(0)
    for f in fields:
        count = count + F.size(terms(F.coalesce(F.col(f), F.lit(""))))
    return docs.select("doc_id", count.cast("bigint").alias("n_terms"))


def search_fulltext(postings: DataFrame, query: str, limit: int = 50, stemmed: bool = True,
                    lengths: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the best documents that hold every query term, by BM25 (k1 = 1.2, b = 0.75).

    The filter on the query's terms reaches the scan; only matching postings are grouped. Pass stored ``lengths`` to
    avoid reading all postings for the average length.
    """
    wanted = query_terms(query, stemmed)
    if not wanted:
        return postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    lengths = lengths if lengths is not None else document_lengths(postings)
    indexed = F.when(F.col("n_terms") > 0, F.col("n_terms"))
    corpus = lengths.agg(F.struct(F.count(indexed).alias("n"), F.avg(indexed).alias("mean"))).scalar()
    # one column per query term: a term found in most documents never becomes a group or a join key
    names = [f"tf_{i}" for i in range(len(wanted))]
    found = postings.filter(F.col("term").isin(*wanted)).groupBy("doc_id").agg(*[
        F.sum(F.when(F.col("term") == term, F.col("tf")).otherwise(0)).alias(name) for name, term in zip(names, wanted)])
    holders = found.agg(F.struct(*[F.count_if(F.col(name) > 0).alias(name) for name in names])).scalar()
    complete = found
    for name in names:
        complete = complete.filter(F.col(name) > 0)
    score = F.lit(0.0)
    for name in names:
        idf = F.log(1 + (corpus["n"] - holders[name] + 0.5) / (holders[name] + 0.5))
        score = score + idf * F.col(name) * (K1 + 1) / (
            F.col(name) + K1 * (1 - B + B * F.col("n_terms") / corpus["mean"]))
    scored = complete.join(lengths, "doc_id").select("doc_id", score.alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(limit)


def search_results(postings: DataFrame, docs: DataFrame, query: str, limit: int = 50, stemmed: bool = True,
                   lengths: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, filename, snippet, score) of the best documents, as a reader sees them.

    ``postings`` is an index over filename and text, ``docs`` has doc_id, filename and text. Only the ``limit`` best are
    ranked and joined with their texts.
    """
    best = search_fulltext(postings, query, limit, stemmed, lengths)
    order = Window.orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint"))
    found = ranked.join(docs.select("doc_id", "filename", "text"), "doc_id")
    return found.select("rank", "doc_id", "filename", snippet(F.col("text"), query, stemmed).alias("snippet"), "score")


def search_substring(texts: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Texts that contain the query, ignoring case; the smallest ids when there are more than the limit."""
    return texts.filter(F.col("text").ilike(f"%{query}%")).orderBy("id_doc").limit(limit)


def snippet(text: Column, query: str, stemmed: bool = False, size: int = SNIPPET_TERMS) -> Column:
    """The window of ``size`` words with the most query terms, hits in ``<b>``, ``...`` where text is left out.

    Words are separated by white space. With ``stemmed`` a word is a hit when it starts with a stem of the query.
    """
    wanted = query_terms(query, stemmed)

    def folded(word: Column) -> Column:
        return F.regexp_replace(F.translate(F.lower(word), MARKED, PLAIN), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")

    def is_hit(word: Column) -> Column:
        if not stemmed:
            return folded(word).isin(*wanted)
        hit = F.lit(False)
        for term in wanted:
            hit = hit | folded(word).startswith(term)
        return hit

    def window(words: Column) -> Column:
        n = F.size(words)
        at = F.filter(F.transform(words, lambda w, i: F.when(is_hit(w), i)), lambda i: i.isNotNull())

        def choose(hits: Column) -> Column:
            # hits ascend, so those of a window lie within ``size`` places of the hit it starts at
            def score(hit: Column, i: Column) -> Column:
                start = F.greatest(F.lit(0), F.least(hit, n - size))
                near = F.slice(hits, F.greatest(F.lit(1), i + 2 - size), F.lit(2 * size))
                inside = F.size(F.filter(near, lambda h: (h >= start) & (h < start + size)))
                return F.struct((-inside).alias("rank"), start.alias("start"))

            scored = F.transform(hits, score)
            return F.coalesce(F.array_min(scored)["start"], F.lit(0))

        def render(start: Column) -> Column:
            shown = F.transform(F.slice(words, start + 1, F.lit(size)), lambda w: F.when(
                is_hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
            return F.concat(F.when(start > 0, "...").otherwise(""), F.array_join(shown, " "),
                            F.when(start + size < n, "...").otherwise(""))

        return bind(bind(at, choose), render)

    return bind(F.split(strip(text), r"(?U)\s+"), window)


def chunks_of(text: Column, size: int = CHUNK_CHARACTERS, minimum: int = CHUNK_MINIMUM) -> Column:
    """Paragraphs longer than ``minimum`` characters, cut at ``size``; a text without any is cut as it stands."""
    def cut(paragraph: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(paragraph), F.lit(size))
        return F.transform(starts, lambda s: paragraph.substr(s, F.lit(size)))

    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > minimum)
    pieces = F.flatten(F.transform(paragraphs, cut))
    whole = F.when(F.length(text) > 0, cut(text)).otherwise(F.array().cast("array<string>"))
    return bind(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(whole))


def chunk_text(texts: DataFrame, size: int = CHUNK_CHARACTERS, minimum: int = CHUNK_MINIMUM) -> DataFrame:
    """One row per chunk: the columns of ``texts`` without the text, chunk number and chunk."""
    kept = [c for c in texts.columns if c != "text"]
    return texts.select(*kept, F.posexplode(chunks_of(F.col("text"), size, minimum)).alias("chunk_no", "chunk"))

"""Main text of pages by union-free regular expressions inferred from the pages of a host.

Every page is read once into the expression of its own structure (markup.py). The expressions of a host are aligned one
after the other: equal tokens match, texts become text slots, what some pages lack becomes optional, what repeats becomes a
repeated group. The result, the host's wrapper, has concatenation, ``?`` and ``+`` but no alternatives. Every page's
slots are matched to those of its host's wrapper, and the wrapper, with what all pages of the host have in its slots,
decides which slots are the article: those below article elements, or below main ones, or else, on pages that have neither, below the container
that holds most of the running text, where slots that say the same on every page are left out; never those below
elements whose tokens stand for menus, headers, footers, sidebars, notices, adverts, forms or comments.

A host may have a third of all pages. Only its different expressions are aligned, EXPRESSIONS at a time in a task, then
the partial wrappers in the same way; slot counts are sums with a map-side combine; and pages meet the decisions on (host, expression)
in a join that Spark broadcasts when it is small and splits where it is skewed.

Defined results: a null or empty page, or one without text, has the empty text. A null or odd url has the host ''. Repeated
rows and ids are rows like others. References are decoded, white space of a block is one space, blocks are joined by a line feed.
A line break element counts as white space. Elements nested deeper than markup.DEEPEST are passed through. Time and memory of a page are
proportional to its length. Other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.markup import Node, is_boilerplate, merge, read_expression, read_page, texts_of, write_expression
from sheafwork.session import cut_lineage

#: Different expressions of a host aligned in one task.
EXPRESSIONS = 64
#: A container goes on to the child that has so much of its running text.
MOST_OF_TEXT = 0.6
#: A slot is the template's when at least so many pages have it and all say the same.
SAME_ON = 3
#: Bytes of pages read between two Arrow batches.
BATCH_BYTES = 4 << 20

_PARSED = "page_id bigint, url string, host string, expression string, slots array<int>, links array<int>, texts array<string>"
#: Elements that hold blocks rather than being one.
_CONTAINERS = frozenset("page html body div section td tr tbody table center main article form () details figure".split())


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, host, expression, slots, links, texts): blocks of every page with the slots they fill."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            first = size = 0
            for i in range(batch.num_rows):
                page = batch.column(3)[i].as_py() or ""
                root, texts, linked = read_page(page)
                numbers: dict[int, int] = {}
                slots = [0] * len(texts)
                for n, text in enumerate(texts_of(root)):
                    numbers[id(text)] = n
                    for block in text.slots:
                        slots[block] = n
                expression = json.dumps(write_expression(root, lambda t: numbers[id(t)]), separators=(",", ":"), ensure_ascii=False)
                for column, value in zip(columns, (expression, slots, linked, texts)):
                    column.append(value)
                size += len(page)
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(k).slice(first, i + 1 - first) for k in range(3)), pa.array(columns[0], pa.string()),
                        pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32())),
                        pa.array(columns[3], pa.list_(pa.string()))],
                        names=["page_id", "url", "host", "expression", "slots", "links", "texts"])
                    columns, first, size = [[], [], [], []], i + 1, 0

    given = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                         host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    return given.mapInArrow(rows, _PARSED)


def generalise(expressions: list[str]) -> str:
    """One expression that has all of them: aligned one after the other, in the order given."""
    root = read_expression(json.loads(expressions[0]))
    for other in expressions[1:]:
        root = merge(root, read_expression(json.loads(other)))
    numbers = {id(t): n for n, t in enumerate(texts_of(root))}
    return json.dumps(write_expression(root, lambda t: numbers[id(t)]), separators=(",", ":"), ensure_ascii=False)


def infer_wrappers(expressions: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, expression, n): partial wrappers of EXPRESSIONS each, until a host has one."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "expression"], ascending=[False, True])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "expression": [generalise(group["expression"].tolist())],
                             "n": [group["n"].sum()]})

    left = expressions.select("host", "expression", "n")
    while True:
        per_host = left.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
        most = per_host.agg(F.max("of_host")).first()[0] or 1
        if most == 1:
            return left.select("host", F.col("expression").alias("wrapper"))
        parts = F.ceil(F.col("of_host") / F.lit(float(EXPRESSIONS)))
        dealt = left.join(per_host, "host").withColumn("part", F.pmod(F.xxhash64("expression"), parts))
        left = cut_lineage(dealt.select("host", "part", "expression", "n").groupBy("host", "part").applyInPandas(
            one, "host string, expression string, n bigint"))


def slot_map(wrapper: str, expression: str) -> list[int]:
    """For every slot of a page's expression the slot of the wrapper that it fills."""
    whole, own = read_expression(json.loads(wrapper)), read_expression(json.loads(expression))
    count, offset = len(texts_of(own)), len(texts_of(whole))
    for text in texts_of(own):
        text.slots = [offset + text.slots[0]]
    to = [0] * count
    for text in texts_of(merge(whole, own)):
        into = min(text.slots)
        for s in text.slots:
            if s >= offset:
                to[s - offset] = into if into < offset else -1
    return to


def article_slots(wrapper: str, present: set[int], chars: dict[int, int], links: dict[int, int], pages: dict[int, int],
                  same: set[int]) -> set[int]:
    """Which slots of a wrapper are the article of a page that has those in ``present``.

    ``same``: slots with one text on all pages of the host.
    """
    root = read_expression(json.loads(wrapper))

    def running(node: Node) -> int:
        return sum(max(0, chars.get(t.slots[0], 0) - links.get(t.slots[0], 0)) for t in texts_of(node))

    whole = max(1, running(root))
    asides: set[int] = set()

    def mark(node: Node) -> None:
        name = node.label.split(".")[0].split("@")[0].rstrip("!")
        # a class alone does not condemn what holds most of the page
        plain = is_boilerplate(name) or node.label.endswith("!")
        if node.label not in ("#", "()", "page") and is_boilerplate(node.label) and (plain or running(node) < 0.5 * whole):
            asides.update(t.slots[0] for t in texts_of(node))
        else:
            for k in node.kids:
                mark(k)

    mark(root)

    def clean(node: Node) -> list[int]:
        return [t.slots[0] for t in texts_of(node) if t.slots[0] in present and t.slots[0] not in asides]

    def outermost(node: Node, wanted: str) -> list[Node]:
        name = node.label.split(".")[0].split("@")[0]
        if (name == wanted or f"@{wanted}" in node.label) and clean(node):
            return [node]
        return [x for k in node.kids for x in outermost(k, wanted)]

    for wanted in ("article", "articlebody", "main"):
        if found := outermost(root, wanted):
            return {s for node in found for s in clean(node)}

    def mass(node: Node) -> int:
        return sum(max(0, chars.get(s, 0) - links.get(s, 0)) for s in clean(node))

    region = root
    while True:
        inner = [k for k in region.kids if k.label.split(".")[0].split("@")[0] in _CONTAINERS]
        best = max(inner, key=mass, default=None)
        if best is None or mass(best) < MOST_OF_TEXT * max(1, mass(region)):
            break
        region = best
    kept = set(clean(region))
    varied = {s for s in kept if s not in same}
    if varied:
        kept = {s for s in kept if s not in same or pages.get(s, 0) < SAME_ON}
    titles = {s for node in outermost(root, "h1") for s in clean(node)}
    return kept | {s for s in titles if s not in same or pages.get(s, 0) < SAME_ON}


def decisions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper) and (host, expression, keep): for every slot of an expression, whether it is the article's."""
    expressions = cut_lineage(parsed.groupBy("host", "expression").agg(F.count(F.lit(1)).alias("n")))
    wrappers = infer_wrappers(expressions)

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            maps = [slot_map(w, e) for w, e in zip(frame["wrapper"], frame["expression"])]
            yield pd.DataFrame({"host": frame["host"], "expression": frame["expression"], "to": maps})

    matched = cut_lineage(expressions.join(wrappers, "host").select("host", "expression", "wrapper").mapInPandas(
        match, "host string, expression string, to array<int>"))
    blocks = parsed.select("host", "expression", F.explode(F.arrays_zip("slots", "links", "texts")).alias("b"))
    blocks = blocks.select("host", "expression", "b.slots", "b.links", F.length("b.texts").alias("chars"),
                           F.xxhash64("b.texts").alias("h"))
    per_slot = blocks.groupBy("host", "expression", "slots").agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.count(F.lit(1)).alias("n"), F.min("h").alias("low"),
        F.max("h").alias("high"))
    placed = per_slot.join(matched, ["host", "expression"]).withColumn("slot", F.get("to", F.col("slots")))
    held = placed.groupBy("host", "slot").agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("n").alias("n"),
        (F.min("low") == F.max("high")).alias("same"))
    listed = held.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links", "n", "same")).alias("held"))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = []
            for wrapper, to, held in zip(frame["wrapper"], frame["to"], frame["held"]):
                rows = [] if held is None else [r if isinstance(r, dict) else r.asDict() for r in held]
                own = [int(t) for t in to]
                article = article_slots(wrapper, set(own), *({r["slot"]: r[c] for r in rows} for c in ("chars", "links", "n")),
                                        {r["slot"] for r in rows if r["same"]})
                kept.append([t in article or t < 0 for t in own])
            yield pd.DataFrame({"host": frame["host"], "expression": frame["expression"], "keep": kept})

    ready = matched.join(wrappers, "host").join(listed, "host", "left")
    return wrappers, ready.select("host", "expression", "wrapper", "to", "held").mapInPandas(
        decide, "host string, expression string, keep array<boolean>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of all pages."""
    parsed = cut_lineage(parsed_pages(pages, page_id, url, html))
    _, keep = decisions(parsed)
    keep = cut_lineage(keep)
    joined = parsed.join(keep, ["host", "expression"], "left")
    blocks = F.filter(F.arrays_zip("slots", "texts"), lambda b: F.coalesce(F.get("keep", b["slots"]), F.lit(False)))
    text = F.array_join(F.transform(blocks, lambda b: b["texts"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))

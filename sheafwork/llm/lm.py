"""Language-model scores of whole texts by a weighted backoff automaton.

The automaton's states are the root and one state per word seen before another token in the training texts. State u has
an arc for every token w that followed u, weighted log p(w|u) with p(w|u) = (max(c(u,w) - D, 0) + D T(u) p(w)) / c(u),
and a failure arc to the root, weighted log (D T(u) / c(u)); T(u) is the number of different tokens that followed u.
The root has an arc per known token, p(w) = (c(w) - D) / N, and one for everything unknown, D V / N. These sum to one.
A text is read once from left to right from the state of text begins: an arc, or the failure arc and then a root arc,
and reading w leads to state w. A text ends with an end token, which is predicted like a word.

Neither the words nor the pairs of a corpus have a bound, so no task holds the model. Documents are dealt to blocks of
bounded text. A block sends its distinct words and pairs, with their counts in its training texts, to parts chosen by
the hash of the first word; a part adds up what all blocks sent and answers each block, entry by entry; the block's
documents are then scored with the states and arcs they can reach. Entries travel as packed arrays, one row per block
and part. Words are pre-aggregated per block, so a very common word or pair costs an entry per block, not per token.

Defined results: a null or empty text is the end token alone; a null doc_id is trained on; repeated rows are counted and
scored as often as they occur; without training texts all scores are 0; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import blocks_for
from sheafwork.llm.words import mix, words_of

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
#: Text bytes of a block; a part gets about as many entries as a block sends.
BLOCK_BYTES = 8 << 20
_BEGIN, _END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xB5026F5AA96619E9)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class Tokens(NamedTuple):
    """A block's tokens as places in its sorted node table, and its distinct pairs."""

    nodes: np.ndarray  # sorted hashes of words, end and begin
    token: np.ndarray  # node of every token, texts one after the other
    pair: np.ndarray  # place in ``pairs`` of every token with the one before it
    pairs: np.ndarray  # sorted codes: node before * len(nodes) + node
    counts: np.ndarray  # tokens of each text


def tokens_of(texts: pa.Array) -> Tokens:
    found = words_of(texts, lower=True)
    counts = found.counts + 1
    ends = np.cumsum(counts) - 1
    flat = np.full(int(counts.sum()), _END, dtype=np.uint64)
    is_word = np.ones(len(flat), dtype=bool)
    is_word[ends] = False
    flat[is_word] = found.hashes
    nodes, token = np.unique(np.append(flat, _BEGIN), return_inverse=True)
    begin, token = token[-1], token[:-1]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - counts + 1] = begin
    pairs, pair = np.unique(before * len(nodes) + token, return_inverse=True)
    return Tokens(nodes, token.astype(np.int32), pair.astype(np.int32), pairs, counts)


def _parts_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's nodes begin among the sorted ones: parts are equal ranges of the hash."""
    return np.searchsorted((nodes >> np.uint64(32)).astype(np.int64) * parts >> 32, np.arange(parts + 1))


def _small(values: np.ndarray) -> bytes:
    """Counts as one byte each, which says 255 where the count follows in full behind them."""
    large = np.flatnonzero(values >= 255)
    return b"".join((np.minimum(values, 255).astype("u1").tobytes(), np.array([len(large)], dtype="<u4").tobytes(),
                     values[large].astype("<u8").tobytes()))


def _requests(tokens: Tokens, train: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, payload): nodes, their training counts and followers, and for each pair a 40-bit key and its count.

    A key tells apart the pairs of one first word, which the payload names in full.
    """
    n = len(tokens.nodes)
    trained = np.repeat(train, tokens.counts)
    of_node = np.bincount(tokens.token[trained], minlength=n)
    of_pair = np.bincount(tokens.pair[trained], minlength=len(tokens.pairs))
    before = tokens.pairs // n
    key = mix(tokens.nodes[before] * _PAIR + tokens.nodes[tokens.pairs % n]) >> np.uint64(24)
    followers = np.bincount(before, minlength=n)
    first_pair = np.concatenate(([0], np.cumsum(followers, dtype=np.int64)))
    cut = _parts_of(tokens.nodes, parts)
    for part, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if a < b:
            p, q = int(first_pair[a]), int(first_pair[b])
            yield part, b"".join((
                np.array([b - a, q - p], dtype="<u4").tobytes(), tokens.nodes[a:b].astype("<u8").tobytes(),
                _small(of_node[a:b]), _small(followers[a:b]), (key[p:q] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                (key[p:q] >> np.uint64(32)).astype("u1").tobytes(), _small(of_pair[p:q])))


def _take(payload: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays that stand one after the other behind the two lengths of a payload; kind ``small`` is what ``_small`` made."""
    at, out = 8, []

    def plain(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(payload, kind, n, at)
        at += part.nbytes
        return part

    for kind, n in kinds:
        if kind == "small":
            values = plain("u1", n).astype(np.int64)
            values[values == 255] = plain("<u8", int(plain("<u4", 1)[0]))
            out.append(values)
        else:
            out.append(plain(kind, n))
    return out


def _lengths(payload: bytes) -> tuple[int, int]:
    n, m = np.frombuffer(payload, "<u4", 2).tolist()
    return n, m


def _answer(payloads: list[bytes]) -> list[bytes]:
    """One part: add up the requests of all blocks and answer each in its own order."""
    nodes, of_node, followers, keys, of_pair = [], [], [], [], []
    for payload in payloads:
        n, m = _lengths(payload)
        a, b, c, low, high, d = _take(payload, ("<u8", n), ("small", n), ("small", n), ("<u4", m), ("u1", m),
                                          ("small", m))
        nodes.append(a)
        of_node.append(b)
        followers.append(c)
        keys.append((high.astype(np.uint64) << np.uint64(32)) | low)
        of_pair.append(d)
    sizes = [(len(a), len(k)) for a, k in zip(nodes, keys)]
    known, node = np.unique(np.concatenate(nodes), return_inverse=True)
    count = np.bincount(node, weights=np.concatenate(of_node)).astype(np.int64)
    code = np.repeat(node, np.concatenate(followers)).astype(np.uint64) << np.uint64(40)
    code |= np.concatenate(keys)
    pairs, pair = np.unique(code, return_inverse=True)
    of_pair_all = np.bincount(pair, weights=np.concatenate(of_pair), minlength=len(pairs)).astype(np.int64)
    followed = (pairs >> np.uint64(40)).astype(np.int64)
    kinds = np.bincount(followed, weights=of_pair_all > 0, minlength=len(known)).astype(np.int64)
    out, i, j = [], 0, 0
    for n, m in sizes:
        mine = node[i:i + n]
        out.append(b"".join((np.array([n, m], dtype="<u4").tobytes(), _small(count[mine]), _small(kinds[mine]),
                             _small(of_pair_all[pair[j:j + m]]))))
        i, j = i + n, j + m
    return out


class Model(NamedTuple):
    """The whole corpus in four numbers, and the discounts they give."""

    tokens: int
    kinds: int
    discount_root: float
    discount: float = DISCOUNT


def _scores(tokens: Tokens, answers: list[bytes], model: Model) -> dict[str, np.ndarray]:
    """Sums per text over its tokens; ``answers`` in ascending order of parts."""
    of_node, kinds, of_pair = [], [], []
    for payload in answers:
        n, m = _lengths(payload)
        for into, part in zip((of_node, kinds, of_pair), _take(payload, ("small", n), ("small", n), ("small", m))):
            into.append(part)
    count = np.concatenate(of_node).astype(np.float64)
    seen = count[tokens.token]
    # a word is followed as often as it occurs; texts begin as often as they end
    count[np.searchsorted(tokens.nodes, _BEGIN)] = count[np.searchsorted(tokens.nodes, _END)]
    count[np.searchsorted(tokens.nodes, _END)] = 0
    before = (tokens.pairs // len(tokens.nodes))[tokens.pair]
    u, t = count[before], np.concatenate(kinds).astype(np.float64)[before]
    both = np.concatenate(of_pair).astype(np.float64)[tokens.pair]
    known = seen > 0
    if model.tokens:
        root = np.where(known, seen - model.discount_root, model.discount_root * model.kinds) / model.tokens
        arc = (np.maximum(both - model.discount, 0) + model.discount * t * root) / np.maximum(u, 1)
        log = np.log10(np.where(u > 0, arc, root))
    else:
        log = np.zeros(len(seen))
    base = np.log10((seen + 1) / (model.tokens + model.kinds + 1))
    at = np.cumsum(tokens.counts) - tokens.counts
    return {"n_known": np.add.reduceat(known.astype(np.int64), at), "base": np.add.reduceat(base, at),
            "score": np.add.reduceat(log, at)}


def root_model(rows: DataFrame) -> Model:
    """Tokens, kinds and the root's discount of the training texts. ``rows`` has text and train.

    Words are added up per batch before the shuffle; four sums reach the driver.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (b.column(0).slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            words = words_of(texts, lower=True)
            kinds, counts = np.unique(np.append(words.hashes, _END), return_counts=True)
            counts[np.searchsorted(kinds, _END)] += len(texts) - 1
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(counts)], names=["word", "n"])

    words = rows.filter("train").select("text").mapInArrow(body, "word bigint, n bigint")
    totals = words.groupBy("word").agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice")).first()
    once, twice = totals["once"], totals["twice"]
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
    return Model(totals["tokens"] or 0, totals["kinds"], discount)


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``base_score`` adds log10 of (c + 1) / (N + V + 1) per token, ``score`` the automaton's log10 probabilities.
    """
    held = is_held_out(F.col(doc_id)) if held_out is None else held_out
    body = F.col(text)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("text"), (~held).alias("train"))
    blocks = blocks_for(rows, "text", block_bytes)
    model = root_model(rows)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        train = np.asarray(group["train"]).astype(bool)
        asked = list(_requests(tokens_of(_column(group, "text")), train, blocks))
        block = group["block"][0].as_py()
        return pa.table({"part": pa.array([p for p, _ in asked], pa.int32()),
                         "block": pa.array([block] * len(asked), pa.int32()),
                         "payload": pa.array([x for _, x in asked], pa.large_binary()).cast(pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        answers = _answer(group["payload"].to_pylist())
        return pa.table({"block": group["block"], "part": group["part"], "payload": pa.array(answers, pa.binary())})

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in result})
        tokens = tokens_of(_column(group, "text"))
        ordered = answers.sort_by("part")["payload"].to_pylist()
        sums = _scores(tokens, ordered, model)
        return pa.table([group["doc_id"], group["train"], pa.array(tokens.counts, pa.int64()),
                         pa.array(sums["n_known"], pa.int64()), pa.array(sums["base"]), pa.array(sums["score"])],
                        names=[name for name, _ in result])

    result = [("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
              ("base_score", pa.float64()), ("score", pa.float64())]
    asked = dealt.groupBy("block").applyInArrow(ask, "part int, block int, payload binary")
    answered = asked.groupBy("part").applyInArrow(add, "block int, part int, payload binary")
    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        score, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array, whatever its chunks hold together."""
    column = table[name].cast(pa.large_string())
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)

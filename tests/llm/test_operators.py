"""Every operator against a plain model or a library, and on the odd and the empty table."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sheafwork.llm import (chat, decontaminate, jaccard, licenses, lm, oracles, pieces, quality, repair, sharding,
                           tokencount)
from sheafwork.llm.components import components

PATTERN = public_tokenizers.PATTERN


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# quality rules -------------------------------------------------------------------------------------------------------

def judged(docs):
    df, name = quality.judge(docs)
    return df.select("doc_id", "text", "source", f"{name}.*")


def test_quality_measures(odd):
    for r in judged(odd).collect():
        counts = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert counts == brute.quality(r["text"])
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    assert judged(odd).count() == odd.count()


def test_quality_verdict_needs_a_bad_host_and_a_bad_document(spark, documents):
    clean = documents.limit(1).first()["text"]
    symbols = "a # b " * 40 + " ".join(f"w{i}x" for i in range(200))  # fails a soft rule only
    data = [(i, symbols, "bad") for i in range(60)] + [(100, clean * 1, "bad")]
    data += [(200 + i, " ".join(f"word{i}{j}" for j in range(80)), "good") for i in range(60)] + [(300, symbols, "good")]
    docs = spark.createDataFrame([(i, t.replace("a # b ", f"a{i} # b{i} "), s) for i, t, s in data],
                                 "doc_id int, text string, source string")
    result = {r["doc_id"]: r for r in judged(docs).collect()}
    assert not any(r["base_failed"] for i, r in result.items() if i < 60)
    assert not any(result[i]["kept"] for i in range(60))
    assert result[300]["kept"] and all(result[200 + i]["kept"] for i in range(60))
    verdicts = {(r["host"], r["rule"]): r for r in quality.host_verdicts(docs).collect()}
    assert verdicts["bad", "symbols"]["condemned"] and not verdicts["good", "symbols"]["condemned"]
    assert verdicts["bad", "symbols"]["rate"] < verdicts["bad", "symbols"]["failed"] / verdicts["bad", "symbols"]["n"]


def test_quality_passing_keeps_columns(odd):
    kept = quality.passing(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 2, 2, 10]


# chat ----------------------------------------------------------------------------------------------------------------

CHAT_ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <s> [INST]"), (1, 2, None, None), (1, 3, "assistant", ""),
             (2, None, "system", "</s>"), (None, 0, "assistant", "😀 x" * 50), (3, 0, "assistant", "long " * 30_000),
             (4, 0, "user", "same"), (4, 0, "user", "same")]


def test_escape_is_reversible_and_leaves_no_mark():
    r = random.Random(3)
    parts = ["\\", *chat.CONTROL, "<", "[", "s>", "/", "a", "\n", "é"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL)


@pytest.mark.parametrize("part_tokens", [8, 1 << 16])
def test_chat_round_trip(spark, paths, part_tokens):
    turns = spark.createDataFrame(CHAT_ROWS, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS ids", "2 AS mask", "3 AS part")
    made = chat.format_conversations(turns, paths["byte_bpe_50k.tiktoken"], PATTERN, part_tokens=part_tokens)
    back = {r["conv_id"]: r for r in chat.read_back(made, paths["byte_bpe_50k.tiktoken"], PATTERN).collect()}
    for conv in {c for c, *_ in CHAT_ROWS}:
        mine = [(role or "", text or "") for c, _, role, text in CHAT_ROWS if c == conv]
        loss = "".join(t for role, t in mine if role == "assistant")
        r = back[conv]
        assert r["n_turns"] == len(mine) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == 3 + sum(17 + len(chat.escape(a)) + len(chat.escape(b)) for a, b in mine)
    if part_tokens == 8:
        assert made.groupBy("conv_id").count().filter("count > 1").count() >= 1


def test_chat_empty(spark, paths):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(turns, paths["byte_bpe_50k.tiktoken"], PATTERN)
    assert chat.read_back(made, paths["byte_bpe_50k.tiktoken"], PATTERN).count() == 0


# pieces and token counts ---------------------------------------------------------------------------------------------

def test_pieces_score_like_the_library(documents, paths):
    from tokenizers import Tokenizer, models

    own = pieces.Segmenter(paths["piece_bpe_32k.model"])
    vocabulary = [(p, s) for p, (s, _) in own.vocabulary.scores.items()]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0))
    score, name = dict(vocabulary), {i: p for p, (_, i) in own.vocabulary.scores.items()}
    texts = [r["text"] for r in documents.select("text").limit(60).collect()]
    for text, ids in zip(texts, own.encode(pa.array(texts)).to_pylist()):
        theirs = library.encode(pieces.MARK + text.replace(" ", pieces.MARK)).tokens
        assert sum(score.get(t, 0) for t in theirs) == pytest.approx(sum(score[name[i]] for i in ids if i in name))


def test_pieces_give_texts_back(odd, paths):
    path = paths["piece_bpe_32k.model"]
    encoded, ids = pieces.with_ids(odd, path)
    assert ids != "ids" and set(odd.columns) < set(encoded.columns)
    back = encoded.select("text", ids, pieces.piece_text(encoded[ids], path).alias("back")).collect()
    assert len(back) == odd.count()
    for r in back:
        assert r["back"] == r["text"]
        assert (r[ids] is None) == (r["text"] is None) and (r["text"] != "" or r[ids] == [])


def test_counts_are_lengths_of_encodings(odd, documents, paths):
    path = paths["piece_bpe_32k.model"]
    both = odd.select("doc_id", "text").union(documents.select("doc_id", "text"))
    counted = rows(tokencount.token_counts(both, path), "doc_id", "n_tokens")
    encoded, ids = pieces.with_ids(both, path)
    assert counted == rows(encoded.selectExpr("doc_id", f"cast(coalesce(size({ids}), 0) as bigint) as n"), "doc_id", "n")


def test_trie_shares_prefixes_with_long_and_odd_words(paths):
    counter, segmenter = (f(paths["piece_bpe_32k.model"]) for f in (tokencount.TokenCounter, pieces.Segmenter))
    words = ["", "a", "ab", "abc", "abd", "  abc", "é" * 70, "x" * 200, "▁", "\x01", "日本語", "日本", "\n"]
    assert counter.count(words).tolist() == [len(segmenter.segment(w)) for w in words]


# set similarity ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("size", [6, 7, 9, 14, 40, 150])
def test_signatures_miss_no_link(size, many):
    r = random.Random(size)
    base, sets = [r.getrandbits(63) for _ in range(size)], []
    for _ in range(60):
        s = set(base)
        for _ in range(r.randint(0, int(size * .22) + 1)):
            s.discard(r.choice(sorted(s))) if r.random() < .5 and len(s) > 1 else s.add(r.getrandbits(63))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    scheme = jaccard.Scheme(85, {k: 10**9 for k in range(100)} if many else {})
    signatures = [set(scheme.signatures(s).tolist()) for s in sets]
    for i in range(60):
        for j in range(i):
            a = len(np.intersect1d(sets[i], sets[j]))
            u = len(sets[i]) + len(sets[j]) - a
            assert not (100 * a >= 85 * u and a < u) or signatures[i] & signatures[j]


@pytest.mark.parametrize("share", [0, .1, .5, .9, 1])
@pytest.mark.parametrize("size", [6, 14, 40, 150, 700])
def test_signatures_with_common_shingles_miss_no_link(size, share):
    r = random.Random(size)
    base, sets = [r.getrandbits(63) for _ in range(size)], []
    pool = [r.getrandbits(63) for _ in range(size)]
    for _ in range(40):
        s = set(base)
        for _ in range(r.randint(0, int(size * .22) + 1)):
            s.discard(r.choice(sorted(s))) if r.random() < .5 and len(s) > 1 else s.add(r.choice(pool))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    common = np.array(sorted(x for x in base + pool if r.random() < share), dtype=np.uint64)
    scheme = jaccard.Scheme(80, {k: 10**9 for k in range(100)}, common)
    signatures = [set(scheme.signatures(s).tolist()) for s in sets]
    for i in range(40):
        for j in range(i):
            a = len(np.intersect1d(sets[i], sets[j]))
            u = len(sets[i]) + len(sets[j]) - a
            assert not (100 * a >= 80 * u and a < u) or signatures[i] & signatures[j]


def test_a_common_line_proposes_nothing():
    """Signatures of sets that have only a line in common, once its shingles are known: none is shared."""
    r = random.Random(3)
    line = [r.getrandbits(63) for _ in range(12)]
    sets = [np.array(sorted({*line, *(r.getrandbits(63) for _ in range(180))}), dtype=np.uint64) for _ in range(60)]
    common = np.array(sorted(line), dtype=np.uint64)
    shared = [Counter(s for x in sets for s in set(jaccard.Scheme(80, {k: 10**6 for k in range(60)}, c).signatures(x).tolist()))
              for c in (None, common)]
    assert max(shared[0].values()) > 3 and max(shared[1].values()) == 1


def test_common_shingles_are_counted(spark):
    """Each distinct set counts once, however often its text occurs."""
    docs = spark.createDataFrame([(i, f"the same four words w{i} x{i} y{i} z{i}") for i in range(90)]
                                 + [(1000 + i, "this text is a copy and a copy only") for i in range(300)], "doc_id bigint, text string")
    counts = jaccard._sets_and_counts(docs.coalesce(1), "doc_id", "text", 4).filter("n_shingles is null")
    line = jaccard.shingles_of(pa.array(["the same four words"]), 4)[0]
    assert jaccard._common(counts, 91).tolist() == line.tolist()
    assert jaccard._common(counts.filter("false"), 0).tolist() == []


def test_stars_follow_most_shared_signatures(spark):
    """A near copy goes to the set it shares most signatures with, not to an earlier one that it meets by chance."""
    shared = spark.createDataFrame([(8, 1, 1), (8, 5, 40), (9, 5, 30), (9, 2, 1), (5, 3, 1), (10, 9, 35), (10, 5, 3)],
                                   "u bigint, v bigint, w bigint")
    weights = spark.createDataFrame([(i, 200) for i in range(1, 11)], "node bigint, weight bigint")
    assert dict(rows(jaccard._centers(shared, weights, 80), "node", "component")) == {5: 5, 8: 5, 9: 9, 10: 9}


def test_fine_sketches_dismiss_only_pairs_apart(spark):
    r = random.Random(8)
    base = [r.getrandbits(63) for _ in range(7000)]
    sets = [base, base[400:], base[:3000], base[:6300] + [r.getrandbits(63) for _ in range(700)],
            *[[r.getrandbits(63) for _ in range(n)] for n in (6900, 7000, 1100)], base[:900]]
    sets = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    info = spark.createDataFrame([(i, len(s) if i != 3 else -1, bytearray(f) if (f := jaccard._sketches(s)[1]) else None)
                                  for i, s in enumerate(sets)], "node bigint, size bigint, fine binary")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i)], "x bigint, y bigint")
    kept = set(rows(jaccard._not_apart(pairs, info, 80), "x", "y"))
    for i, j in rows(pairs, "x", "y"):
        a, both = len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])
        assert 180 * a < 80 * both or (i, j) in kept
        assert jaccard._sketches(sets[i])[1] is None or jaccard._sketches(sets[j])[1] is None or jaccard._apart(
            jaccard._sketches(sets[i])[1], jaccard._sketches(sets[j])[1]) <= both - 2 * a
    assert (5, 4) not in kept and (5, 0) not in kept and (3, 0) in kept and (7, 0) in kept


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 60])
def test_components_are_those_of_all_pairs(spark, block, monkeypatch):
    if block == 60:  # the way beyond the broadcast bound
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    r = random.Random(11)
    data = []
    for family in range(12):
        text = [f"f{family}w{i}" for i in range(r.choice([8, 20, 60]))]
        for _ in range(8):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            data.append((len(data), " ".join(copy)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    found = {a: c for a, c in rows(jaccard.similar_components(docs, block=block), "doc_id", "component_id")}
    assert found == brute.components(data, 4, 85)
    found = {a: c for a, c in rows(jaccard.similar_components(docs, percent=80, words=5, block=block),
                                   "doc_id", "component_id")}
    assert found == brute.components(data, 5, 80)


def test_components_odd(odd):
    found = rows(jaccard.similar_components(odd), "doc_id", "n_shingles", "component_id")
    by_id = {a: c for a, _, c in found}
    assert len(found) == odd.count()
    assert by_id == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 1, None: None}
    kept = jaccard.one_per_component(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 9]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u int, v int")
    found = dict(rows(components(edges), "node", "component"))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_sets_are_proposed_once(spark, monkeypatch):
    """Sets that share hundreds of signatures without linking: a pair comes once, not once per task that holds a signature of it."""
    base = [f"w{i}" for i in range(600)]
    texts = {k: [f"x{k}" if i % 100 == 7 * k + 7 else w for i, w in enumerate(base)] + [f"y{k}_{i}" for i in range(6)] for k in range(6)}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id bigint, text string")
    made, write = [], jaccard.cut_lineage

    def kept(df):
        out = write(df)
        if out.columns == ["x", "y", "more"]:
            made.append(out)
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = {a: c for a, c in rows(jaccard.similar_components(docs), "doc_id", "component_id")}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.shuffle.partitions")
    assert found == {k: k for k in texts}
    assert made and 0 < made[0].count() <= 3 * made[0].select("x", "y").distinct().count()


def test_jaccard_sql(documents, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    theirs = sorted(duck.execute(f"select doc_id, n_shingles, component_id from ({oracles.JACCARD})").fetchall())
    assert rows(jaccard.similar_components(documents), "doc_id", "n_shingles", "component_id") == sorted(theirs, key=repr)


# token files ---------------------------------------------------------------------------------------------------------

def test_token_files(odd, documents, paths, tmp_path):
    from tokenizers import Tokenizer

    path = paths["word_bpe_49k.json"]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for docs, options in ((odd, {"block_ids": 200}), (documents, {"partition_bytes": 100_000, "block_ids": 5_000})):
        data = docs.select("doc_id", "text").collect()
        data = sorted(((r["doc_id"], r["text"]) for r in data), key=lambda r: (r[0] is not None, r[0] or 0,
                                                                             r[1] is not None, (r[1] or "").encode()))
        found = sorted(repair.through_files(docs, path, **options).collect(), key=lambda r: r["start"])
        start = 0
        for r, (doc_id, text) in zip(found, data, strict=True):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
            assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            start += len(ids)


def test_block_random_access():
    r = random.Random(2)
    docs = [np.array([r.choice([5, 6, 7, 1, 49_000]) for _ in range(r.randint(0, 400))] + [1], dtype=np.int32)
            for _ in range(60)]
    flat, counts = np.concatenate(docs), np.array(list(map(len, docs)))
    for options in ({"least": 2}, {"least": 2, "rounds": 9, "most": 10_000}, {"rounds": 0}):
        payload = repair.pack(flat, counts, **options)
        block = repair.Block(payload)
        assert all(np.array_equal(a, b) for a, b in zip(block.documents(), docs))
        assert all(np.array_equal(block.document(i), d) for i, d in enumerate(docs))
        assert all(block.at(i, p) == docs[i][p] for i in range(0, 60, 7) for p in range(0, len(docs[i]), 13))
    runs = np.array([9] * 50 + [1], dtype=np.int32)
    assert np.array_equal(repair.Block(repair.pack(runs, np.array([51]), least=2)).document(0), runs)


def test_no_frequent_pair_is_left(monkeypatch):
    """Also with slots that many pairs share, where a frequent pair is followed by rare ones, and with few rules a round."""
    r = np.random.default_rng(3)
    often = np.concatenate([np.array([a, a + 300, 1]) for a in range(40, 340) for _ in range(20)])
    rare = np.stack((r.permutation(20_000) + 1_000, r.permutation(20_000) + 1_000, np.ones(20_000)), axis=1).ravel()
    ids = np.concatenate((often, rare)).astype(np.int32)
    first = np.array([0, len(ids)])
    for slots, options in ((20, {}), (4, {}), (20, {"most": 7}), (20, {"most": 20_000, "least": 1})):
        monkeypatch.setattr(repair, "_SLOTS", slots)
        symbols, pairs, _ = repair.compress(ids, first, **options)
        left = Counter((a, b) for a, b in zip(symbols.tolist(), symbols[1:].tolist()) if a != 1 and b != 1)
        assert max(left.values(), default=0) < options.get("least", repair.LEAST)
        assert {(a, a + 300) for a in range(40, 340)} <= set(map(tuple, pairs.tolist()))
        assert np.array_equal(repair.Block(repair.pack(ids, first[1:], **options)).document(0), ids)
    width = int(np.frombuffer(repair.pack(ids, first[1:], most=20_000, least=1), "<u4", 2)[1])
    assert width == 4


# language model ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_bytes", [lm.BLOCK_BYTES, 60_000])
def test_scores(odd, documents, block_bytes):
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text"))
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = brute.backoff([t for i, t in data if not brute.held_out(i)], lm.DISCOUNT)
    expected = sorted(((i, brute.held_out(i), *model.scores(t)) for i, t in data), key=lambda r: (repr(r[0]), r[2:]))
    found = lm.backoff_scores(docs, block_bytes=block_bytes).collect()
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in found),
                   key=lambda r: (repr(r[0]), r[2:]))
    assert {r["train_tokens"] for r in lm.backoff_scores(docs, block_bytes=block_bytes).collect()} == {model.n}
    for a, b in zip(found, expected, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    held = [r for r in found if r[1]]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)
    vocabulary = list(model.c)
    for u in (b" ", vocabulary[0], vocabulary[-1]):
        unknown = b"never seen"
        assert sum(model.arc(u, w) for w in [*vocabulary, unknown]) == pytest.approx(1)


def test_scores_without_training(spark):
    two = spark.createDataFrame([(i, "a b") for i in range(200) if brute.held_out(i)], "doc_id bigint, text string")
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in lm.backoff_scores(two).collect()} == {
        (0, 0, 0.0, 0.0)}


# sharding ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("per_bucket", [sharding.ROWS_PER_BUCKET, 5])
def test_shards(odd, documents, per_bucket):
    columns = ["doc_id", "text", "source"]
    for docs in (documents.select(columns), documents.selectExpr("doc_id", "text", "if(doc_id % 3 > 0, 'hot', source) source"),
                 odd):
        data = sharding.interleave(docs, 24, rows_per_bucket=per_bucket).collect()
        total = docs.count()
        sizes = Counter(r["shard"] for r in data)
        assert len(data) == total and max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
        for shard, n in sizes.items():
            assert sorted(r["slot"] for r in data if r["shard"] == shard) == list(range(n))
        sources = Counter(r["source"] for r in data)
        for shard in sizes:
            for source, n in sources.items():
                here = sum(r["shard"] == shard and r["source"] == source for r in data)
                assert abs(here - n * sizes[shard] / total) < 2 + len(sources) * n / total
        expected = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                          for r in docs.collect())
        assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in data) == expected
    plan = sharding.interleave(documents, 24)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# decontamination -----------------------------------------------------------------------------------------------------

def test_leaks(spark, documents, sf):
    r = random.Random(4)
    items = {i["item_id"]: i["text"] for i in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    host = documents.limit(1).first()["text"]
    planted, clean = [], [(900, None), (901, ""), (902, host), (903, "short")]

    def edited(text: str, edits: int) -> str:
        out = list(text)
        for _ in range(edits):
            k = r.randrange(len(out))
            out[k:k + 1] = r.choice([[], ["q"], [out[k], "q"]])
        return "".join(out)

    for item, text in list(items.items())[:20]:
        planted += [(item, host[:300] + text + host[300:], item), (100 + item, host[:50] + edited(text, len(text) // 30), item),
                    (200 + item, text.upper().replace(" ", "  \n"), item), (300 + item, text[:len(text) * 3 // 4], item)]
    longest = max(items.values(), key=len)
    planted = [p for p in planted if p[0] < 300 or len(p[1]) >= 150]
    docs = spark.createDataFrame([p[:2] for p in planted] + clean + [(950, ("x" * 9 + " ") * 300_000 + longest)],
                                 "doc_id bigint, text string")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    benchmark = benchmark.union(spark.createDataFrame([(None, "x" * 90), (77, None), (78, "tiny"), (79, "")],
                                                      benchmark.schema))
    for block in (decontaminate.BLOCK_CHARS, 1000):
        found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, benchmark, block_chars=block).collect()}
        assert {(d, i) for d, _, i in planted} | {(950, next(i for i, t in items.items() if t == longest))} == set(found)
    for d, text, item in [p for p in planted if p[0] < 100]:
        hit = found[d, item]
        assert hit["edits"] == 0 and text[hit["first"]:hit["last"]].strip() == items[item].strip()
    kept = decontaminate.clean(docs, benchmark)
    assert sorted(x["doc_id"] for x in kept.collect()) == [900, 901, 902, 903]


def test_leaks_of_short_parts(spark):
    """Every verbatim run of 59 characters, wherever it starts, also in items of less than a window."""
    r = random.Random(8)
    items = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for i, n in enumerate((233, 80, 60, 97))]
    windows = decontaminate.Windows(items)
    around = "".join(r.choice("0123456789") for _ in range(200))
    for i, text in items:
        for start in range(len(text) - 58):
            said = around + text[start:start + 59] + around
            ((item, first, last, edits),) = windows.search(said)
            assert item == i and 200 - 8 <= first < last <= 259 + 8 and last - first >= 40
    docs = spark.createDataFrame([(1, around + items[0][1][24:124] + around), (2, around)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(decontaminate.leaks(docs, benchmark), "doc_id", "item_id") == [(1, 0)]
    assert rows(decontaminate.clean(docs, benchmark), "doc_id") == [(2,)]


def test_alignment_finds_the_edit_distance():
    r = random.Random(9)
    for _ in range(60):
        window = [r.choice("abcd") for _ in range(40)]
        text = list(window)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(text))
            text[k:k + 1] = r.choice([[], ["z"], [text[k], "z"]])
        lead = r.randint(0, 3)
        text = ["y"] * lead + text + ["y"] * 5
        best = brute.edit_distance_inside("".join(window), "".join(text))
        found = decontaminate.align([ord(c) for c in window], [ord(c) for c in text], 4, lead - 6, lead + 6)
        assert (found[0] if found else 5) == min(best, 5)
        if found:
            assert brute.edit_distance_inside("".join(window), "".join(text[max(found[1], 0):found[2]])) == found[0]


def test_leaks_odd(odd, spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.leaks(odd, benchmark).count() == 0
    assert decontaminate.clean(odd, benchmark).count() == odd.count()
    assert decontaminate.clean(odd, benchmark.filter("false")).columns == odd.columns


# licenses ------------------------------------------------------------------------------------------------------------

def test_patience_is_ascending_and_equal():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randrange(12) for _ in range(r.randint(0, 25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_licenses(spark, odd):
    filler = "nothing to see here but words and more words of every kind "
    data, expected = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for j, body in enumerate((text, text.upper(), text * 2, " ".join(w for k, w in enumerate(words) if k % 12 != 11))):
            data.append((10 * i + j, filler * 3 + "\n" + body + "\n" + filler))
            expected[10 * i + j] = name
    data += [(900, filler * 50), (901, None), (902, "the license of the work")]
    found = {r["doc_id"]: r for r in licenses.license_scan(
        spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert {i: found[i]["license"] for i in expected} == expected
    assert all(found[i]["license"] is None and found[i]["coverage"] == 0 for i in (900, 901, 902))
    assert all(found[10 * i]["coverage"] == 1 for i in range(len(licenses.TEMPLATES)))
    assert rows(licenses.license_scan(odd), "license") == [(None,)] * odd.count()


def test_final_notice_lines_of_the_documents(spark, documents):
    """Every last line that says license or rights, as the given table has it, and what a license says besides."""
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "All-Rights-Reserved"}
    last = {r["doc_id"]: r["text"].split("\n")[-1] for r in documents.collect() if r["text"]}
    notices = {i: line for i, line in last.items() if "licen" in line.lower() or "rights" in line.lower()}
    assert set(notices.values()) <= set(lines)
    found = {r["doc_id"]: r for r in licenses.license_scan(documents).collect()}
    assert {i: found[i]["license"] for i in notices} == {i: lines[line] for i, line in notices.items()}
    words = ("Copyright 2020 The Authors. All rights reserved. Redistribution and use in source or binary forms, with or "
             "without modification, are permitted provided that the following conditions are met: Redistributions of source "
             "code must retain the above copyright notice, this list of conditions and the following disclaimer.")
    said = [(0, "some words here\nAll rights reserved."), (1, words), (2, "all the rights of way")]
    found = licenses.license_scan(spark.createDataFrame(said, "doc_id bigint, text string"))
    assert rows(found, "doc_id", "license") == [(0, "All-Rights-Reserved"), (1, "BSD"), (2, None)]


def test_all_notices_of_a_document(spark):
    mit, filler = "Released under the MIT License.", "words of every kind " * 20
    isc = next(text for name, text in licenses.TEMPLATES if name == "ISC").replace("/", " ").split()
    cut = " ".join(w for i, w in enumerate(isc) if i % 20 != 19)  # a long notice that is not quite whole
    said = [(0, f"{filler}{cut} {filler}{mit}"), (1, f"{mit} {filler}{mit}"), (2, f"{mit} {mit}"), (3, filler), (4, None)]
    docs = spark.createDataFrame(said, "doc_id bigint, text string")
    found = {r["doc_id"]: [tuple(n) for n in r["notices"]] for r in licenses.license_notices(docs).collect()}
    best = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert [n[0] for n in found[0]] == ["MIT", "ISC"] and found[0][0][1] == 1 > found[0][1][1] >= licenses.COVERAGE
    n, size = len(filler.split()), len(cut.split())
    assert found[0][0][2:] == (2 * n + size, 2 * n + size + 5) and found[0][1][2] == n
    assert sorted(n[2:] for n in found[1]) == [(0, 5), (5 + n, 10 + n)]
    assert sorted(n[2:] for n in found[2]) == [(0, 5), (5, 10)]
    assert found[3] == found[4] == []
    assert all(tuple(best[i][c] for c in ("license", "coverage", "first_word", "last_word")) == (found[i] or [
        (None, 0.0, 0, 0)])[0] for i in found)


# empty tables --------------------------------------------------------------------------------------------------------

def test_empty_tables(none, spark, sf, paths):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    for df in (judged(none), quality.passing(none), tokencount.token_counts(none, paths["piece_bpe_32k.model"]),
               jaccard.similar_components(none), jaccard.one_per_component(none),
               repair.through_files(none, paths["word_bpe_49k.json"]), lm.backoff_scores(none),
               sharding.interleave(none, 24), decontaminate.leaks(none, benchmark), licenses.license_scan(none),
               pieces.with_ids(none, paths["piece_bpe_32k.model"])[0]):
        assert df.count() == 0


def test_a_small_memory_changes_nothing(documents, paths):
    texts = pa.array([r["text"] for r in documents.select("text").collect()])
    for make, path in ((pieces.Segmenter, "piece_bpe_32k.model"), (tokencount.TokenCounter, "piece_bpe_32k.model")):
        small, large = make(paths[path]), make(paths[path])
        small.numbers.most = 500
        for at in range(0, len(texts), 40):
            part = texts.slice(at, 40)
            if make is pieces.Segmenter:
                assert small.encode(part).equals(large.encode(part))
            else:
                assert all(np.array_equal(a, b) for a, b in zip(small(part), large(part)))
        assert len(small.numbers.numbers) < len(large.numbers.numbers)

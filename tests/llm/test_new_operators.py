"""Hard negatives, resampling and page text against brute force and planted cases."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import hardnegatives, markup, resample, wrappers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# hard negatives ------------------------------------------------------------------------------------------------------

def plain_hard_negatives(data, positives=5, negatives=3, every=5):
    sound = {}
    for i, label, vector in data:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x * 256) for x in vector):
            continue
        sound[i] = min(sound.get(i, (label, vector)), (label, vector))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in sound.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items()
                        if i != a and len(w) == len(v) and -2**63 <= sum(x * y for x, y in zip(v, w)) < 2**63)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, i, rank, s[1], -p, -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("size", [1.0, 1e6, 8e8])
def test_hard_negatives_are_those_of_brute_force(spark, size):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    data = [(i, r.choice([0, 1, 2]), [size * (c + r.choice([0.0, 0.5, -0.25, r.gauss(0, 0.3)])) for c in r.choice(centres)])
            for i in range(300)]
    data += [(i + 300, data[i][1], data[i][2]) for i in range(40)]  # copies: ties go by id
    data += [(3, 0, data[3][2]), (5, data[5][1], data[5][2]), (400, None, [1.0] * 6), (401, 1, None), (402, 1, [1.0, None] * 3),
             (403, 1, [float("nan")] * 6), (404, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (405, 1, [1.0, 2.0]), (410, 0, [1.0, 2.5]),
             (415, 1, []), (420, 1, [0.0] * 6), (421, 2, [-1e-300] * 6), (425, 2, [1.7e308] * 6)]
    df = spark.createDataFrame([(i, label, v, 1, "x") for i, label, v in data],
                               "vec_id bigint, label int, embedding array<double>, score int, id string")
    for options in ({}, {"rows_per_block": 50, "anchors_per_block": 20}):
        found = hardnegatives.hard_negatives(df, F.col("id") % 5 == 0, **options)
        assert rows(found, *COLUMNS) == plain_hard_negatives(data)
    assert found.columns == list(COLUMNS)
    assert hardnegatives.hard_negatives(df.filter("false"), F.col("id") % 5 == 0).count() == 0
    assert hardnegatives.hard_negatives(df, F.col("id") < 0).count() == 0


def test_packed_products_are_exact():
    r = np.random.default_rng(5)
    for size, scale in ((64, 150), (1, 3), (3, 10**6), (5, 2**40), (7, 2**60), (0, 1)):
        for _ in range(5):
            a, b = (r.integers(-scale, scale + 1, (n, size)).astype(float) for n in (r.integers(1, 9), r.integers(1, 20)))
            scores, reach = hardnegatives.packed_products(a, b)
            plain = [[sum(int(x) * int(y) for x, y in zip(v, w)) for w in b.tolist()] for v in a.tolist()]
            assert scores.tolist() == plain and all(abs(s) <= reach for row in plain for s in row)
    extreme = np.full((2, 64), 4095.0) * np.array([[1], [-1]])
    assert hardnegatives.packed_products(extreme, extreme)[0].tolist() == [[64 * 4095**2, -64 * 4095**2], [-64 * 4095**2, 64 * 4095**2]]


def test_several_fields_fit_one_number():
    assert hardnegatives.field_layout(67_028) == (18, 3)
    assert hardnegatives.field_layout(1 << 54)[1] == 0
    for reach in (1, 5, 1000, 10**7):
        width, fields = hardnegatives.field_layout(reach)
        assert 2 * reach < 1 << width
        assert (reach << width * (fields - 1)) + sum(2 * reach << width * j for j in range(fields - 1)) < 1 << 53


# resampling ----------------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(data, target, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in data for f in plain_features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x, longest)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    scored = []
    for i, text in data:
        words, found = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((x for x in scored if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for rank, x in enumerate(fit[:len(fit) * percent // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in scored), key=repr)


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 97)])
def test_resampling_is_that_of_brute_force(spark, odd, longest, buckets):
    r = random.Random(6)
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    vocabulary = ["Oak", "elm7", "über", "日本", "x" * 60, "a", "B", "the"]
    data += [(100 + i, r.choice([" ", ", ", "\x7f"]).join(r.choices(vocabulary, k=r.choice([0, 5, 25, 60])))) for i in range(600)]
    data += data[40:60]
    target = ["Oak oak über", None, "", "the the the elm7 " * 9]
    docs = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id bigint, text string, score int, segment int").repartition(7)
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resample(docs, asked, longest=longest, buckets=buckets, percent=70)
    assert rows(found, "doc_id", "n_features", "weight", "score", "rank") == plain_resample(data, target, longest, buckets, percent=70)
    assert resample.resample(docs.filter("false"), asked).count() == 0
    assert {r["rank"] for r in resample.resample(docs, asked.filter("false"), percent=0).collect()} == {None}


def test_ranks_over_many_segments(spark):
    """Most scores are equal, so splitters fall among ties and go by id."""
    r = random.Random(7)
    data = [(r.randrange(5000), r.choice([5, 5, 5, 5, 5, -2, 9])) for _ in range(8000)]
    df = spark.createDataFrame([(i, 1, 0, s) for i, s in data], "doc_id bigint, n_features bigint, weight bigint, score bigint")
    for percent in (100, 63, 1):
        found = resample.ranked(df.repartition(5), F.col("doc_id") % 3 != 0, percent, rows_per_segment=100).collect()
        fit = sorted((-s, i) for i, s in data if i % 3)
        drawn = fit[:len(fit) * percent // 100]
        got = sorted((x["rank"], -x["score"], x["doc_id"]) for x in found if x["rank"] is not None)
        assert got == [(n, *x) for n, x in enumerate(drawn, 1)] and len(found) == len(data)


def test_crc_of_ranges():
    r = random.Random(8)
    data = bytes(r.randrange(256) for _ in range(3000))
    starts = np.array([r.randrange(2800) for _ in range(200)])
    lengths = np.array([r.choice([0, 1, 3, 8, 47, 48, 49, 190]) for _ in range(200)])
    found = resample.crc_of(np.frombuffer(data, dtype=np.uint8), starts, lengths)
    assert found.tolist() == [zlib.crc32(data[s:s + n]) for s, n in zip(starts, lengths)]


# page text -----------------------------------------------------------------------------------------------------------

def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id bigint, url string, html string, text string, host int")
    out = wrappers.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = {}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        found.setdefault(r["page_id"], []).append(r["text"])
    return found


def story(r, n):
    return [" ".join(r.choices(["river", "mill", "bridge", "vote", "é&ü", "<tag>", "grey", "evening"], k=r.randint(8, 40))) for _ in range(n)]


def article_page(title, blocks):
    body = "".join(f"<p>{html.escape(b)}</p>" if i % 3 else f"<p><b>{html.escape(b)}<br>" for i, b in enumerate(blocks))
    return (f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">'
            f'<nav><ul><li><a href="/">Home</a></li><li>x</li></ul></nav><div class="ad">Buy now</div><article><h1>{title}</h1>{body}'
            f'</article><footer>&copy; all</footer></body></html>')


def div_page(title, blocks, r):
    parts = "".join(f"<p>{html.escape(b)}</p>" if i % 4 else f"<h2>Part {title} {i}</h2>\n<p>{html.escape(b)}</p>" for i, b in enumerate(blocks))
    return (f'<html><body><div id="wrap-{r.randrange(99)}"><div class="top"><a href="/">Site</a> <a href="/b">More</a></div>'
            + '<div class="cookie-notice">We use cookies</div>' * r.randrange(2)
            + f'<div class="content"><h1>{title}</h1>{parts}<div class="fixed">Sign our letter, dear friend of this site.</div></div>'
            + '<div class="side"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div>'
            + f'<form><input name="q">Search this site {r.random()}</form><div id="comments"><p>{" ".join(story(r, 1)).replace("<", "")}</p></div></div></body>')


def div_text(title, blocks):
    out = [title]
    for i, b in enumerate(blocks):
        out += [b] if i % 4 else [f"Part {title} {i}", b]
    return "\n".join(out)


def test_text_of_planted_pages(spark):
    r = random.Random(9)
    pages, want = [], {}
    for i in range(60):
        blocks = story(r, r.randint(1, 9))
        pages.append((i, f"http://a.example.com/{i}", article_page(f"Title {i}", blocks)))
        want[i] = "\n".join([f"Title {i}", *blocks])
    for i in range(60, 100):
        blocks = story(r, r.randint(4, 9))
        pages.append((i, f"https://User@B.example.com:80/{i}", div_page(f"Head {i}", blocks, r)))
        want[i] = div_text(f"Head {i}", blocks)
    assert {i: t[0] for i, t in extracted(spark, pages).items()} == want


def test_text_of_odd_pages(spark):
    page = article_page("T", ["one two"])
    pages = [(1, None, page), (1, None, page), (2, "http://x/", None), (3, "http://x/", ""), (4, "http://x/", "  plain &amp; text\n here "),
             (5, "::", "<p>a<p>b<div>c"), (None, None, "<script>only</script>"), (6, "http://y", "<article><p>x <span hidden>no</span>y<br>z</p>tail"
              "<aside>no</aside></article>"), (7, "http://z", "<main>" + "<div>" * 3000 + "deep" + "</main>"), (8, "http://w", "<a <b <c"),
             (9, "http://v", "<body><h1>A&#x42;&nbsp;&bogus; &am</h1><table><tr><td>c1<td>c2</table></body>")]
    found = extracted(spark, pages)
    assert found[1] == ["T\none two"] * 2 and found[2] == found[3] == [""] and found[None] == [""]
    assert found[4] == ["plain & text here"] and found[5] == ["a\nb\nc"] and found[6] == ["x y z\ntail"] and found[7] == ["deep"]
    assert found[8] == ["<a <b <c"] and found[9] == ["AB &bogus; &am\nc1\nc2"]
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert wrappers.main_text(df).count() == 0


def test_wrappers_have_options_and_repeats(spark):
    same = lambda *pages: wrappers.generalise([wrappers.json.dumps(markup.write_expression(n, lambda t: 0))
                                               for n in (markup.read_page(p)[0] for p in pages)])
    shape = lambda w: markup.read_expression(wrappers.json.loads(w)).sig
    assert shape(same("<p>a</p><p>b</p>", "<p>c</p>")) == "page(p(#)+)"
    assert shape(same("<h1>t</h1><p>a</p>", "<h1>t</h1><ul><li>x</li></ul><p>a</p>")) == "page(h1(#) ul(li(#))? p(#))"
    assert shape(same("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>")) == "page(dl((dt(#) dd(#))+))"
    assert shape(same("<div><p>a</p></div><div><h2>b</h2><p>c</p></div>", "<div>d</div>")) == "page(div(h2(#)? p(#)? #?)+)"


def test_many_expressions_of_a_host(spark, monkeypatch):
    """More expressions than a task aligns: partial wrappers are aligned in turn."""
    monkeypatch.setattr(wrappers, "EXPRESSIONS", 3)
    r = random.Random(10)
    pages, want = [], {}
    for i in range(40):
        parts = r.sample(["h3", "ul", "table", "blockquote", "pre"], r.randint(0, 5))
        inner = "".join(f"<{p}><li>{p}{i}</li></{p}>" if p == "ul" else f"<{p}><tr><td>{p}{i}</table>" if p == "table" else f"<{p}>{p}{i}</{p}>"
                        for p in parts)
        pages.append((i, "http://h/", f"<nav>menu</nav><article><h1>t{i}</h1>{inner}</article><footer>f</footer>"))
        want[i] = [f"t{i}" + "".join(f"\n{p}{i}" for p in parts)]
    assert extracted(spark, pages) == want


def test_long_pages_take_time_in_proportion():
    for page in ("<p>word" * 100_000, "<a " * 200_000, "<a title=\"" * 100_000, "<div>" * 200_000, "<!--" * 200_000, "x <" * 300_000,
                 "<li><b>" * 100_000, "".join(f"<h{i % 5 + 1}>a</h{i % 5 + 1}><p>b" * (1 + i % 3) for i in range(15_000))):
        started = time.time()
        _, texts, linked = markup.read_page(page)
        assert time.time() - started < 10 and len(texts) == len(linked)
    assert pa.array(texts).null_count == 0

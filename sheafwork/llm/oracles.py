"""SQL that must give the same rows, for the queries that SQL can express.

The others need a tokenizer, crc32, an automaton or an alignment; tests/llm compares them with brute force.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i:i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, list(i) AS places FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, unnest(places) AS i FROM twice) CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
failed AS (
  SELECT *, unnest([
    {{'rule': 'base', 'failed': n_words < 50 OR 100 * n_repeat_words > 50 * n_words}},
    {{'rule': 'symbols', 'failed': 10 * n_symbols > n_words}},
    {{'rule': 'lines', 'failed': 10 * n_dup_lines > 3 * n_lines}},
    {{'rule': 'length', 'failed': word_chars < 2 * n_words OR word_chars > 12 * n_words}},
    {{'rule': 'repeats', 'failed': 100 * n_repeat_words > 20 * n_words}}]) AS r
  FROM m),
hosts AS (
  SELECT source, r.rule AS rule, count(*) AS n, count_if(r.failed) AS k FROM failed GROUP BY source, r.rule),
prior AS (
  SELECT rule, sum(k) / sum(n) AS mean,
         greatest(sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)), 1e-9) AS var
  FROM hosts GROUP BY rule),
weighed AS (
  SELECT source, rule, n, k, mean, greatest(mean * (1 - mean) / var - 1, 1.0) AS weight FROM hosts JOIN prior USING (rule)),
rates AS (SELECT *, (k + mean * weight) / (n + weight) AS rate FROM weighed),
condemned AS (
  SELECT source, rule FROM rates WHERE rate - 2.0 * sqrt(rate * (1 - rate) / (n + weight + 1)) > 0.5),
hit AS (
  SELECT DISTINCT f.doc_id FROM failed f JOIN condemned c ON c.source IS NOT DISTINCT FROM f.source AND c.rule = f.r.rule
  WHERE f.r.failed)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND hit.doc_id IS NULL AS kept
FROM m LEFT JOIN hit ON hit.doc_id = m.doc_id
"""

_ESCAPED = " + ".join(
    [r"(length({0}) - length(replace({0}, '\', '')))"]
    + [f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}"
       for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")])

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(17 + length(role) + {_ESCAPED.format('role')} + length(text) + {_ESCAPED.format('text')}))::BIGINT
         AS formatted_chars
FROM turns GROUP BY conv_id
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  WHERE 100 * least(nx.n, ny.n) >= 85 * greatest(nx.n, ny.n)
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.other), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.doc_id = w.doc_id
GROUP BY w.doc_id, n.n
"""

HARD_NEGATIVES = """
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike,
    cast(list_inner_product(a.e, b.e) as bigint) as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int)
    as rank, vec_id as negative_id, positive_score, score as negative_score
  from positives join scored using (anchor_id)
  where not alike and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
  qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3
"""

RESAMPLING = r"""
with crc_table as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(0, 256)) as i)),
texts as (select true as ours, row_number() over () as r, doc_id, text from documents
  union all select false, 0, null, text from benchmark),
words as (select ours, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from texts),
codes as (select word, hex(word) as h from (select distinct word from words)),
placed as (select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2),
    lambda i: cast(concat('0x', h[2 * i + 1:2 * i + 2]) as bigint))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 as bucket from codes, crc_table),
found as (select ours, r, bucket from words join placed using (word)),
held as (select bucket, count(*) filter (ours) as s, count(*) filter (not ours) as t from found group by bucket),
alls as (select count(*) filter (ours) as s_all, count(*) filter (not ours) as t_all from found),
gains as (select bucket, cast(floor(1000 * ln(cast((t + 1) as double) * (s_all + 10000) /
  (cast((s + 1) as double) * (t_all + 10000)))) as bigint) as gain from held, alls),
sums as (select r, count(*) as n, cast(sum(gain) as bigint) as g from found join gains using (bucket) where ours group by r),
weighed as (select r, doc_id, coalesce(n, 0) as n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0) as weight,
    cast(concat('0x', substr(sha256(concat('2024:', coalesce(cast(doc_id as varchar), ''))), 1, 8)) as bigint) as h
  from texts left join sums using (r) where ours),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from weighed),
ordered as (select r, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as rank,
    count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, rank from scored left join (select * from ordered where rank <= n * 10 // 100) using (r)
"""

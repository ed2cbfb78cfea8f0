"""Host-level quality rules.

Every document is measured; each rule's failures are summed by host; a host's failure rate is shrunk towards the
corpus by an empirical beta prior, so a host with few documents is not judged by chance; and the verdicts are joined
back. A host is condemned under a rule when even the low end of its shrunk rate is above a limit. A document goes when
it fails the base rule, or fails a rule under which its host is condemned: a clean document stays wherever it stands.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated
rows count and return as often as they occur; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.llm.common import SPACE, fresh
from sheafwork.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: A host is condemned under a rule when its shrunk failure rate less so many standard deviations exceeds the limit.
RATE_LIMIT = 0.5
DEVIATIONS = 2.0


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one whole text, in the order of ``MEASURES``."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        times = Counter(grams)
        inside = np.zeros(len(words), dtype=bool)
        starts = np.flatnonzero(np.fromiter((times[g] > 1 for g in grams), dtype=bool, count=len(grams)))
        for step in range(3):
            inside[starts + step] = True
        repeated = int(inside.sum())
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def measures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        for at in range(0, len(batch), 200):
            rows = [measure(t) for t in batch.slice(at, 200).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(MEASURES))
        pa.default_memory_pool().release_unused()  # two workers share what an executor leaves beside its heap


def rules(m: Column) -> dict[str, Column]:
    """Rule name -> does the document with the measures ``m`` fail it."""
    words, repeat = m["n_words"], m["n_repeat_words"]
    return {
        "base": (words < 50) | (100 * repeat > 50 * words),
        "symbols": 10 * m["n_symbols"] > words,
        "lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "length": (m["word_chars"] < 2 * words) | (m["word_chars"] > 12 * words),
        "repeats": 100 * repeat > 20 * words,
    }


def host_verdicts(docs: DataFrame, text: str = "text", host: str = "source", limit: float = RATE_LIMIT,
                  deviations: float = DEVIATIONS) -> DataFrame:
    """(host, rule, n, failed, rate, low, condemned), one row per host and rule.

    The beta prior of a rule is fitted to the hosts' rates by moments: mean m and variance v weigh every host by its
    documents, and the prior counts for m(1-m)/v - 1 documents, at least 1. One row per rule is joined to the hosts.
    """
    measured = docs.select(F.col(host).alias("host"), measures(F.col(text)).alias("m"))
    failing = {name: failed.cast("int") for name, failed in rules(F.col("m")).items()}
    counts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"),
                                          *[F.sum(c).cast("bigint").alias(f"failed_{r}") for r, c in failing.items()])
    by_rule = counts.select("host", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"failed_{r}").alias("failed")) for r in failing])).alias("r"))
    by_rule = cut_lineage(by_rule.select("host", "n", "r.rule", "r.failed"))
    mean = F.sum("failed") / F.sum("n")
    # the variance between hosts as sums of integers over n: stable, and the same in any order of hosts
    square = F.sum(F.col("failed") * F.col("failed") / F.col("n")) / F.sum("n")
    prior = by_rule.groupBy("rule").agg(mean.alias("mean"), F.greatest(square - mean * mean, F.lit(1e-9)).alias("var"))
    weight = F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1, F.lit(1.0))
    shrunk = by_rule.join(prior, "rule").withColumn("weight", weight)
    rate = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    low = F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    return (shrunk.withColumn("rate", rate).withColumn("low", low)
            .select("host", "rule", "n", "failed", "rate", "low", (F.col("low") > limit).alias("condemned")))


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = RATE_LIMIT,
          deviations: float = DEVIATIONS) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: a struct of the measures, ``base_failed``, ``kept`` and
    ``failed_rules``.

    Texts stay where they are read: only the condemned hosts, a small stored table, meet them, and Spark broadcasts it
    while it is below the broadcast limit.
    """
    name, key, bad = fresh(docs, "quality"), fresh(docs, "condemned_host"), fresh(docs, "condemned_rules")
    condemned = (host_verdicts(docs, text, host, limit, deviations).filter("condemned")
                 .groupBy(F.col("host").alias(key)).agg(F.sort_array(F.collect_set("rule")).alias(bad)))
    condemned = cut_lineage(condemned)  # at most one row per host, at most one entry per rule
    measured = docs.withColumn(name, measures(F.col(text)))
    joined = measured.join(condemned, measured[host].eqNullSafe(condemned[key]), "left")
    m = F.col(name)
    failed = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules(m).items()]))
    base = rules(m)["base"]
    hit = F.coalesce(F.arrays_overlap(failed, F.col(bad)), F.lit(False))
    verdict = F.struct(*[m[c].alias(c) for c in MEASURES], base.alias("base_failed"), (~base & ~hit).alias("kept"),
                       failed.alias("failed_rules"))
    return joined.withColumn(name, verdict).select(*docs.columns, name), name


def passing(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that are kept, with their own columns."""
    judged, name = judge(docs, **options)
    return judged.filter(F.col(name)["kept"]).drop(name)

"""Exact set-similarity join of whole texts: universe-partition pigeonhole.

A document's set is its distinct word shingles, as 64-bit hashes. Sets are banded by size. Two sets that reach the
threshold and whose larger one lies in a band differ in at most H elements, so when the universe is hashed into H + 1
segments at least one segment holds the same elements in both. A set is indexed in its own band and in each band where
it can be the smaller partner, one 64-bit signature per segment.

An empty segment is equal by chance in a share of all sets, so its signature would gather a group that grows with the
corpus. Allocation by cost settles it per band: with N sets in the band a set meets about N (1 - 1/m)^size others in an
empty segment, and each costs reading a set; a one-deletion neighbourhood costs a signature per element of a segment, so
size / m. When the mates cost more, empty segments are skipped, and a set that has e of them pays for it with the
one-deletion neighbourhoods of its first segments, up to e that hold two or more elements.
Two sets without an equal filled segment then have, among their first segments, one that differs in exactly one
element, which the deletions find. A set with too few such segments keeps its empty signatures.
A segment that holds nothing but common shingles, of lines that many texts repeat, gathers such a group as well, so it counts as empty:
above, "empty" reads "without a rare element" and "two or more elements" reads "two or more rare ones", by which no deletion leaves a common
segment, and the argument holds for any set of common shingles that all tasks agree on. The first pass counts them, see ``_common``.

Signatures propose, sets decide, in two steps. First a set that shares many signatures with another goes to one task with the others
that share most with the same set (a star, not all pairs); a large star is cut into blocks, each with the PIVOTS sets that share most
signatures. A task verifies exactly the pairs that share a signature and are not yet linked and returns at most one link per
document, so a group of near copies hangs together after work in proportion to its size. Then only the signatures that two
unlinked groups still share are open. Their holders meet without their texts, as sketches: how many elements fall into each of
SKETCH parts of the universe. The sum of the differences is no more than the number of elements in which two sets differ, so
pairs beyond the threshold are dismissed exactly and hardly any of them reads a text (large sets have a second, finer sketch); the others are verified, for a set and a
group at most FIRST at a time, until no signature is open that could link. Of the signatures that the same sets hold only one takes part,
and those with one least holder meet in one task, so that near sets, which share hundreds of signatures, are proposed about once. Equal sets are folded into one before all this.

Defined results: a null or empty text has the empty set and links with nothing; fewer words than a shingle are one
shingle of their own length; rows with one doc_id are one document with all its sets; a null doc_id links with nothing
and its component is null; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import fresh
from sheafwork.llm.components import components
from sheafwork.llm.words import mix, words_of
from sheafwork.session import cut_lineage

#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT = 85
WORDS = 4
#: Sizes of a band lie within this ratio.
RATIO = 0.7
#: Shingles that one task of a verification holds.
BLOCK_SHINGLES = 250_000
#: Sets of a large component that go to all its blocks.
PIVOTS = 16
#: Rows of two or three numbers that say which texts go where are broadcast while they are no more than this; beyond it they are joined
#: by a shuffle.
BROADCAST_IDS = 2_000_000
#: Parts of the universe a sketch counts, and parts it is folded to for a first look; holders of a signature that meet in one block, pairs filtered at a time, pairs of a set and a
#: group first verified, and partners of a set in one task.
SKETCH, COARSE, HOLDERS, PAIRS_AT_ONCE, FIRST, PARTNERS = 256, 64, 2048, 60_000, 16, 500
#: Parts of the sketch of the largest sets, a power of two. In SKETCH parts alone, two sets of some thousand elements look alike by chance.
FINEST = 8192
#: Holders of a signature beyond which it is common: the holders of common signatures meet once, not once per signature.
COMMON = 48
#: A shingle is common when more than this many distinct sets hold it, and more than one in so many; no more than so many are, the most frequent
#: ones. This is a matter of cost: a common shingle that is not known as one makes sets meet for nothing.
COMMON_HOLDERS, COMMON_SHARE, COMMON_SHINGLES = 64, 2000, 250_000
#: Shingles a task counts at a time, and the sets among these that must hold one for it to be reported.
COUNTED, REPORTED = 1_000_000, 3
#: A set joins a star at first when it shares one signature in so many segments with another one of it; near copies share more than that.
NEAR = 8
#: Parts of a batch between two releases of freed memory.
RELEASED = 10
#: Sets a task remembers to have indexed; beyond it starts anew.
REMEMBERED = 100_000
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _times(factor: int, constant: np.uint64) -> np.uint64:
    return np.uint64(factor * int(constant) % (1 << 64))


def shingles_of(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; A-Z are lower-cased."""
    out = []
    found = words_of(texts, lower=True)
    for hashes in found.per_text(found.hashes):
        if not len(hashes):
            out.append(hashes)
            continue
        w = min(width, len(hashes))
        folded = hashes[:len(hashes) - w + 1].copy()
        for i in range(1, w):
            folded = folded * _M3 + hashes[i:len(hashes) - w + 1 + i]
        folded = np.sort(mix(folded + np.uint64(w)))
        out.append(folded[np.concatenate(([True], folded[1:] != folded[:-1]))])
    return out


class Scheme:
    """Bands, their segment counts, and the signatures of a set."""

    def __init__(self, percent: int = PERCENT, sets_in_band: dict[int, int] | None = None, common: np.ndarray | None = None):
        self.percent = percent
        self.sets_in_band = sets_in_band or {}
        #: sorted hashes of common shingles
        self.common = np.empty(0, dtype=np.uint64) if common is None else common
        self.bands: list[tuple[int, int]] = []

    def _band(self, k: int) -> tuple[int, int]:
        while len(self.bands) <= k:
            low = self.bands[-1][1] + 1 if self.bands else 1
            self.bands.append((low, max(low, int(low / RATIO))))
        return self.bands[k]

    def band_of(self, size: int) -> int:
        """The band a size lies in."""
        low, high = 0, 1
        while self._band(high)[1] < size:
            high *= 2
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.bands[middle][1] >= size else (middle + 1, high)
        return low

    def roles(self, size: int) -> list[int]:
        """The bands in which a set of this size is indexed: its own, and those where it can be the smaller partner."""
        k = self.band_of(size)
        out = [k]
        while 100 * size >= self.percent * self._band(k + 1)[0]:
            k += 1
            out.append(k)
        return out

    def differences(self, band: int) -> int:
        """The most elements in which two linked sets of the band differ."""
        return 2 * self._band(band)[1] * (100 - self.percent) // (100 + self.percent)

    def skips_empty(self, band: int, segments: int) -> bool:
        mates = self.sets_in_band.get(band, 0) * (1 - 1 / segments) ** self._band(band)[1]
        return mates > 1 / segments

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """The signatures of a set in all its bands; none where only equal sets can link."""
        out = []
        rare = np.ones(len(elements), dtype=bool)
        if len(self.common):
            rare = self.common[np.minimum(np.searchsorted(self.common, elements), len(self.common) - 1)] != elements
        for band in self.roles(len(elements)) if len(elements) else []:
            segments = self.differences(band) + 1
            if segments > 1:
                out.append(self._in_band(elements, rare, band, segments))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    def _in_band(self, elements: np.ndarray, rare: np.ndarray, band: int, segments: int) -> np.ndarray:
        salted = mix(elements + _times(band + 1, _M3))
        segment = (salted % np.uint64(segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        sizes = np.bincount(segment, minlength=segments)
        values = mix(salted[order] + _M2)
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
        ends = np.cumsum(sizes)
        sums = running[ends] - running[ends - sizes]
        salt = mix(np.arange(segments, dtype=np.uint64) + _times(band, _M1))
        rares = np.bincount(segment[rare], minlength=segments)
        filled = rares > 0
        empties = segments - int(filled.sum())
        if not empties or not self.skips_empty(band, segments):
            return mix(sums + salt)
        large = np.cumsum(rares >= 2)
        if large[-1] < empties:  # too few segments to pay with: the empty ones stay
            first, exact = segments, np.ones(segments, dtype=bool)
        else:
            first, exact = int(np.searchsorted(large, empties)) + 1, filled
        deleted = [mix(sums[i] - values[ends[i] - sizes[i]:ends[i]] + salt[i]) for i in range(first) if rares[i] >= 2]
        return np.concatenate([mix(sums[exact] + salt[exact]), *deleted])


def _digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a, b = mix(elements + _M1), mix(elements + _M2)
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def _sketches(elements: np.ndarray) -> tuple[bytes, bytes | None]:
    """How many elements lie in each of SKETCH parts of the universe, 255 at most; and, of a large set, in each of about half as many as it has."""
    hashed = mix(elements + _M3)

    def counts(parts: int) -> bytes:
        return np.minimum(np.bincount((hashed % np.uint64(parts)).astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()

    large = len(elements) > 4 * SKETCH
    return counts(SKETCH), counts(min(FINEST, 1 << (len(elements) // 2).bit_length())) if large else None


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches. Arrow's pool keeps what is freed, some 100 MB in an idle worker, so it is told to give it back."""
    pool = pa.default_memory_pool()
    for batch in batches:
        for turn, at in enumerate(range(0, batch.num_rows, rows)):
            yield batch.slice(at, rows)
            if turn % RELEASED == RELEASED - 1:
                pool.release_unused()
    pool.release_unused()


def _sets_and_counts(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """The rows of ``shingle_sets``, and rows without ``n_shingles``: d2 distinct sets among those that a task counted at a time hold shingle d1."""
    names = ["doc_id", "n_shingles", "d1", "d2", "sketch", "fine"]

    def counts(held: np.ndarray) -> pa.RecordBatch:
        held.sort()  # in place: a worker keeps the memory it once took
        others = REPORTED - 1
        shingles, n = np.unique(held[others:][held[others:] == held[:-others]], return_counts=True)
        rows = len(shingles)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.array(shingles.view(np.int64)), pa.array(n + others, pa.int64()),
             pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())], names=names)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counted, met = np.empty(COUNTED, dtype=np.uint64), 0, set()
        for batch in _slices(batches):
            sets = shingles_of(batch.column(1), words)
            digests = [_digest(s) for s in sets]
            sketches = [_sketches(s) for s in sets]
            for elements, digest in zip(sets, digests):
                if digest in met:
                    continue
                if counted + len(elements) > COUNTED:
                    yield counts(held[:counted])
                    counted, met = 0, set()
                met.add(digest)
                part = held[counted:counted + len(elements)]
                part[:] = elements[:len(part)]
                counted += len(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, sets)), pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 *[pa.array([s[i] for s in sketches], pa.binary()) for i in (0, 1)]], names=names)
        yield counts(held[:counted])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(body, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch binary, fine binary")


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch): size, digest and sketch of every row's set."""
    return _sets_and_counts(docs, doc_id, text, words).filter("n_shingles is not null").drop("fine")


def _common(counts: DataFrame, sets: int) -> np.ndarray:
    """Sorted hashes of the common shingles, from (d1, d2) of ``_sets_and_counts`` and the number of distinct sets.

    Their number does not grow with the corpus: a share of all sets can hold no more shingles than the mean size over that share.
    """
    holders = counts.groupBy("d1").agg(F.sum("d2").alias("n")).filter(F.col("n") > max(COMMON_HOLDERS, sets // COMMON_SHARE))
    found = holders.orderBy(F.desc("n"), "d1").limit(COMMON_SHINGLES).select("d1").toArrow()
    return np.sort(found["d1"].to_numpy().view(np.uint64))


def _signatures(docs: DataFrame, doc_id: str, text: str, words: int, scheme: Scheme) -> DataFrame:
    """(sig, node) per signature. A task indexes equal sets once, under the first row it met them in."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = set()
        for batch in _slices(batches):
            found, nodes = [], []
            for node, elements in zip(batch.column(0).to_pylist(), shingles_of(batch.column(1), words)):
                if not len(elements) or (digest := _digest(elements)) in indexed:
                    continue
                if len(indexed) > REMEMBERED:
                    indexed.clear()
                indexed.add(digest)
                found.append(scheme.signatures(elements))
                nodes.append(node)
            yield _rows(found, nodes)

    def _rows(found: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        sigs = np.concatenate([np.empty(0, dtype=np.uint64), *found]).view(np.int64)
        owners = np.repeat(np.array(nodes, dtype=np.int64), [len(f) for f in found])
        return pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(owners)], names=["sig", "node"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.filter("doc_id is not null and text is not null").mapInArrow(body, "sig bigint, node bigint")


def verified_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], scheme: Scheme,
                   labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (id, id) that connect what linked pairs connect: pairs share a signature and are checked exactly.

    With two sides only pairs across them count. Pairs that are connected already, or have one label, are not looked at.
    """
    root = list(range(len(sets)))
    if labels is not None and len(sets):
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        root = first[back].tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets])
    signatures = [scheme.signatures(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in signatures])
    flat = np.concatenate([np.empty(0, dtype=np.uint64), *signatures])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.append(new, len(flat)))
    shared = np.repeat(lengths > 1, lengths)
    # per set: the groups (signatures held by more than one set) it belongs to
    group = np.repeat(np.arange(len(new)), lengths)[shared]
    member = owner[shared]
    by_set = np.argsort(member, kind="stable")
    groups_of = np.split(group[by_set], np.cumsum(np.bincount(member, minlength=len(sets)))[:-1])
    two = len(np.unique(sides)) > 1
    links = []
    for x in range(len(sets)):
        if not len(groups_of[x]):
            continue
        near = np.unique(np.concatenate([owner[new[g]:new[g] + lengths[g]] for g in groups_of[x]]))
        near = near[near < x]
        a, b = np.minimum(sizes[near], sizes[x]), np.maximum(sizes[near], sizes[x])
        near = near[100 * a >= scheme.percent * b]
        if two:
            near = near[sides[near] != sides[x]]
        while len(near):
            mine = find(x)
            near = near[np.fromiter((find(y) != mine for y in near.tolist()), dtype=bool, count=len(near))]
            part, near = near[:64], near[64:]
            if not len(part):
                break
            joined = np.concatenate([sets[y] for y in part])
            at = np.minimum(np.searchsorted(sets[x], joined), sizes[x] - 1)
            both = np.add.reduceat((sets[x][at] == joined).astype(np.int64),
                                   np.concatenate(([0], np.cumsum(sizes[part])[:-1])))
            linked = (100 + scheme.percent) * both >= scheme.percent * (sizes[part] + sizes[x])
            for y in part[linked].tolist():
                if find(y) != find(x):
                    root[max(find(x), find(y))] = min(find(x), find(y))
                    links.append((int(ids[x]), int(ids[y])))
    return links


def _verify(docs: DataFrame, meetings: DataFrame, doc_id: str, text: str, words: int, scheme: Scheme) -> DataFrame:
    """(u, v): links found where blocks meet. ``meetings`` has (node, task, side, label)."""
    def body(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        sets = [s for batch in _slices(group.select(["text"]).to_batches(), 32) for s in shingles_of(batch.column(0), words)]
        links = verified_links(group["doc_id"].to_numpy(), group["side"].to_numpy(), sets, scheme, group["label"].to_numpy())
        return pa.table([pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if meetings.count() <= BROADCAST_IDS:  # then a text is shuffled once, to its tasks
        meetings = F.broadcast(meetings)
    met = rows.join(meetings, rows["doc_id"] == meetings["node"]).select("doc_id", "text", "task", "side", "label")
    return met.groupBy("task").applyInArrow(body, "u bigint, v bigint")


def _weighed(proposed: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Proposed nodes with their weight, ``total``, that of their component, and ``bundle``, the task of a small one."""
    weighed = cut_lineage(proposed.join(sizes, "node"))
    per = weighed.groupBy("component").agg(F.sum("weight").alias("total"))
    light = per.filter(F.col("total") <= block).agg(F.sum("total").alias("t")).first()["t"] or 0
    bundles = max(1, -(-int(light) // block))
    cuts = F.ceil(F.col("total") / block)
    return cut_lineage(weighed.join(per, "component").withColumns({
        "bundle": F.when(F.col("total") <= block, F.pmod(F.xxhash64("component"), F.lit(bundles))),
        "cuts": cuts, "own": F.pmod(F.xxhash64("node"), cuts)}))


def _task(*parts: object) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def _first_meetings(placed: DataFrame, degrees: DataFrame) -> DataFrame:
    """(node, task, side, label): every node in one task, and the pivots of a large component in all of its tasks."""
    alone = [F.lit(0).alias("side"), F.col("node").alias("label")]
    light = placed.filter("bundle is not null").select("node", _task(0, "bundle").alias("task"), *alone)
    heavy = placed.filter("bundle is null")
    known = heavy.join(degrees, "node").groupBy("component", "cuts", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("p"))
    pivots = known.agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("node"))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1))
    everywhere = pivots.select("node", "component", blocks.alias("own"))
    once = heavy.select("node", "component", "own").union(everywhere).distinct()
    return light.union(once.select("node", _task(1, "component", "own").alias("task"), *alone))


def possible_pairs(sig: np.ndarray, row: np.ndarray, node: np.ndarray, label: np.ndarray, side: np.ndarray, size: np.ndarray,
                   sketch: np.ndarray, percent: int) -> np.ndarray:
    """Codes i * n + j of the n rows i < j that share a signature, have different labels and may link, each once.

    ``sig`` and ``row`` say which row holds which signature and are sorted by ``sig`` and size, so a holder is done at the first one that is
    too large for it. Rows of one side do not pair when their signature has two. A size of -1 dismisses nothing.
    """
    n, m = len(node), len(sig)
    if not m:
        return np.empty(0, dtype=np.int64)
    begins = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    lengths = np.diff(np.append(begins, m))
    ends = np.repeat(begins + lengths, lengths)
    mixed = np.repeat(np.maximum.reduceat(side[row], begins) > np.minimum.reduceat(side[row], begins), lengths)
    held = size[row]
    coarse = sketch.reshape(n, COARSE, -1).sum(axis=2, dtype=np.int16)
    open_, found, shift = np.arange(m), [], 0
    while len(open_):
        shift += 1
        open_ = open_[open_ + shift < ends[open_]]
        open_ = open_[(held[open_] < 0) | (100 * held[open_] >= percent * held[open_ + shift])]
        for first in range(0, len(open_), PAIRS_AT_ONCE):
            at = open_[first:first + PAIRS_AT_ONCE]
            i, j = row[at], row[at + shift]
            keep = (label[i] != label[j]) & (node[i] != node[j]) & ~(mixed[at] & (side[i] == side[j]))
            i, j = i[keep], j[keep]
            i, j = np.divmod(np.unique(np.minimum(i, j) * n + np.maximum(i, j)), n)
            for counts in (coarse, sketch):
                apart = np.abs(counts[i].astype(np.int16) - counts[j]).sum(axis=1)
                near = (np.minimum(size[i], size[j]) < 0) | ((100 + percent) * apart <= (100 - percent) * (size[i] + size[j]))
                i, j = i[near], j[near]
            found.append(i * n + j)
    return np.unique(np.concatenate(found or [np.empty(0, dtype=np.int64)]))


def _candidates(holders: DataFrame, info: DataFrame, percent: int, first: int) -> DataFrame:
    """(x, y, more): unlinked pairs that share an open signature and may link, up to ``first`` of an x and a group and batch.

    ``holders`` has (sig, lead, node, label, n), n holders of a signature; more than HOLDERS of them meet block by block. Two near sets share
    hundreds of signatures, which mostly have one least holder, their lead: the signatures of a lead go to one task, where a set comes once,
    with its sketch and all of them, and a pair is made once.
    """
    cuts = F.ceil(F.col("n") / F.lit(float(HOLDERS)))
    rows = holders.withColumns({"cuts": cuts, "own": F.pmod(F.xxhash64("node"), cuts)})
    small = rows.filter("cuts = 1").withColumn("side", F.lit(0))
    large = rows.filter("cuts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
    large = large.withColumns({"sig": F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")),
                               "side": F.col("own").cast("int")}).withColumn("lead", F.col("sig"))
    key = ["lead", "node", "label", "side"]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            n = len(table)
            node, label, side, size = (table[c].to_numpy() for c in ("node", "label", "side", "size"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(n, SKETCH)
            sig = pc.list_flatten(table["sigs"]).to_numpy()
            row = np.repeat(np.arange(n), pc.list_value_length(table["sigs"]).to_numpy())
            order = np.lexsort((size[row], sig))
            i, j = np.divmod(possible_pairs(sig[order], row[order], node, label, side, size, sketch, percent), max(1, n))
            x, y = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
            group = np.where(node[i] > node[j], label[j], label[i])
            order = np.lexsort((y, group, x))
            x, y, group = x[order], y[order], group[order]
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[:len(x)]
            x, y, group = x[new], y[new], group[new]
            begins = np.concatenate(([True], (x[1:] != x[:-1]) | (group[1:] != group[:-1])))[:len(x)]
            start = np.flatnonzero(begins)
            turn = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
            last = np.append(begins[1:], True)[:len(x)]
            more = (turn == first - 1) & ~last
            kept = turn < first
            return pa.RecordBatch.from_arrays([pa.array(x[kept]), pa.array(y[kept]), pa.array(more[kept])], names=["x", "y", "more"])

        for batch in batches:  # sorted by lead: a lead's rows may go on in the next batch
            table = pa.Table.from_batches([*held, batch])
            lead = table["lead"].to_numpy()
            cut = int(np.searchsorted(lead, lead[-1], "left")) if len(lead) else 0
            if cut:
                yield pairs(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    once = small.select("sig", *key).union(large.select("sig", *key)).repartition("node").groupBy(*key).agg(
        F.collect_list("sig").alias("sigs")).join(info.select("node", "size", "sketch"), "node")
    return once.repartition("lead").sortWithinPartitions("lead").mapInArrow(body, "x bigint, y bigint, more boolean")


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ, by their fine sketches; the longer one is folded."""
    long, short = sorted((np.frombuffer(c, dtype=np.uint8).astype(np.int32) for c in (a, b)), key=len, reverse=True)
    return int(np.abs(long.reshape(-1, len(short)).sum(axis=0) - short).sum())


def _not_apart(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that their fine sketches do not dismiss; sets without one, or without one size, dismiss nothing."""
    fine = info.filter("fine is not null and size >= 0")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [i for i, (a, b, n) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()))
                  if a is None or b is None or (100 + percent) * _apart(a, b) <= (100 - percent) * n]
            yield batch.select([0, 1]).take(pa.array(at, pa.int64()))

    def of(end: str) -> DataFrame:
        return fine.select(F.col("node").alias(end), F.col("fine").alias(f"{end}_fine"), F.col("size").alias(f"{end}_size"))

    both = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return both.select("x", "y", "x_fine", "y_fine", (F.col("x_size") + F.col("y_size")).alias("n")).mapInArrow(body, "x bigint, y bigint")


def _shared(index: DataFrame) -> DataFrame:
    """(sig, lead, node, w): holders of shared signatures but the least of them, their ``lead``. The w signatures that the same nodes hold are one.

    ``index`` has (sig, node). A signature is named anew by a hash of its holders; holders that one name happens to join only meet more.
    """
    same = Window.partitionBy("sig")
    held = index.withColumns({"lead": F.min("node").over(same), "n": F.count(F.lit(1)).over(same),
                              "all": F.bit_xor(F.xxhash64("node")).over(same)}).filter("node <> lead")
    return held.groupBy(F.xxhash64("lead", "n", "all").alias("sig"), "lead", "node").agg(F.count(F.lit(1)).alias("w"))


def _centers(shared: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """(node, component): the star that a proposed set goes to, named by its center.

    ``shared`` has (u, v, w). A set goes to the earlier one it shares most signatures with, or to that one's center, unless more tie it to a
    later one: the least fellow of a set is, the more sets there are, one that shares a signature by chance.
    """
    pull = shared.groupBy(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("lead")).agg(F.sum("w").alias("w"))
    segments = F.col("weight") * (2 * (100 - percent)) / (100 + percent) + 1
    pull = cut_lineage(pull.join(weights, "node").filter(F.col("w") * NEAR >= segments).select("node", "lead", "w"))
    up = pull.groupBy("node").agg(F.max_by("lead", F.struct("w", -F.col("lead"))).alias("lead"), F.max("w").alias("w"))
    down = pull.groupBy(F.col("lead").alias("node")).agg(F.max("w").alias("held"))
    centers = cut_lineage(up.join(down, "node", "full").select("node", F.when(
        F.col("w") >= F.coalesce("held", F.lit(0)), F.col("lead")).otherwise(F.col("node")).alias("component")))
    for _ in range(2):
        above = centers.select(F.col("node").alias("component"), F.col("component").alias("next"))
        centers = centers.join(above, "component").select("node", F.col("next").alias("component"))
    return centers


def _gathered(rows: DataFrame) -> DataFrame:
    """(sig, lead, node, label, n): common signatures that have holders in common become one group, so two sets meet in it once."""
    common = rows.filter(F.col("n") > COMMON)
    if common.isEmpty():
        return rows
    # all common signatures of a node are of one group, so its least one leads to it
    common = cut_lineage(common.drop("lead").withColumn("low", F.min("sig").over(Window.partitionBy("node"))))
    edges = common.select(F.col("sig").alias("u"), F.col("low").alias("v")).distinct()
    groups = components(edges).select(F.col("node").alias("low"), F.col("component").alias("group"))
    once = common.select("low", "node", "label").distinct().join(groups, "low", "left").select(
        F.coalesce("group", "low").alias("sig"), "node", "label").withColumn("lead", F.col("sig"))
    sizes = once.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") <= COMMON).unionByName(once.join(sizes, "sig"))


def _pair_meetings(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, task, side, label): every y meets its x's, PARTNERS of them in a task."""
    parts = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PARTNERS))).alias("parts"))
    dealt = pairs.join(parts, "y").select("x", "y", _task(4, "y", F.pmod(F.xxhash64("x"), F.col("parts"))).alias("task"))
    nodes = dealt.select(F.col("x").alias("node"), "task").union(dealt.select("y", "task")).distinct()
    return nodes.join(labels, "node", "left").select("node", "task", F.lit(0).alias("side"), F.coalesce("label", "node").alias("label"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links: groups are joined, not their members."""
    def label_of(end: str) -> DataFrame:
        return labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))

    ends = links.join(label_of("u"), "u", "left").join(label_of("v"), "v", "left").select(
        F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    roots = components(ends).select(F.col("node").alias("label"), F.col("component").alias("root"))
    known = labels.union(links.select("u", "u")).union(links.select("v", "v")).groupBy("node").agg(F.min("label").alias("label"))
    return cut_lineage(known.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                       words: int = WORDS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their shingle sets; a component is named by its
    smallest doc_id.
    """
    read = cut_lineage(_sets_and_counts(docs, doc_id, text, words))  # four numbers a row
    sets = read.filter("n_shingles is not null")
    filled = sets.filter("n_shingles > 0 and doc_id is not null")
    # one representative per distinct set
    first = filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    of = cut_lineage(filled.join(first, ["n_shingles", "d1", "d2"]).select("doc_id", "rep").distinct())
    scheme = Scheme(percent)
    distinct = 0
    counts = first.groupBy("n_shingles").count().toLocalIterator()  # a row per size; summed into some tens of bands
    in_band: dict[int, int] = {}
    for row in counts:
        distinct += row["count"]
        for band in scheme.roles(row["n_shingles"]):
            in_band[band] = in_band.get(band, 0) + row["count"]
    scheme = Scheme(percent, in_band, _common(read.filter("n_shingles is null"), distinct))

    # equal sets are indexed once, by their representative; ids that represent nothing need not be read
    copies = of.groupBy(F.col("doc_id").alias("copy")).agg(F.max(F.col("doc_id") == F.col("rep")).alias("first")).filter("not first")
    indexed = docs
    if copies.count() <= BROADCAST_IDS:
        indexed = docs.join(F.broadcast(copies.select("copy")), F.col(doc_id).cast("bigint") == F.col("copy"), "left_anti")
    index = _signatures(indexed, doc_id, text, words, scheme)
    # equal sets indexed by several tasks, or under one doc_id, meet at their representative
    a, b = of.select(F.col("doc_id").alias("node"), F.col("rep").alias("u")), of.select(
        F.col("doc_id").alias("lead"), F.col("rep").alias("v"))
    shared = cut_lineage(_shared(index).join(a, "node").join(b, "lead").select("sig", "lead", "u", "v", "w").filter("u <> v").distinct())
    holders = cut_lineage(shared.select("sig", "lead", F.col("u").alias("node")).union(shared.select("sig", "lead", "v")).distinct())
    degrees = holders.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    weights = filled.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("weight"))

    meetings = cut_lineage(_first_meetings(_weighed(_centers(shared, weights, percent), weights, block), degrees))
    links = _verify(docs, meetings, doc_id, text, words, scheme)
    # a document with several sets links their representatives
    several = of.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("high")).filter("v <> high").select("doc_id", "v")
    links = links.union(of.join(several, "doc_id").select(F.col("rep").alias("u"), "v"))
    labels = cut_lineage(components(links).select("node", F.col("component").alias("label")))

    # a representative of several sets has no one sketch, and no size then
    info = first.join(filled.select(F.col("doc_id").alias("rep"), "n_shingles", "d1", "d2", "sketch", "fine"), ["rep", "n_shingles", "d1", "d2"])
    info = info.groupBy(F.col("rep").alias("node")).agg(F.min("d1").alias("low"), F.max("d1").alias("high"), F.min("n_shingles").alias("n1"),
                                                        F.max("n_shingles").alias("n2"), F.min("sketch").alias("sketch"), F.min("fine").alias("fine"))
    info = info.select("node", F.when((F.col("low") == F.col("high")) & (F.col("n1") == F.col("n2")), F.col("n1")).otherwise(-1)
                       .alias("size"), "sketch", "fine")
    info = cut_lineage(holders.select("node").distinct().join(info, "node"))
    at_once = FIRST
    while True:
        named = cut_lineage(holders.join(labels, "node", "left").select("sig", "lead", "node", F.coalesce("label", "node").alias("label")))
        still = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
        still = still.filter("low <> high").select("sig", "n")
        found = cut_lineage(_candidates(_gathered(named.join(still, "sig")), info, percent, at_once))
        if found.isEmpty():
            break
        pairs = cut_lineage(_not_apart(found.select("x", "y").distinct(), info, percent))
        meetings = cut_lineage(_pair_meetings(pairs, labels))
        labels = _relabelled(labels, cut_lineage(_verify(docs, meetings, doc_id, text, words, scheme)))
        again = found.filter("more").select(F.col("x").alias("node")).distinct()
        if again.isEmpty():
            break
        # pairs left over are of these sets: only their signatures are looked at again
        holders = cut_lineage(holders.join(holders.join(again, "node").select("sig").distinct(), "sig", "left_semi"))
        at_once *= 16
    own = of.groupBy("doc_id").agg(F.min("rep").alias("node")).join(labels, "node", "left")
    named = own.select("doc_id", F.coalesce("label", "node").alias("component"))
    return sets.join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id"))
        .otherwise(F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", **options: object) -> DataFrame:
    """The documents whose doc_id names their component, and those without shingles, with their own columns.

    Repeated rows of one document return as often as they occur.
    """
    named = similar_components(docs, doc_id=doc_id, **options)
    key = fresh(docs, "dropped_id")
    dropped = named.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    dropped = cut_lineage(dropped)
    return docs.join(dropped, docs[doc_id].cast("bigint") == dropped[key], "left_anti")

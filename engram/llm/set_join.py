"""Exact Jaccard join of word n-gram sets by set-relation skipping (operator 12).

A document's set holds the distinct runs of ``size`` words (A-Z lower-cased); equal sets are one class.  Two sets
link when 100 * |intersection| >= percent * |union|.

Index: the elements of every set are ordered rare first: those of a fixed share of all elements (``SAMPLED``, by hash) that are certainly in
no other set, then the others by hash, the ``FREQUENT`` most frequent ones of the corpus last by their count.  The order changes the
work, no result.  A set with more unique elements than a linked one may lack is linked with nothing and ends here, which are
most sets of a corpus.  Linked sets share an element of one's probing prefix and of the smaller one's shorter index
prefix, so only prefixes are listed, without their unique elements; elements in one list only are dropped by a filter
before anything else is shuffled.

Skipping whole lists: the smallest indexed set of every list is its head, and each set is compared with the heads of its lists,
by a signature that bounds the overlap and then in full.  A list whose other sets are then one component holds nothing new and is skipped; the others go on without their
heads, ``ROUNDS`` times.  A group of very many near copies costs a few comparisons a copy this way, however large it is, and
lists of few sets are done.

Lists that still have several components form clusters.  A cluster is cut into blocks of ``BLOCK_DOCS`` sets and ``BLOCK_SHINGLES`` elements;
sizes fall in classes so wide that only equal and neighbouring classes can link, and only such blocks meet.  In a pair of blocks:

* block-skip by position: index lists are sorted by (size, position).  For a probe's position, each size has a range of positions
  at which the sets can still reach the needed overlap; the rest of that size's block is skipped by two binary searches.
* derived answers: a set that is very similar to one whose overlaps with the whole block are known gets its own by taking off the lists of
  the elements it lacks and adding those of the elements it has more; only sets without such a relative count all their elements' lists.
* sets that a confirmed link has already joined are not compared.

Overlaps are counted on full sets, so every link is exact (elements are 64-bit hashes).

Defined results: null or empty texts have an empty set and no links, their component is themselves; texts with fewer words than
``size`` have the whole sequence as the only element; very long texts are whole sets (one that exceeds a block is alone in its block); rows
with an equal set, also rows that repeat an id, are one class; an id that several texts carry gets each row its own
component; a null id is never a component's id unless there is no other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import shingle_sets
from .near_dedup import _Forest as Forest
from .near_dedup import _row_name as row_name
from .near_dedup import _set_hashes as set_hashes
from .sparktools import Scratch, bare, connected_components, cut, drop_members, possibly_in, release
from .substring_dedup import _collect_filter as collect_filter
from .substring_dedup import _Filter as Filter
from .words import chunks, mix, slices

SIZE = 3
#: Elements at the end of the order, and how often one must stand in a task's texts to be counted for it.
FREQUENT, OFTEN = 1 << 18, 4
#: One in so many elements is looked at to find those that no other set has.
SAMPLED = 4
#: Elements that a task holds before it counts them.
HELD = 1 << 21
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Bits of an element's hash by which a signature counts, and the largest count that it can hold.
SIGNATURE, FULL = 7, 65535
#: Times that lists lose their head, and pairs of a head that one copy of it serves.
ROUNDS, PART = 3, 256
#: A set whose similarity with a computed one reaches this share takes its answers from there.
RELATIVE = 0.8


def needed(a, b, percent: int):
    """Overlap that sets of these sizes need to link: the least o with (100 + percent) * o >= percent * (a + b)."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Elements to list for probing, and for the index (met by sets that are no smaller)."""
    return n - -(-n * percent // 100) + 1, n - int(needed(n, n, percent)) + 1


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                h1, h2 = set_hashes(sets)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2)], names=["row", "doc_id", "n", "h1", "h2"])

    return run


def _looked_at(s: np.ndarray) -> np.ndarray:
    return mix(s) % np.uint64(SAMPLED) == 0


def _counted(size: int, often: int):
    """Counts of a task's sampled elements, and of those that several of its texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            some = (n >= often) | _looked_at(values)
            yield from chunks(pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some], pa.int64())], names=["m", "n"]))

        for batch in batches:
            for part in slices(batch, "text"):
                held += shingle_sets(part.column("text"), size)
                if sum(map(len, held)) > HELD:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    return run


def _prefixes(size: int, percent: int, shared, repeated):
    """(id, n, skip, keys, signature): the probing prefix of every set that may have links, behind its ``skip`` unique elements, and the set's elements counted by their hash's first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = shared.value
        known = Filter(*repeated.value)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                every = np.concatenate([*sets, np.zeros(0, np.uint64)])
                looked = np.flatnonzero(_looked_at(every))
                unique = np.zeros(len(every), dtype=bool)
                unique[looked[~known.has(every[looked])]] = True
                first = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
                rows = []
                for i, s in enumerate(sets):
                    own = unique[first[i] : first[i + 1]]
                    skip, length = int(own.sum()), prefix_lengths(len(s), percent)[0]
                    if skip >= length or not len(s):
                        continue
                    s = s[~own]
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        s = s[np.lexsort((s, np.where(frequent[at] == s, count[at], 0)))]
                    rows.append((i, skip, s[: length - skip].tobytes(), np.bincount((sets[i] >> np.uint64(64 - SIGNATURE)).astype(np.int64), minlength=1 << SIGNATURE).clip(max=FULL).astype(np.uint16).tobytes()))
                at = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(at, pa.int64())), pa.array([len(sets[i]) for i in at], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], pa.binary()) for c in (2, 3)]],
                    names=["id", "n", "skip", "keys", "signature"],
                )

    return run


def _entries(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
            sizes = np.array([len(k) for k in keys], dtype=np.int64)
            n = np.asarray(batch.column("n"))
            index = np.array([prefix_lengths(int(x), percent)[1] for x in n], dtype=np.int64)
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.asarray(batch.column("skip")), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.repeat(np.asarray(batch.column("id")), sizes)), pa.array(np.repeat(n, sizes)), pa.array(pos < np.repeat(index, sizes))],
                names=["key", "id", "n", "listed"],
            )

    return run


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "shingles"])

    return run


def _can_link(percent: int):
    """Pairs whose sets can overlap enough: equal elements have equal first bits, so the smaller counts bound the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, 1 << SIGNATURE).astype(np.int64) for c in ("signature", "head_signature"))
            least = np.where((a == FULL) & (b == FULL), 1 << 40, np.minimum(a, b))  # a full count may stand for any larger one
            good = pa.array(least.sum(axis=1) >= needed(a.sum(axis=1), b.sum(axis=1), percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("id", "head")], names=["id", "head"])

    return run


def _with_heads(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shingles"):
                a, b = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in ("shingles", "head_shingles"))
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
                linked = pa.array([100 * o >= percent * (len(x) + len(y) - o) for x, y, o in zip(a, b, both, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("head").filter(linked), part.column("id").filter(linked)], names=["src", "dst"])

    return run


class SkipJoin:
    """The links inside a block of sets, or between the two sides of a pair of blocks, that no earlier link implies."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], side: np.ndarray, percent: int):
        self.percent, self.side = percent, side
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(self.n)))
        values, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.lexsort((values, count))] = np.arange(len(values))
        owner = np.repeat(np.arange(len(sets)), self.n)
        token = rank[token]
        order = np.lexsort((token, owner))
        token = token[order]  # every set's elements, rare first
        self.tokens = [token[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        # all sets of an element
        order = np.argsort(token, kind="stable")
        self.holders, self.holder_first = owner[order], np.searchsorted(token[order], np.arange(len(values) + 1))
        # index lists: (size, position) ascending
        pos = np.arange(len(token)) - first[owner]
        listed = np.flatnonzero(pos < np.array([prefix_lengths(int(x), percent)[1] for x in self.n])[owner])
        self.width = int(self.n.max()) + 1
        place = self.n[owner[listed]] * self.width + pos[listed]
        order = np.lexsort((place, token[listed]))
        self.listed, self.place = owner[listed][order], place[order]
        self.list_first = np.searchsorted(token[listed][order], np.arange(len(values) + 1))
        # sets joined before are one tree from the start
        self.forest = Forest(len(sets))
        known: dict[int, int] = {}
        for i, label in enumerate(labels):
            self.forest.up[i] = known.setdefault(label, i)

    def candidates(self, x: int) -> np.ndarray:
        """Sets no larger than x (of equal size: before it) that a list leaves after its skipped blocks."""
        n, found = int(self.n[x]), []
        least = -(-n * self.percent // 100)
        for i, t in enumerate(self.tokens[x][: prefix_lengths(n, self.percent)[0]].tolist()):
            low, high = self.list_first[t], self.list_first[t + 1]
            if high - low < 2 and (high == low or self.listed[low] == x):
                continue
            place = self.place[low:high]
            at = int(np.searchsorted(place, least * self.width))
            while at < len(place):
                size = int(place[at]) // self.width
                if size > n:
                    break
                need = int(needed(n, size, self.percent))
                # position j reaches min(i, j) + min(n - i, size - j)
                begin = max(0, need - n + i) if n - i < need else 0
                end = min(size - need + i, size - 1) if i < need else size - 1
                a, b = np.searchsorted(place, [size * self.width + begin, size * self.width + end + 1])
                if b > a:
                    found.append(self.listed[low + a : low + b])
                at = int(np.searchsorted(place, (size + 1) * self.width))
        if not found:
            return np.zeros(0, np.int64)
        out = np.unique(np.concatenate(found))
        out = out[(self.n[out] < n) | (out < x)]
        if self.side.any():
            out = out[self.side[out] != self.side[x]]
        return out

    def lists(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the elements each set holds."""
        if not len(tokens):
            return np.zeros(len(self.n), dtype=np.int64)
        return np.bincount(np.concatenate([self.holders[self.holder_first[t] : self.holder_first[t + 1]] for t in tokens.tolist()]), minlength=len(self.n))

    def links(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        relative = np.full(len(self.n), -1)
        answers: dict[int, np.ndarray] = {}
        for x in np.lexsort((np.arange(len(self.n)), self.n)).tolist():
            some = [y for y in self.candidates(x).tolist() if self.forest.top(y) != self.forest.top(x)]
            if not some:
                continue
            p = int(relative[x])
            if p >= 0:
                less = np.setdiff1d(self.tokens[p], self.tokens[x], assume_unique=True)
                more = np.setdiff1d(self.tokens[x], self.tokens[p], assume_unique=True)
                overlap = answers[p] - self.lists(less) + self.lists(more)
            else:
                overlap = self.lists(self.tokens[x])
            near = (overlap >= RELATIVE / (1 + RELATIVE) * (self.n + self.n[x])) & (relative < 0)
            near[x] = False
            if near.any():
                relative[near] = x
                answers[x] = overlap
            for y in some:
                o = int(overlap[y])
                a, b = self.forest.top(x), self.forest.top(y)
                if a != b and 100 * o >= self.percent * (int(self.n[x] + self.n[y]) - o):
                    self.forest.up[max(a, b)] = min(a, b)
                    out.append((x, y))
        return out


def _against_heads(pairs: DataFrame, signatures: DataFrame, member: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The links among pairs (id, head): signatures first, then full sets of what is left.  A head of many pairs is copied to parts of them, no other is copied."""
    signed = pairs.join(signatures, "id").join(signatures.select(F.col("id").alias("head"), F.col("signature").alias("head_signature")), "head")
    pairs = scratch.save(signed.select("id", "head", "signature", "head_signature").mapInArrow(_can_link(percent), "id long, head long"))
    named = scratch.save(pairs.select(F.explode(F.array("id", "head")).alias("id")).distinct())
    sets = possibly_in(member.select("id", "shingles"), "id", named)
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    head_sets = sets.select(F.col("id").alias("head"), F.col("shingles").alias("head_shingles")).join(parts, "head").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    dealt = pairs.join(parts, "head").withColumn("part", F.expr("CAST(pmod(xxhash64(id), parts) AS INT)")).drop("parts")
    both = dealt.join(sets, "id").join(head_sets, ["head", "part"])
    return both.select("id", "head", "shingles", "head_shingles").mapInArrow(_with_heads(percent), "src long, dst long")


_GROUP = ("cluster", "kl", "sl", "kr", "sr")


def _join_blocks(percent: int):
    """Links of every pair of blocks; rows of a pair come one after the other."""

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2 or len({r[1] for r in rows}) < 2:
            return None
        rows = list({r[0]: r for r in rows}.values())
        side = np.array([r[2] for r in rows])
        found = SkipJoin([np.frombuffer(r[3], np.uint64) for r in rows], [r[1] for r in rows], side, percent).links()
        return pa.RecordBatch.from_arrays([pa.array([rows[x][c] for x, _ in found], pa.int64()) for c in (0, 1)] + [pa.array([rows[y][c] for _, y in found], pa.int64()) for c in (0, 1)], names=["src", "src_label", "dst", "dst_label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_GROUP, "id", "label", "side", "shingles")]
            for row in zip(*columns, strict=True):
                if row[:5] != at:
                    if (out := flush(rows)) is not None:
                        yield out
                    at, rows = row[:5], []
                rows.append(row[5:])
        if (out := flush(rows)) is not None:
            yield out

    return run


def _dealt(member: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Rows (cluster, label, id, n, shingles) dealt to the pairs of blocks that can hold links."""
    # a little wider than the largest ratio of linked sizes, so that rounding can't part two neighbours
    wide = math.log(100 / percent) * 1.0001
    member = member.withColumn("k", F.floor(F.log(F.col("n").cast("double")) / wide).cast("int"))
    # both of a pair of blocks fit together
    cuts = f"greatest(ceil(count(1) / {BLOCK_DOCS}), ceil(sum(n) / {BLOCK_SHINGLES}))"
    whole = member.groupBy("cluster").agg(F.expr(f"CAST({cuts} AS INT)").alias("parts"))
    classes = scratch.save(member.groupBy("cluster", "k").agg(F.expr(f"CAST({cuts} AS INT)").alias("cuts")).join(whole, "cluster"))
    near = classes.select("cluster", "k", "cuts")
    sized = (
        classes.join(near.select("cluster", (F.col("k") - 1).alias("k"), F.col("cuts").alias("above")), ["cluster", "k"], "left")
        .join(near.select("cluster", (F.col("k") + 1).alias("k"), F.col("cuts").alias("below")), ["cluster", "k"], "left")
        .select("cluster", "k", "cuts", "parts", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))
    )
    spot = "named_struct('kl', {}, 'sl', {}, 'kr', {}, 'sr', {}, 'side', {})"
    one = f"array({spot.format('-1', '0', '-1', '0', '0')})"
    same = f"transform(sequence(0, cuts - 1), o -> {spot.format('k', 'least(s, o)', 'k', 'greatest(s, o)', 'if(s > o, 1, 0)')})"
    up = f"if(above = 0, array(), transform(sequence(0, above - 1), o -> {spot.format('k', 's', 'k + 1', 'o', '0')}))"
    down = f"if(below = 0, array(), transform(sequence(0, below - 1), o -> {spot.format('k - 1', 'o', 'k', 's', '1')}))"
    return (
        member.join(sized, ["cluster", "k"]).withColumn("s", F.expr("CAST(pmod(xxhash64(id), cuts) AS INT)"))
        .withColumn("g", F.explode(F.expr(f"if(parts = 1, {one}, concat({same}, {up}, {down}))")))
        .select("cluster", "g.kl", "g.sl", "g.kr", "g.sr", "id", "label", "g.side", "shingles")
        .repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    )


def joined_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90, size: int = SIZE, frequent: int = FREQUENT, often: int = OFTEN) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key that links reach, its own included)."""
    spark = docs.sparkSession
    rows = bare(docs, key, text).toDF("doc_id", "text")
    rows = rows.select(row_name(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(spark) as scratch:
        digests = scratch.save(rows.mapInArrow(_digests(size), "row long, doc_id long, n long, h1 long, h2 long"))
        classes = scratch.save(digests.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("id"), F.min("doc_id").alias("first_id")))
        copies = digests.where("n > 0").join(classes, ["h1", "h2"]).where("row <> id").select("row").distinct()
        single = drop_members(rows.where("text IS NOT NULL"), "row", scratch.save(copies))
        counted = scratch.save(single.select("text").mapInArrow(_counted(size, often), "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1"))
        last = counted.where(F.col("n") >= often).orderBy(F.desc("n"), "m").limit(frequent).toArrow()
        h, n = np.asarray(last.column("m")).view(np.uint64), np.asarray(last.column("n"))
        order = np.argsort(h)
        shared = spark.sparkContext.broadcast((h[order], n[order]))
        repeated, _ = collect_filter(counted.select("m"))
        prefixes = scratch.save(single.select("row", "text").mapInArrow(_prefixes(size, percent, shared, repeated), "id long, n long, skip long, keys binary, signature binary"))
        entries = prefixes.mapInArrow(_entries(percent), "key long, id long, n long, listed boolean")
        twice = scratch.save(entries.groupBy("key").count().where("count > 1").select("key"))
        entries = scratch.save(possibly_in(entries, "key", twice).join(twice, "key").select("key", "id", "n", "listed").dropDuplicates(["key", "id"]))
        wanted = scratch.save(entries.select("id").distinct())
        # rows that repeat id and text are one set; the join has dealt them by the same key
        texts = possibly_in(rows.select("row", "text"), "row", wanted).join(wanted.withColumnRenamed("id", "row"), "row").dropDuplicates(["row"])
        member = scratch.save(texts.mapInArrow(_members(size), "id long, n long, shingles binary"))
        signatures = prefixes.select("id", "signature").join(wanted, "id").dropDuplicates(["id"])
        joined = None
        left = entries
        for _ in range(ROUNDS):
            release(spark)
            # each set against the heads of its lists
            heads = left.where("listed").groupBy("key").agg(F.min(F.struct("n", "id")).alias("h")).select("key", F.col("h.n").alias("head_n"), F.col("h.id").alias("head"))
            headed = scratch.save(left.join(heads, "key").where("id <> head"))
            pairs = headed.where(f"100 * least(n, head_n) >= {percent} * greatest(n, head_n)").select("id", "head").distinct()
            if joined is not None:  # sets that links have joined already
                of = lambda c: joined.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
                pairs = pairs.join(of("id"), "id", "left").join(of("head"), "head", "left").where("NOT coalesce(id_label, id) <=> coalesce(head_label, head)").select("id", "head")
            links = scratch.save(_against_heads(scratch.save(pairs), signatures, member, scratch, percent))
            if joined is not None:  # what was joined before takes part as stars
                links = links.unionByName(joined.select(F.col("label").alias("src"), F.col("id").alias("dst")))
            joined = connected_components(links, scratch)
            # without their heads, lists with more than one component and an indexed set are left
            rest = headed.select("key", "id", "n", "listed").join(joined, "id", "left").withColumn("label", F.coalesce("label", "id"))
            open_lists = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("listed").alias("some"), F.min("id").alias("star")).where("low <> high AND some")
            left = scratch.save(rest.join(open_lists.select("key", "star"), "key").select("key", "id", "n", "listed", "star", "label"))
            lists, left = left, left.select("key", "id", "n", "listed")
            if left.isEmpty():
                break
        left = scratch.save(lists.select("id", "star", "label").distinct())
        clusters = connected_components(left.select(F.col("star").alias("src"), F.col("id").alias("dst")), scratch).withColumnRenamed("label", "cluster")
        open_sets = scratch.save(member.join(left.select("id", "label").distinct(), "id").join(clusters, "id").select("cluster", "label", "id", "n", "shingles"))
        more = scratch.save(_dealt(open_sets, scratch, percent).mapInArrow(_join_blocks(percent), "src long, src_label long, dst long, dst_label long"))
        # components of components
        above = connected_components(more.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")), scratch).select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        of_class = classes.join(joined, "id", "left").withColumn("label", F.coalesce("label", "id")).join(above, "label", "left").withColumn("label", F.coalesce("beyond", "label"))
        of_class = scratch.save(of_class.select("h1", "h2", "label", "first_id"))
        names = of_class.groupBy("label").agg(F.min("first_id").alias("component"))
        of_class = of_class.join(names, "label").select("h1", "h2", "component")
        out = digests.join(of_class, ["h1", "h2"], "left").select(
            F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.expr("CASE WHEN n > 0 THEN component ELSE doc_id END").alias("component_id")
        )
        out = cut(out)
    shared.destroy()
    repeated.destroy()
    return out

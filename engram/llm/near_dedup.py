"""Near-duplicate documents by SetSketch registers (operator 5).

Words of the lower-cased text (A-Z only) give a set of distinct 5-word shingles.  One pass over the
texts computes, per document, the set and its sketch: every shingle is a Poisson process of arrivals
dealt at random over ``registers`` registers, a register keeps its earliest arrival, and arrivals
beyond a truncation time that the set's own size fixes are never generated.  Register values are
exponentially spaced, so a sketch of a union is the register-wise best of two sketches.

Candidates: equal register bands put documents into the same candidate cluster (components of
document - band representative edges; no pairs are listed).  Sets too small for a sketch use a prefix
of their shingles in hash order instead, which is exact.  A passage that many documents have makes
one cluster of them all, though few are alike; so a cluster of more than one block whose sets aren't
mostly alike is divided once more, by prefixes of full sets in the order of the cluster's own frequencies, which is exact too:
its smallest shared shingle is in the prefix of both sets of a pair.  What is left is cut into blocks
by size; in each pair of blocks the similarity of a pair is first estimated jointly from the registers and both
known sizes by maximum likelihood, and pairs that the estimate doesn't rule out are confirmed on the
full sets.  A pair already joined inside the task needs no confirmation.  The confirmed links'
components are the groups.

Defined results: null or empty texts have an empty set and are linked with nothing; texts with fewer
words than a shingle have the whole sequence as the only element; rows with equal sets always share a
group; a null id never becomes a group's id unless the group has no other; rows that share an id but not the text are documents of
their own, repeated rows each get a row (and stay or go together); very long texts are whole sets; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparktools import Scratch, bare, connected_components, cut, drop_members, possibly_in, tidy
from .words import mix, slices, split_words, window_hashes

SHINGLE = 5
REGISTERS = 180
BAND = 6
#: Spacing of register values: value = floor(1 - log_SPACING(arrival)).
SPACING = 1.02
#: Sets smaller than this use the exact prefix instead of bands.
SMALL = 48
#: Documents, and shingles, in a block of a candidate cluster.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Rows of a block that a row meets first, before it is seen which of the others are joined with it.
MET_AT_ONCE = 32
#: Standard errors that an estimate may fall short of the threshold before the pair is ruled out.
SLACK = 4.5


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = split_words(column, lower=True)
    runs = window_hashes(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = words.hash[a:b] * (np.arange(b - a, dtype=np.uint64) * np.uint64(2) + np.uint64(3))
            out.append(mix(np.array([int(short.sum(dtype=np.uint64)) ^ (b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(sets: list[np.ndarray], registers: int = REGISTERS, spacing: float = SPACING) -> np.ndarray:
    """Register values (len(sets) x registers, uint16) of non-empty sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    best = np.full(len(sets) * registers, np.inf)
    todo, reach = np.arange(len(sets)), np.log(registers) + 6.0
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo].astype(np.int64))
        limit = (reach / sizes)[owner]
        time, state = np.zeros(len(element)), element
        while len(state):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            # the top 53 bits give the gap, the low 11 bits the register
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / registers
            live = time < limit
            state, time, owner, limit = state[live], time[live], owner[live], limit[live]
            register = ((state & np.uint64(2047)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
            np.minimum.at(best, owner * registers + register, time)
        todo = np.flatnonzero(np.isinf(best.reshape(len(sets), registers)).any(axis=1))
        reach *= 1.5
    values = np.floor(1.0 - np.log(best) / np.log(spacing)) + 2000.0
    return np.clip(values, 0, 65535).astype(np.uint16).reshape(len(sets), registers)


def _log_p(x: np.ndarray, spacing: float) -> np.ndarray:
    return -np.log1p(-x * (spacing - 1) / spacing) / np.log(spacing)


def estimate(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, registers: int = REGISTERS, spacing: float = SPACING) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the counts of registers where a's value is above or below b's."""
    u = (size_a / (size_a + size_b))[:, None]
    v = 1.0 - u
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)
    up = np.clip(_log_p(u - v * grid, spacing), 1e-9, None)
    down = np.clip(_log_p(v - u * grid, spacing), 1e-9, None)
    same = np.clip(1.0 - up - down, 1e-9, None)
    likely = above[:, None] * np.log(up) + below[:, None] * np.log(down) + (registers - above - below)[:, None] * np.log(same)
    return np.take_along_axis(grid, likely.argmax(axis=1)[:, None], axis=1)[:, 0]


def _keys(sets: list[np.ndarray], values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordinal of the set, key) of every band and of every prefix element."""
    bands = REGISTERS // BAND
    at = np.zeros((len(sets), bands), dtype=np.uint64)
    for k in range(BAND):
        at = mix(at * np.uint64(3) + values[:, k::BAND][:, :bands].astype(np.uint64) + np.uint64(1))
    at = mix(at + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))
    sizes = np.array([len(s) for s in sets])
    large = np.flatnonzero(sizes >= SMALL)
    owners, keys = [np.repeat(large, bands)], [at[large].ravel()]
    for i in np.flatnonzero(sizes * percent < SMALL * 100).tolist():
        prefix = sets[i][: int(sizes[i]) - (int(sizes[i]) * percent + 99) // 100 + 1]
        owners.append(np.full(len(prefix), i))
        keys.append(mix(prefix ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(owners), np.concatenate(keys)


_DIGEST = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.binary())])
_MEMBER = pa.schema([("cluster", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.binary())])


def _set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    every = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(every ^ np.uint64(salt)))))
        out.append(mix(total[first[1:]] - total[first[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _digests(percent: int):
    """Per document: set size, set hash and the candidate keys (bands or prefix) of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                h1, h2 = _set_hashes(sets)
                some = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
                keys: list[bytes] = [b""] * len(sets)
                if len(some):
                    filled = [sets[i] for i in some]
                    owner, key = _keys(filled, sketch(filled), percent)
                    order = np.argsort(owner, kind="stable")
                    ends = np.cumsum(np.bincount(owner, minlength=len(some)))[:-1]
                    for i, k in zip(some.tolist(), np.split(key[order], ends), strict=True):
                        keys[i] = k.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array(keys, pa.binary())],
                    schema=_DIGEST,
                )

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets and sketches of the documents of candidate clusters."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("cluster"), part.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([v.tobytes() for v in sketch(sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                schema=_MEMBER,
            )


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
        owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in keys]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), batch.column("id").take(owner), batch.column("doc_id").take(owner)], names=["key", "id", "doc_id"])


def _explode_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "shingles"):
            sets = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
            owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(s) for s in sets]))
            own = [batch.column(c).take(owner) for c in ("cluster", "id", "n")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["cluster", "id", "n", "shingle"])


def _divided(member: DataFrame, wide: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The clusters that are divided, and (id, cluster) of their members that may be linked with another: components by shared prefixes.

    A set's prefix are its n - ceil(n * percent / 100) + 1 shingles that fewest sets of its cluster have.  Shingles of
    one set alone come first and are shared with none, so only their number counts.  Clusters of ``wide`` (cluster, docs,
    total) whose mean pair shares two thirds of a mean set stay whole: nearly all of their pairs would be left.
    """

    def shingles(of: DataFrame) -> DataFrame:
        return member.join(F.broadcast(of.select("cluster")), "cluster").select("cluster", "id", "n", "shingles").mapInArrow(tidy(_explode_shingles), "cluster long, id long, n long, shingle long")

    often = scratch.save(shingles(wide).groupBy("cluster", "shingle").agg(F.count("*").alias("sets")).where("sets > 1"))
    shared = often.groupBy("cluster").agg(F.expr("sum(sets * (sets - 1))").alias("shared"))
    unlike = scratch.save(wide.join(shared, "cluster", "left").where("3 * coalesce(shared, 0) < 2 * total * (docs - 1)").select("cluster"))
    own = shingles(unlike).join(often, ["cluster", "shingle"]).groupBy("cluster", "id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("own"))
    left = F.expr(f"int(n - (n * {percent} + 99) DIV 100 + 1 - (n - size(own)))")
    prefix = own.withColumn("left", left).where("left > 0").select("cluster", "id", F.explode(F.slice("own", 1, F.col("left"))["shingle"]).alias("key"))
    prefix = scratch.save(prefix)
    first = scratch.save(prefix.groupBy("cluster", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("cluster", "key", "low"))
    edges = prefix.join(first, ["cluster", "key"]).where("id <> low").select(F.col("low").alias("src"), F.col("id").alias("dst"))
    return unlike, connected_components(edges, scratch).select("id", F.col("label").alias("cluster"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _links_of_block(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links inside a block, or between two blocks (side 0 and 1).

    A row meets the others a few at a time, and no more those that are joined with it by then: in a group of copies each
    row meets a few others instead of all.
    """
    root, found = np.arange(len(ids)), []
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    threshold = percent / 100
    floor = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    two = bool(side.any())
    lefts = np.flatnonzero(side == 0)
    for i in lefts.tolist():
        rest = np.flatnonzero(side == 1) if two else np.arange(i + 1, len(ids))
        n = sizes[i]
        rest = rest[(sizes[rest] * 100 >= n * percent) & (n * 100 >= sizes[rest] * percent)]
        step = MET_AT_ONCE
        while len(rest := rest[root[rest] != root[i]]):
            others, rest, step = rest[:step], rest[step:], step * 4
            above, below = (values[i] > values[others]).sum(axis=1), (values[i] < values[others]).sum(axis=1)
            # an estimate can't exceed the share of equal registers by much; cheap cut before the likelihood
            near = (REGISTERS - above - below) >= (floor - 0.05) * REGISTERS
            near |= sizes[others] < SMALL
            others, above, below = others[near], above[near], below[near]
            if not len(others):
                continue
            likely = (estimate(above, below, np.full(len(others), n), sizes[others]) >= floor) | (sizes[others] < SMALL)
            for j in others[likely].tolist():
                if root[i] == root[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[root == root[j]] = root[i]
                    found.append((int(ids[i]), int(ids[j])))
    return found


def _confirm(percent: int):
    """Links of every (cluster, pair of blocks); rows of a group come one after the other."""

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        rows.sort(key=lambda r: r[0])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        values = np.stack([np.frombuffer(r[2], np.uint16) for r in rows])
        found = _links_of_block(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), sets, values, percent)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "low", "high", "id", "side", "sketch", "shingles")]
            for cluster, low, high, *row in zip(*columns, strict=True):
                if (cluster, low, high) != at:
                    if (out := flush(rows)) is not None:
                        yield out
                    at, rows = (cluster, low, high), []
                rows.append(tuple(row))
        if (out := flush(rows)) is not None:
            yield out

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key of its group), kept (it is that one).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    return _grouped(docs, key, text, percent).select(F.col("doc_id").alias(key), "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays in each group; only rows that may have to go are shuffled."""
    gone = _grouped(docs, key, text, percent).where("NOT stays").select("row").distinct()
    named = docs.withColumn("__row_name", _row_name(F.col(f"`{key}`"), F.col(f"`{text}`")))
    return drop_members(named, "__row_name", gone).drop("__row_name")


def _row_name(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("long"), text)


def _blocks(placed: DataFrame) -> DataFrame:
    """(cluster, docs, total, blocks): the documents and shingles of each cluster of the rows (cluster, id, n), and the number of blocks it is cut into."""
    return (
        placed.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int"))
    )


def _grouped(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """row (a hash of key and text), doc_id, n_shingles, component_id, kept (its id is the component's), stays (it is the component's one row)."""
    spark = docs.sparkSession
    rows = bare(docs, key, text).toDF("doc_id", "text")
    rows = rows.select(
        _row_name(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text",
    )
    with Scratch(spark) as scratch:
        digests = scratch.save(rows.mapInArrow(tidy(_digests(percent)), "row long, doc_id long, n long, h1 long, h2 long, keys binary"))
        classes = digests.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("id"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("best"), F.first("keys").alias("keys"))
        classes = scratch.save(classes)
        # a band's representative is its smallest document, mostly the same one for all bands of a group, so that few edges differ
        bands = scratch.save(classes.select("id", "best.doc_id", "keys").mapInArrow(_explode_keys, "key long, id long, doc_id long"))
        shared = bands.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
        shared = scratch.save(shared.select("key", F.col("first.id").alias("low")))
        edges = bands.join(shared, "key").where("id <> low").select(F.col("low").alias("src"), F.col("id").alias("dst"))
        clusters = connected_components(edges, scratch).withColumnRenamed("label", "cluster")
        # only documents of clusters send their texts through the shuffle
        texts = possibly_in(rows.select(F.col("row").alias("id"), "text"), "id", clusters.select("id"))
        member = texts.join(clusters, "id").select("cluster", "id", "text").mapInArrow(tidy(_members), "cluster long, id long, n long, sketch binary, shingles binary")
        member = scratch.save(member.dropDuplicates(["cluster", "id"]))
        # rows without sets tell who is compared with whom; the sets follow once, by id
        placed = member.select("cluster", "id", "n")
        sized = scratch.save(_blocks(placed))
        wide = sized.where("blocks > 1")
        if not wide.isEmpty():
            # rows for BLOCK_DOCS members or BLOCK_SHINGLES shingles at least, few enough to be broadcast
            divided, parts = _divided(member, wide, percent, scratch)
            whole = placed.join(F.broadcast(divided), "cluster", "left_anti")
            placed = scratch.save(whole.unionByName(placed.drop("cluster").join(parts, "id").select("cluster", "id", "n")))
            sized = scratch.save(_blocks(placed))
        dealt = (
            member.drop("cluster").join(placed.drop("n").join(sized, "cluster"), "id")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id",
                F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "sketch", "shingles",
            )
            .repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
        )
        links = dealt.mapInArrow(tidy(_confirm(percent)), "src long, dst long")
        groups = connected_components(links, scratch)
        labels = scratch.save(classes.join(groups, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("label"), "best"))
        names = labels.groupBy("label").agg(F.min("best").alias("best"))
        labels = labels.drop("best").join(names, "label").select("h1", "h2", "best")
        out = digests.join(labels, ["h1", "h2"], "left").select(
            "row",
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.expr("CASE WHEN n > 0 THEN best.doc_id ELSE doc_id END").alias("component_id"),
            F.expr("n = 0 OR if(best.nameless, row = best.row, doc_id <=> best.doc_id)").alias("kept"),
            F.expr("n = 0 OR row = best.row").alias("stays"),
        )
        return cut(out)

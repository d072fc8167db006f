"""Repeated passages: words covered by an earlier equal window (operator 9).

Every run of ``k`` words is an edge of a de Bruijn graph over the corpus.  Only edges that occur more
than once matter, so they are found in two steps.  First each window is named by its minimiser (the
smallest hash of the short grams inside it): equal windows have equal minimisers, and a window holds
about one minimiser per seven words, so counting minimisers is cheap.  A Bloom filter of fixed largest
size, made from the minimisers that occur twice, then lets only possible repeats through (a filter
that is full lets more through and changes no result).  Possible repeats are ordered by their source
coordinates inside each task, which keeps one row per task and edge, however often it occurs; the
rest of the order is settled by one shuffle on the edge.  Consecutive repeats whose sources are
consecutive too are put together into a span, which is cut out of the text.

What this does not do: the graph's nodes and their degrees are not made, paths are not compacted by joins (neighbours
in a document are, by windows), and a span is not compared with its source's words: two 64-bit hashes of every window decide.

Documents with the same word sequence are one class; only its smallest id takes part in the edges.

Defined results: a null or empty text has no words and keeps the hash of the empty text; equal windows are ordered by (id, hash of id and
text, position), rows without an id last: rows that share an id but not the text are documents of their own, rows that share both are
one document and get equal rows; very long texts are whole documents; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sparktools import BUCKET_BITS, Scratch, bare, cut, drop_members
from .words import Words, chunks, mix, slices, split_words, window_hashes

K = 20
GRAM = 8
#: The filter of repeated minimisers never takes more than this many buckets of 4 KB.
FILTER_BUCKETS = 8192
#: Possible repeats that a task holds before it orders and sends them.
HELD = 1 << 20
_PLACE = np.uint64((1 << 20) - 1)

def _digest(words: Words, i: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of a text's words, or of those that ``keep`` marks, joined by one space."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    raw = words.data[words.text_offsets[i] : words.text_offsets[i + 1]].tobytes()
    parts = raw.split()
    if keep is not None:
        parts = [parts[j] for j in np.flatnonzero(keep[: b - a]).tolist()]
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _sequences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts)
    place = mix(place.astype(np.uint64) + np.uint64(1))
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words.hash ^ (place * np.uint64(salt))))))
        out.append(mix(total[words.first[1:]] - total[words.first[:-1]] + words.counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _full_windows(words: Words, size: int) -> np.ndarray:
    """Marks the positions at which a window of ``size`` words fits into its text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    end = np.repeat(words.first[1:], words.counts)[:n]
    return np.arange(n) + size <= end


def _minimisers(words: Words, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window positions that fit, the minimiser of each, and whether it is another occurrence than the window's before."""
    fits = np.flatnonzero(_full_windows(words, k))
    if not len(fits):
        return fits, np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = window_hashes(words.hash, gram)
    # 44 bits of the hash, then the place: the running minimum also tells which occurrence it is
    packed = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    span = k - gram + 1
    low, width = packed, 1  # running minimum over ``span`` grams by doubling
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])[fits]
    fresh = np.ones(len(low), dtype=bool)
    if len(grams) <= int(_PLACE):  # in a longer slice places come again, so each window counts
        fresh[1:] = low[1:] != low[:-1]
    return fits, mix(low >> np.uint64(20)), fresh


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            h1, h2 = _sequences(words)
            sha = pa.array([_digest(words, i) for i in range(part.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(words.counts, pa.int64()), pa.array(h1), pa.array(h2), sha], names=["doc_id", "row", "n", "h1", "h2", "sha"]
            )


def _minimiser_rows(k: int, gram: int):
    """(minimiser, count) of each task; windows that share one occurrence of it count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(counts, 2), pa.int64())], names=["m", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                fits, low, fresh = _minimisers(words, k, gram)
                if len(fits):
                    held.append(low[fresh])
                    size += len(held[-1])
                    if size > HELD:
                        yield from chunks(flush())
                        held, size = [], 0
        if held:
            yield from chunks(flush())

    return run


class _Filter:
    """Looks values up in the collected buckets of a filter table, as filter_positions places them."""

    def __init__(self, bits: np.ndarray, buckets: int):
        self.bits, self.buckets = bits, buckets

    def has(self, values: np.ndarray) -> np.ndarray:
        at = place(values, self.buckets)
        out = np.ones(len(values), dtype=bool)
        for p in at:
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def place(values: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Bit positions of three probes of each value; a value's probes share a bucket."""
    bucket = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    base = bucket * np.uint64(BUCKET_BITS)
    return [base + ((values >> np.uint64(s)) & np.uint64(BUCKET_BITS - 1) if s else values & np.uint64(BUCKET_BITS - 1)) for s in (0, 11, 17)]


def _candidate_rows(k: int, gram: int, shared):
    """Three kinds of rows: 1 a document with possible repeats and its text, 2 an edge's first place in
    this task, 3 the repeats inside a document that the task itself could tell."""

    schema = pa.schema([
        ("kind", pa.int32()), ("nameless", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("text", pa.large_binary()), ("spans", pa.binary()),
        ("edge", pa.int64()), ("edge2", pa.int64()), ("at", pa.int64()),
    ])

    def rows(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, buckets = shared.value
        repeated = _Filter(bits, buckets)
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nameless, ids, row, at, edge, edge2 = (np.concatenate([h[c] for h in held]) for c in range(6))
            order = np.lexsort((at, row, ids, nameless, edge2, edge))
            nameless, ids, row, at, edge, edge2 = (x[order] for x in (nameless, ids, row, at, edge, edge2))
            first = np.ones(len(ids), dtype=bool)
            first[1:] = (edge[1:] != edge[:-1]) | (edge2[1:] != edge2[:-1])
            yield from chunks(rows(
                kind=pa.array(np.full(int(first.sum()), 2)), nameless=pa.array(nameless[first]), doc_id=pa.array(ids[first]), row=pa.array(row[first]), edge=pa.array(edge[first].view(np.int64)),
                edge2=pa.array(edge2[first].view(np.int64)), at=pa.array(at[first]),
            ))
            late = np.flatnonzero(~first)
            source = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))[late]
            same = (row[late] == row[source]) & (at[late] == at[source])  # the same row read twice
            late = late[~same]
            order = np.lexsort((at[late], row[late]))
            row, at = row[late][order], at[late][order]
            if len(row):
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                begin = np.flatnonzero(new)
                length = np.diff(np.append(begin, len(row)))
                owner = row[begin]
                cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
                pairs = np.stack([at[begin], length], axis=1)
                yield rows(
                    kind=pa.array(np.full(len(cuts) + 1, 3)), row=pa.array(owner[np.concatenate(([0], cuts))]),
                    spans=pa.array([p.tobytes() for p in np.split(pairs, cuts)], pa.binary()),
                )

        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                fits, low, _ = _minimisers(words, k, gram)
                chosen = fits[repeated.has(low)] if len(fits) else fits
                text_of = np.searchsorted(words.first, chosen, "right") - 1
                busy = np.zeros(part.num_rows, dtype=bool)
                busy[text_of] = True
                ids = np.asarray(pc.fill_null(part.column("doc_id"), 0))
                nameless, row = np.asarray(pc.is_null(part.column("doc_id"))), np.asarray(part.column("row"))
                if len(chosen):
                    edge = window_hashes(words.hash, k)[chosen]
                    edge2 = window_hashes(mix(words.hash ^ np.uint64(0x1F83D9ABFB41BD6B)), k)[chosen]
                    held.append((nameless[text_of], ids[text_of], row[text_of], chosen - words.first[text_of], edge, edge2))
                    size += len(chosen)
                own = part.filter(pa.array(busy))
                if own.num_rows:
                    yield rows(kind=pa.array(np.full(own.num_rows, 1)), row=own.column("row"), text=own.column("text"))
                if size > HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


_ROWS = "kind int, nameless boolean, doc_id long, row long, text binary, spans binary, edge long, edge2 long, at long"


def _cut_out(k: int):
    """Removes the words that the spans of windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), hashes=False)
                removed, sha = [], []
                spans = part.column("spans").to_pylist()
                for i, blobs in enumerate(spans):
                    n = int(words.counts[i])
                    edge = np.zeros(n + 1, dtype=np.int64)
                    for blob in blobs or ():
                        for at, length in np.frombuffer(blob, np.int64).reshape(-1, 2).tolist():
                            edge[at] += 1
                            edge[min(n, at + length - 1 + k)] -= 1
                    gone = np.cumsum(edge)[:n] > 0
                    removed.append(int(gone.sum()))
                    sha.append(_digest(words, i, ~gone))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["row", "n_removed", "kept_sha256"]
                )

    return run


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 after removing words of windows seen earlier."""
    spark = docs.sparkSession
    rows = bare(docs, key, text).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    with Scratch(spark) as scratch:
        digests = scratch.save(rows.mapInArrow(_digests, "doc_id long, row long, n long, h1 long, h2 long, sha string"))
        classes = scratch.save(digests.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("h1", "h2", F.col("first.row").alias("first_row")))
        named = scratch.save(digests.join(classes, ["h1", "h2"]).select("doc_id", "row", "n", "sha", "first_row"))
        # only the class's first document takes part in the edges
        single = drop_members(rows, "row", named.where("row <> first_row").select("row").distinct())
        minimisers = single.select("text").mapInArrow(_minimiser_rows(k, gram), "m long, n long")
        twice = scratch.save(minimisers.groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m"))
        shared, _ = _collect_filter(twice)
        found = scratch.save(single.mapInArrow(_candidate_rows(k, gram, shared), _ROWS))
        shared.destroy()
        place_of = Window.partitionBy("edge", "edge2").orderBy("nameless", "doc_id", "row", "at")
        edges = found.where("kind = 2").select(
            "row", "at", F.first("row").over(place_of).alias("source"), F.first("at").over(place_of).alias("source_at")
        ).where("row <> source OR at <> source_at")
        # a nonbranching path: neighbours in the document whose sources are neighbours too
        run_of = Window.partitionBy("row").orderBy("at")
        paths = (
            edges.dropDuplicates(["row", "at"])
            .withColumn("new", F.when((F.col("at") == F.lag("at").over(run_of) + 1) & (F.col("source") == F.lag("source").over(run_of)) & (F.col("source_at") == F.lag("source_at").over(run_of) + 1), 0).otherwise(1))
            .withColumn("path", F.sum("new").over(run_of))
            .groupBy("row", "path").agg(F.min("at").alias("at"), F.count("*").alias("length"))
        )
        spans = paths.select("row", F.array("at", "length").alias("pair")).mapInArrow(_pack, "row long, spans binary")
        spans = spans.unionByName(found.where("kind = 3").select("row", "spans"))
        spans = scratch.save(spans.groupBy("row").agg(F.collect_list("spans").alias("spans")))
        busy = found.where("kind = 1").select("row", "text").join(spans, "row")
        shorter = busy.mapInArrow(_cut_out(k), "row long, n_removed long, kept_sha256 string").dropDuplicates(["row"])
        gone = f"row <> first_row AND n >= {k}"
        out = named.join(shorter, "row", "left").select(
            F.col("doc_id").alias(key),
            F.col("n").alias("n_words"),
            F.expr(f"CASE WHEN {gone} THEN n ELSE coalesce(n_removed, 0) END").alias("n_removed"),
            F.expr(f"CASE WHEN {gone} THEN '{EMPTY_SHA}' ELSE coalesce(kept_sha256, sha) END").alias("kept_sha256"),
        )
        return cut(out)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [np.array(p, dtype=np.int64).tobytes() for p in batch.column("pair").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(pairs, pa.binary())], names=["row", "spans"])


def _collect_filter(values: DataFrame):
    """Broadcasts the bits of a filter of at most FILTER_BUCKETS buckets."""
    spark = values.sparkSession
    buckets = int(min(FILTER_BUCKETS, max(1, -(-values.count() // 2048))))

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([*place(np.asarray(batch.column("m")).view(np.uint64), buckets), np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array((at // BUCKET_BITS).astype(np.int64)), pa.array((at % BUCKET_BITS).astype(np.int64))], names=["bucket", "bit"])

    table = values.mapInArrow(bits_of, "bucket long, bit long").groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    bits = np.zeros(buckets * BUCKET_BITS // 8, dtype=np.uint8)
    for bucket, raw in table.collect():
        bits[bucket * BUCKET_BITS // 8 : (bucket + 1) * BUCKET_BITS // 8] = np.frombuffer(raw, np.uint8)
    return spark.sparkContext.broadcast((bits, buckets)), buckets

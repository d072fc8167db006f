"""Ranked lexical search over a clustered index (operator 13).

Terms are runs of letters and digits (A-Z lower-cased).  An item's terms, once each, rank the documents by
integer parts: a term's weight floor(1000 * ln((2N + 2) / (2df + 1))) times (10^9 * tf) div (1000 * tf + 20 * m),
m = 50 + (50 * n * N) div L, for N documents with terms, L terms in all, n in the document.

Index, built by Spark jobs: one pass encodes every whole text by the terms that the items hold (its other terms
count in n, N and L).  Recursive graph bisection orders the documents: a node's documents are halved, and
documents change sides in pairs while that lowers the summed logarithms of the gaps between a term's documents.
The upper levels are fitted on a bounded sample (``SAMPLE`` documents, chosen by a hash) and every other document is
routed down them by the same cost; what reaches a leaf is cut into shards of about ``SHARD`` documents, and every shard
is bisected on all its documents down to clusters of ``CLUSTER``.  A leaf that many copies reach has more shards,
no larger ones.  The order only decides how much can be skipped, never a result.

Search: a cluster's and a shard's largest part of every term bound the score of their documents.  For each item the
``SEEDS`` shards of the highest bounds are searched first; the score of the last place there is a threshold.  Then all
shards are passed by the items whose bound reaches it; inside a shard clusters are visited by falling bound, until a
bound is below the threshold or the last place (equal bounds are visited, so ties are exact).  A shard sends at
most ``top`` rows an item; ties are settled by doc_id, to which places in the order are mapped back.

Items are the stated query set: they are read in blocks of at most ``ITEMS`` items and about ``TERMS`` distinct terms, and
only a block's terms, weights and thresholds are broadcast or collected.

Defined results: null texts have no terms and documents without terms are not counted; ids that repeat are
documents of their own, each with a place, a null id stands after all others among equal scores; items without terms give no
rows, items that repeat are ranked each; very long texts are whole documents; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sparktools import Scratch, bare, cut
from .terms import ALNUM, split_terms
from .words import slices

TOP = 50
ITEMS, TERMS = 2048, 1 << 16
SAMPLE, SHARD, CLUSTER = 8192, 2048, 32
#: Levels of the sampled tree at most, rounds of swaps in a node, shards searched for the threshold.
LEVELS, SWAPS, SEEDS = 6, 8, 2
SLICE = 8 << 20


class Queries:
    """A block of items: ids, places of their terms in the sorted vocabulary."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        terms, first = split_terms(pa.array([r[1] for r in rows], pa.string()), ALNUM)
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.vocabulary = coded.dictionary.take(order)
        place = np.empty(len(order), dtype=np.int32)
        place[np.asarray(order)] = np.arange(len(order))
        code = place[np.asarray(coded.indices)]
        self.terms = [np.unique(code[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def query_blocks(items: DataFrame, most_items: int = ITEMS, most_terms: int = TERMS) -> Iterator[Queries]:
    """The items (item_id, text) in blocks of bounded size; an item of more terms than the bound is a block of its own."""
    held, size = [], 0
    for row in items.where("text IS NOT NULL").toLocalIterator():
        n = len(Queries([tuple(row)]).vocabulary)
        if held and (len(held) >= most_items or size + n > most_terms):
            yield Queries(held)
            held, size = [], 0
        held.append(tuple(row))
        size += n
    if held:
        yield Queries(held)


def _encode(shared):
    """doc_id, n, and the places and counts of known terms of every text that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                terms, first = split_terms(part.column("text"), ALNUM)
                place = np.asarray(pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1)).astype(np.int64)
                known = np.flatnonzero(place >= 0)
                text = np.searchsorted(first, known, "right") - 1
                pair, tf = np.unique(text * len(vocabulary) + place[known], return_counts=True)
                ends = np.searchsorted(pair, np.arange(part.num_rows + 1) * len(vocabulary))
                ids, tf = (pair % max(1, len(vocabulary))).astype(np.int32), tf.astype(np.int32)
                n = np.diff(first)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(some)), pa.array(n[some], pa.int64()),
                        pa.array([ids[ends[i] : ends[i + 1]].tobytes() for i in some.tolist()], pa.binary()),
                        pa.array([tf[ends[i] : ends[i + 1]].tobytes() for i in some.tolist()], pa.binary()),
                    ],
                    names=["doc_id", "n", "ids", "tf"],
                )

    return run


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column and where each row's begin."""
    raw = column.to_pylist()
    sizes = np.array([len(r) for r in raw], dtype=np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind), np.concatenate(([0], np.cumsum(sizes)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n = np.unique(_joined(batch.column("ids"), np.int32)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n, pa.int64())], names=["id", "df"])


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the ranges first[i] .. first[i + 1]."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _gains(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> tuple[np.ndarray, np.ndarray]:
    """By term, what the cost falls when a document with it goes from left to right, and from right to left."""

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * np.log2(n_left / (a + 1.0)) + b * np.log2(n_right / (b + 1.0))

    now = cost(left, right)
    return now - cost(np.maximum(left - 1, 0), right + 1), now - cost(left + 1, np.maximum(right - 1, 0))


def bisect(ids: np.ndarray, first: np.ndarray, size: int, rounds: int = SWAPS) -> np.ndarray:
    """Halves documents (rows of term places): marks those on the right side."""
    n = len(first) - 1
    right = np.arange(n) >= n // 2
    sizes = np.diff(first)
    if n < 2:
        return right
    for _ in range(rounds):
        entry = np.repeat(right, sizes)
        on_right = np.bincount(ids[entry], minlength=size)
        on_left = np.bincount(ids[~entry], minlength=size)
        to_right, to_left = _gains(on_left, on_right, n // 2, n - n // 2)
        gain = row_sums(np.where(entry, to_left[ids], to_right[ids]), first)
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = int(np.count_nonzero(gain[a[:m]] + gain[b[:m]] > 1e-9))  # sums fall, so the first ones
        if not swap:
            break
        right[a[:swap]], right[b[:swap]] = True, False
    return right


def rows_of(ids: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen rows, in that order."""
    sizes = np.diff(first)[chosen]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(first[:-1][chosen], sizes)
    return ids[at], ends


def bisected_order(ids: np.ndarray, first: np.ndarray, size: int, cluster: int = CLUSTER) -> np.ndarray:
    """Rows in the order of recursive bisection down to clusters."""
    todo, out = [np.arange(len(first) - 1)], []
    while todo:
        rows = todo.pop()
        if len(rows) <= cluster:
            out.append(rows)
            continue
        own, ends = rows_of(ids, first, rows)
        terms, own = np.unique(own, return_inverse=True)
        right = bisect(own, ends, len(terms))
        todo += [rows[right], rows[~right]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def sampled_tree(ids: np.ndarray, first: np.ndarray, size: int, levels: int) -> np.ndarray:
    """By node (heap order) and term, the leaning to the left side (float32, nodes x size) of a bisected sample."""
    lean = np.zeros((max(1, 2**levels - 1), size), dtype=np.float32)
    parts = {0: np.arange(len(first) - 1)}
    for node in range(2**levels - 1):
        rows = parts.pop(node)
        own, ends = rows_of(ids, first, rows)
        right = bisect(own, ends, size)
        entry = np.repeat(right, np.diff(ends))
        a, b = np.bincount(own[~entry], minlength=size), np.bincount(own[entry], minlength=size)
        lean[node] = np.log2((a + 1.0) / max(1, len(rows) // 2)) - np.log2((b + 1.0) / max(1, len(rows) - len(rows) // 2))
        parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
    return lean


def _route(shared, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean = shared.value
        for batch in batches:
            ids, first = _joined(batch.column("ids"), np.int32)
            node = np.zeros(batch.num_rows, dtype=np.int64)
            for _ in range(levels):
                leaning = row_sums(lean[np.repeat(node, np.diff(first)), ids].astype(np.float64), first)
                node = 2 * node + 1 + (leaning < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node - (2**levels - 1), pa.int64())], names=[*batch.schema.names, "leaf"])

    return run


_INDEX = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("doc_id", "no_id", "first", "ids", "part", "cluster_first", "cluster_ids", "cluster_part", "shard_ids", "shard_part")]])


def _largest(ids: np.ndarray, part: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and their largest part in each range of entries."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = owner * size + ids
    order = np.argsort(key, kind="stable")
    key, part = key[order], part[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    best = np.maximum.reduceat(part, starts) if len(starts) else part
    return (key[starts] % size).astype(np.int32), best, np.searchsorted(key[starts], np.arange(len(first)) * size)


def _build(size: int, n_docs: int, n_terms: int, cluster: int):
    """A shard's row of the index from its documents' vectors."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, first = _joined(table.column("ids"), np.int32)
        tf, _ = _joined(table.column("tf"), np.int32)
        order = bisected_order(ids, first, size, cluster)
        own, ends = rows_of(ids, first, order)
        tf = rows_of(tf, first, order)[0].astype(np.int64)
        n = np.asarray(table.column("n"))[order]
        m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64)  # Python's integers don't overflow
        part = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(ends)))
        bounds = np.append(ends[:-1:cluster], ends[-1])
        c_ids, c_part, c_first = _largest(own, part, bounds, size)
        s_ids, s_part, _ = _largest(c_ids, c_part, np.array([0, len(c_ids)]), size)
        doc_id = table.column("doc_id").combine_chunks().take(pa.array(order))
        row = [
            np.asarray(pc.fill_null(doc_id, 0)).astype(np.int64), np.asarray(pc.is_null(doc_id)), ends.astype(np.int64), own, part.astype(np.int32),
            c_first.astype(np.int64), c_ids, c_part.astype(np.int32), s_ids, s_part.astype(np.int32),
        ]
        return pa.Table.from_arrays([pa.array([table.column("shard")[0].as_py()], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in row]], schema=_INDEX)

    return run


_KINDS = {"doc_id": np.int64, "no_id": np.bool_, "first": np.int64, "ids": np.int32, "part": np.int32, "cluster_first": np.int64, "cluster_ids": np.int32, "cluster_part": np.int32, "shard_ids": np.int32, "shard_part": np.int32}


def _shards(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("shard")[i].as_py(), {c: np.frombuffer(batch.column(c)[i].as_py(), _KINDS[c]) for c in columns}


def _bounds(shared, seeds: int):
    """(item, shard, bound) of the task's ``seeds`` highest shards of each item: no other can be among the highest of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in terms]
        dense = np.zeros(len(weight), dtype=np.int64)
        for shard, own in _shards(batches, ["shard_ids", "shard_part"]):
            dense[:] = 0
            dense[own["shard_ids"]] = own["shard_part"]
            for item, places in enumerate(terms):
                bound = int((dense[places] * weight[places]).sum())
                if bound > 0:
                    best[item] = sorted([*best[item], (-bound, shard)])[:seeds]
        rows = [(item, shard, -bound) for item, found in enumerate(best) for bound, shard in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "shard", "bound"])

    return run


def _search(shared, top: int, cluster: int, seed_round: bool):
    """(item, doc_id, score) of each shard's best documents that can be among an item's ``top``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, seeds, least = shared.value
        for shard, own in _shards(batches, list(_KINDS)):
            first, ids, part, n = own["first"], own["ids"], own["part"].astype(np.int64), len(own["doc_id"])
            c_first, c_ids, c_part = own["cluster_first"], own["cluster_ids"], own["cluster_part"].astype(np.int64)
            whole = np.zeros(len(weight), dtype=np.int64)
            whole[own["shard_ids"]] = own["shard_part"]
            mine = seeds.get(shard, frozenset())
            w = np.zeros(len(weight), dtype=np.int64)
            out = []
            for item, places in enumerate(terms):
                floor = max(1, least[item])
                if (item in mine) != seed_round or int((whole[places] * weight[places]).sum()) < floor:
                    continue
                w[places] = weight[places]
                bound = row_sums(w[c_ids] * c_part, c_first)
                rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for c in np.argsort(-bound, kind="stable").tolist():
                    if bound[c] < floor:
                        break
                    low, high = c * cluster, min(n, (c + 1) * cluster)
                    a, b = first[low], first[high]
                    score = row_sums(w[ids[a:b]] * part[a:b], first[low : high + 1] - a)
                    good = np.flatnonzero(score >= floor)
                    rows, scores = np.concatenate((rows, good + low)), np.concatenate((scores, score[good]))
                    if len(scores) >= top:
                        floor = max(floor, int(np.partition(scores, -top)[-top]))
                w[places] = 0
                order = np.lexsort((own["doc_id"][rows], own["no_id"][rows], -scores))[:top]
                out.append((np.full(len(order), item), own["doc_id"][rows[order]], own["no_id"][rows[order]], scores[order]))
            if out:
                item, doc_id, no_id, score = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64(), mask=no_id), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


_FOUND = "item long, doc_id long, score long"


def _best(found: DataFrame, top: int) -> DataFrame:
    own = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)


def _ranked(rows: DataFrame, queries: Queries, top: int, shard_docs: int, cluster: int, sample: int) -> DataFrame:
    spark = rows.sparkSession
    sc = spark.sparkContext
    size, given = len(queries.vocabulary), []

    def share(value):
        given.append(sc.broadcast(value))
        return given[-1]

    with Scratch(spark) as scratch:
        vectors = scratch.save(rows.mapInArrow(_encode(share(queries.vocabulary)), "doc_id long, n long, ids binary, tf binary"))
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
        df = np.zeros(size, dtype=np.int64)
        for place, n in vectors.select("ids").mapInArrow(_frequencies, "id int, df long").groupBy("id").agg(F.sum("df")).collect():
            df[place] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
        held = vectors.where("length(ids) > 0")
        levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, n_docs) / shard_docs))))
        lot = max(1, -(-n_docs // sample))
        drawn = held.where(F.pmod(F.xxhash64("doc_id", "n", "ids"), F.lit(lot)) == 0).select("ids").limit(2 * sample).toArrow() if levels else None
        lean = sampled_tree(*_joined(drawn.column("ids").combine_chunks(), np.int32), size, levels) if levels else np.zeros((1, size), np.float32)
        # a shard: a leaf's rows whose place in the saved table falls on the same number
        routed = scratch.save(held.withColumn("at", F.xxhash64(F.monotonically_increasing_id())).mapInArrow(_route(share(lean), levels), "doc_id long, n long, ids binary, tf binary, at long, leaf long"))
        leaves = routed.groupBy("leaf").agg(F.ceil(F.count("*") / shard_docs).cast("long").alias("cuts"))
        dealt = routed.join(F.broadcast(leaves), "leaf").withColumn("shard", F.expr("leaf * 1000000000 + pmod(at, cuts)"))
        index = scratch.save(
            dealt.select("shard", "doc_id", "n", "ids", "tf").groupBy("shard").applyInArrow(_build(size, n_docs, max(1, n_terms), cluster), "shard long, doc_id binary, no_id binary, first binary, ids binary, part binary, cluster_first binary, cluster_ids binary, cluster_part binary, shard_ids binary, shard_part binary")
        )
        bounds = index.select("shard", "shard_ids", "shard_part").mapInArrow(_bounds(share((queries.terms, weight)), SEEDS), "item long, shard long, bound long")
        highest = bounds.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))).where(F.col("r") <= SEEDS)
        seeds: dict[int, set[int]] = {}
        for item, shard in highest.select("item", "shard").collect():
            seeds.setdefault(shard, set()).add(item)
        nothing = [0] * len(queries.ids)
        first_round = scratch.save(index.where(F.col("shard").isin(list(seeds))).mapInArrow(_search(share((queries.terms, weight, seeds, nothing)), top, cluster, True), _FOUND))
        least = list(nothing)
        for item, score in _best(first_round, top).where(F.col("rank") == top).select("item", "score").collect():
            least[item] = score
        others = index.mapInArrow(_search(share((queries.terms, weight, seeds, least)), top, cluster, False), _FOUND)
        names = spark.createDataFrame([(k, None if i is None else int(i)) for k, i in enumerate(queries.ids)], "item long, item_id long")
        out = cut(_best(first_round.unionByName(others), top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    for b in given:
        b.destroy()
    return out


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP, shard_docs: int = SHARD, cluster: int = CLUSTER, sample: int = SAMPLE, most_items: int = ITEMS, most_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of a positive score for each item."""
    rows = bare(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for queries in query_blocks(bare(items, item_key, item_text).toDF("item_id", "text"), most_items, most_terms):
        found = _ranked(rows, queries, top, shard_docs, cluster, sample)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").alias(key), "score")


RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), n AS (
  SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), i AS (
  SELECT row_number() OVER () AS i, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), q AS (
  SELECT i, item_id, unnest(w) AS term FROM i
), t AS (
  SELECT r, unnest(w) AS term FROM d
), f AS (
  SELECT r, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY r, term
), g AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs
), x AS (
  SELECT i, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN g USING (term) JOIN f USING (term) JOIN n USING (r), s GROUP BY ALL
), o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
)
SELECT * FROM o WHERE rank <= 50
"""

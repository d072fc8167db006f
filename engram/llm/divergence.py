"""How the vocabulary of a source departs from the other sources and from the whole language (operator 11).

Terms are runs of letters (A-Z lower-cased).  A language keeps the terms of at least ``min_docs`` of its documents.
Within a language each source, and the language as a whole, gives every kept term a smoothed share in integer
parts of ``SCALE``; the divergence of two such distributions is the sum of floor((p - q)^2 / q), and the terms that
set a source apart are those with the largest parts against the language.

Integer-dictionary encoding, in Spark: one pass over the texts counts (language, source, term) in tasks (terms
are dictionary-encoded per slice of text), one shuffle with partial sums adds the counts up.  The counts are then
dealt by ranges of (language, term) and sorted, so every task holds whole terms of a stretch of the dictionary:
its kept terms, in order, are a chunk, a term's id is its place among the chunk's kept terms (``searchsorted`` on
their sorted places) and ``bincount`` per source makes the chunk's vectors.  Ids follow the byte order of UTF-8
within a chunk, and chunks follow each other in it, so equal values are ordered by (chunk, id) without looking at a
term again.  Chunks of at most about ``CHUNK`` count rows are compared source by source in blocks of ``BLOCK``
sources; sums over chunks are the divergences.  Nothing is broadcast or collected, and no task sees more than a
chunk of a block pair.

All arithmetic is exact: counts are 64-bit (``bincount`` adds up in doubles, exact below 2^53), shares are divided
in steps that stay below 2^63 for totals up to 9 * 10^15.

Defined results: null text, language and source count as ''; every row is a document, rows that repeat too; very long
texts are cut into no pieces and counted whole; a source without kept terms has count 0 for every term and is compared
like others; a language without kept terms has the value 0 for all pairs and no terms; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sparktools import Scratch, bare, cut
from .terms import LETTERS, split_terms
from .words import slices

SCALE = 1_000_000_000
MIN_DOCS, TOP = 3, 200
#: Bytes of text whose terms are counted at once.
SLICE = 8 << 20
#: Count rows of a stretch of the dictionary that are encoded at once; sources in a block.
CHUNK, BLOCK = 1 << 17, 64


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), by three steps of a thousand."""
    whole, rest = np.divmod(counts + 1, total + kept)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total + kept)
        whole = whole * 1000 + step
    return whole + 1


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of texts."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            terms, first = split_terms(part.column("text"), LETTERS)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            code, size = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
            lang, source = (pc.fill_null(part.column(c), "").dictionary_encode() for c in ("lang", "source"))
            group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
            text = np.repeat(np.arange(part.num_rows), np.diff(first))
            # a term's occurrences in a text, then in the texts of a group
            pair, tf = np.unique(text * size + code, return_counts=True)
            key, back = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
            n = np.bincount(back, weights=tf).astype(np.int64)
            own = key // size
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(own // len(source.dictionary))), source.dictionary.take(pa.array(own % len(source.dictionary))),
                    coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(n), pa.array(np.bincount(back)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


_ENCODED = pa.schema([
    ("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("whole", pa.bool_()), ("width", pa.int32()), ("total", pa.int64()),
    ("ids", pa.binary()), ("counts", pa.binary()), ("terms", pa.list_(pa.string())),
])


def _changes(column: pa.Array) -> np.ndarray:
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        out[1:] = np.asarray(pc.not_equal(column[1:], column[:-1]))
    return out


def _encode(min_docs: int, chunk_rows: int):
    """Chunks of count rows that come sorted by (lang, term): a row per source with its ids and counts, one for the language with the terms."""

    def chunk_of(table: pa.Table, chunk: int) -> Iterator[pa.RecordBatch]:
        lang = table.column("lang")[0].as_py()
        terms = table.column("term").combine_chunks()
        starts = np.flatnonzero(_changes(terms))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
        kept = np.flatnonzero(np.add.reduceat(np.asarray(table.column("docs")), starts) >= min_docs)
        if not len(kept):
            return
        ids = np.minimum(np.searchsorted(kept, run), len(kept) - 1)
        inside = kept[ids] == run
        ids, n = ids[inside], np.asarray(table.column("n"))[inside]
        source = table.column("source").combine_chunks().filter(pa.array(inside)).dictionary_encode()
        sid = np.asarray(source.indices).astype(np.int64)
        rows = []
        for s, name in enumerate(source.dictionary.to_pylist()):
            own = sid == s
            counts = np.bincount(ids[own], weights=n[own], minlength=len(kept)).astype(np.int64)
            held = np.flatnonzero(counts)
            rows.append((name, False, int(counts.sum()), held.astype(np.int32).tobytes(), counts[held].tobytes(), None))
        counts = np.bincount(ids, weights=n, minlength=len(kept)).astype(np.int64)
        rows.append((None, True, int(counts.sum()), np.arange(len(kept), dtype=np.int32).tobytes(), counts.tobytes(), terms.take(pa.array(starts[kept])).to_pylist()))
        for name, whole, total, held, values, words in rows:  # a batch a row: a chunk's vectors may be large
            yield pa.RecordBatch.from_pylist([{"lang": lang, "chunk": chunk, "source": name, "whole": whole, "width": len(kept), "total": total, "ids": held, "counts": values, "terms": words}], schema=_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, chunk
            table = pa.Table.from_batches(held).combine_chunks()
            lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
            ends = np.flatnonzero(_changes(lang) | _changes(term))
            upto = table.num_rows if last else int(ends[-1])  # the last term may go on in the next batch
            cuts = [0, *[int(c) for c in np.flatnonzero(_changes(lang)) if 0 < c < upto], upto]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield from chunk_of(table.slice(a, b - a), chunk)
                    chunk += 1
            held = table.slice(upto).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk_rows:
                yield from flush(False)
        if sum(b.num_rows for b in held):
            yield from flush(True)

    return run


_PARTS = "part string, lang string, source string, item string, value long, chunk long, ids array<int>, terms array<string>, values array<long>"
#: A chunk tells the value of a source's so many best terms; top / MARK such chunks bound what the ``top`` terms of all reach.
MARK = 8


def _compare(top: int):
    """The parts of one chunk: sums of pairs of sources, and a row of each source's leading terms against the language, whose value is the MARK-th best."""
    schema = pa.schema([
        ("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("chunk", pa.int64()),
        ("ids", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("values", pa.list_(pa.int64())),
    ])

    def run(table: pa.Table) -> pa.Table:
        rows = [r for r in table.to_pylist() if not r["whole"]]
        whole = [r for r in table.to_pylist() if r["whole"]]
        width, kept, chunk, lang = (table.column(c)[0].as_py() for c in ("width", "kept", "chunk", "lang"))
        counts = np.zeros((len(rows), width), dtype=np.int64)
        p = np.zeros((len(rows), width), dtype=np.int64)
        for i, r in enumerate(rows):
            if r["ids"] is not None:
                counts[i, np.frombuffer(r["ids"], np.int32)] = np.frombuffer(r["counts"], np.int64)
            p[i] = shares(counts[i], r["total"], kept)
        side = np.array([r["side"] for r in rows])
        two = bool(side.any())
        out = []
        for i, r in enumerate(rows):
            others = np.flatnonzero(side != side[i]) if two else np.flatnonzero(np.arange(len(rows)) != i)
            for j in others.tolist():
                gap = p[i] - p[j]
                out.append(("pair", lang, r["source"], rows[j]["source"], int((gap * gap // p[j]).sum()), None, None, None, None))
        if whole and not two:
            w = whole[0]
            q = shares(np.frombuffer(w["counts"], np.int64), w["total"], kept)
            for i, r in enumerate(rows):
                own = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                gap = p[i][own] - q[own]
                f = gap * gap // q[own]
                best = np.argsort(-f, kind="stable")[:top]  # ids ascend, so equal values keep the order of their terms
                if len(best):
                    mark = int(f[best[MARK - 1]]) if len(best) >= MARK else None
                    out.append(("term", lang, r["source"], None, mark, chunk, own[best].tolist(), [w["terms"][k] for k in own[best].tolist()], f[best].tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, chunk_rows: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair': against another source, 'term': a term against the language), item, value, rank."""
    spark = docs.sparkSession
    rows = bare(docs, lang, source, text).toDF("lang", "source", "text")
    named = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    with Scratch(spark) as scratch:
        counted = rows.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
        counted = scratch.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        stretches = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // (8 * chunk_rows)))
        encoded = scratch.save(
            counted.repartitionByRange(stretches, "lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(_encode(min_docs, chunk_rows), "lang string, chunk long, source string, whole boolean, width int, total long, ids binary, counts binary, terms array<string>")
        )
        chunks, vectors = encoded.where("whole"), encoded.where("NOT whole")
        languages = chunks.groupBy("lang").agg(F.sum("width").alias("kept"), F.sum("total").alias("lang_total"))
        totals = vectors.groupBy("lang", "source").agg(F.sum("total").alias("total"))
        place = Window.partitionBy("lang").orderBy("source")
        groups = scratch.save(
            named.distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
            .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.expr(f"CAST((row_number() OVER (PARTITION BY lang ORDER BY source) - 1) DIV {block} AS INT)").alias("block"))
        )
        blocks = groups.groupBy("lang").agg(F.max("block").alias("last"), F.max("kept").alias("kept"), F.max("lang_total").alias("lang_total"))
        # every source meets every chunk of its language, with or without terms there
        dense = (
            chunks.select("lang", "chunk", "width").join(groups.join(blocks.select("lang", "last"), "lang"), "lang")
            .join(vectors.select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
            .withColumn("other", F.explode(F.expr("sequence(0, last)")))
            .select("lang", "chunk", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.expr("CASE WHEN block > other THEN 1 ELSE 0 END").alias("side"), F.lit(False).alias("whole"), "width", "source", "total", "kept", "ids", "counts", F.lit(None).cast("array<string>").alias("terms"))
        )
        wholes = (
            chunks.select("lang", "chunk", "width", "counts", "terms").join(blocks, "lang").withColumn("low", F.explode(F.expr("sequence(0, last)")))
            .select("lang", "chunk", "low", F.col("low").alias("high"), F.lit(0).alias("side"), F.lit(True).alias("whole"), "width", F.lit(None).cast("string").alias("source"), F.col("lang_total").alias("total"), "kept", F.lit(None).cast("binary").alias("ids"), "counts", "terms")
        )
        parts = scratch.save(dense.unionByName(wholes).groupBy("lang", "chunk", "low", "high").applyInArrow(_compare(top), _PARTS))
        sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
        pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        own = Window.partitionBy("lang", "source")
        pairs = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item")))
        # as many chunks hold MARK terms of this value at least as make up the top
        leading = parts.where("part = 'term'")
        least = leading.where("value IS NOT NULL").withColumn("nth", F.row_number().over(own.orderBy(F.desc("value")))).where(F.col("nth") == -(-top // MARK)).select("lang", "source", F.col("value").alias("least"))
        leading = leading.join(least, ["lang", "source"], "left").withColumn("t", F.explode(F.expr("filter(arrays_zip(ids, terms, values), t -> t.values >= coalesce(least, 0))")))
        terms = leading.select("lang", "source", "part", F.col("t.terms").alias("item"), F.col("t.values").alias("value"), "chunk", F.col("t.ids").alias("id"))
        terms = terms.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "chunk", "id"))).where(F.col("rank") <= top)
        return cut(pairs.unionByName(terms.select("lang", "source", "part", "item", "value", "rank")))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), l AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) d
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS BIGINT) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p)::HUGEINT * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q)::HUGEINT * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
"""

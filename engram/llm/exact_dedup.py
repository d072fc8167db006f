"""Exact deduplication with two passes of a Bloom filter (operator 2); DataFrame functions only.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.  The first
pass hashes each text and counts filter positions; a position that was hit twice may belong to a
repeated text.  The second pass probes those positions: a row with a position that was hit once is
certainly alone and passes straight through, all others are shuffled on their hash and settled there.

The positions are counted in a table keyed by (bucket, bit), and the filter that is broadcast is a table of one bitmap a
bucket, of at most BROADCAST_BUCKETS * 4 KB.  Up to about 16 million rows it clears nearly every single text; with more rows it
is fuller, so more rows are shuffled than need be, in :func:`without_copies` with their texts.  The result is the same at every size.

Very long texts are hashed where they stand; an empty table gives an empty result.

Defined results: null counts as the empty text; of equal texts the row with the most code points
stays, then the smallest id, a null id after all others; rows that repeat both id and text are equal
in every respect, so one of them stays in :func:`without_copies` and all carry ``kept`` in
:func:`copies`; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparktools import bare, bit_is_set, buckets_for, cut, filter_positions

#: Deleted before texts are compared.  Fixed values of the operator's contract.
WHITE = " \t\n\x0b\x0c\r"


def normalised_sha(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def _possible_repeats(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Filter of the hashes (one long column ``h`` per row) whose positions were all hit twice."""
    buckets = buckets_for(rows)
    hits = hashes.select(F.explode(filter_positions(F.col("h"), buckets)).alias("p")).groupBy("p.bucket", "p.bit").count()
    return hits.where("count > 1").groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), buckets


def _probed(rows: DataFrame, hashes: DataFrame, count: int) -> DataFrame:
    """``rows`` (with a column ``__h``) and ``__again``: whether the hash may occur twice."""
    table, buckets = _possible_repeats(hashes, count)
    table = table.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    rows = rows.withColumn("__probe", filter_positions(F.col("__h"), buckets))
    hit = " AND ".join(bit_is_set("__bits", f"__probe[{i}].bit") for i in range(3))
    rows = rows.join(F.broadcast(table), F.col("__probe")[0]["bucket"] == F.col("__bucket"), "left")
    return rows.withColumn("__again", F.coalesce(F.expr(hit), F.lit(False))).drop("__probe", "__bucket", "__bits")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256."""
    rows = bare(docs, key, text).toDF("doc_id", "text")
    digests = cut(rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), normalised_sha(F.col("text")).alias("sha")))
    hashed = digests.withColumn("__h", F.xxhash64("sha"))
    probed = _probed(hashed, hashed.select(F.col("__h").alias("h")), digests.count())
    alone = probed.where("NOT __again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = probed.where("__again").select("doc_id", "size", "sha")
    groups = cut(again.groupBy("sha").agg(F.count("*").alias("group_size"), _best("doc_id", "size").alias("best")))
    groups = groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.expr("-best.less").alias("keep_size"))
    settled = again.join(groups, "sha").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id AND size = keep_size").alias("kept"), "sha")
    out = alone.unionByName(settled)
    return out.select(F.col("doc_id").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def _best(key: str, size: str) -> Column:
    """The row that stays: most code points, then smallest id, null last."""
    return F.min(F.struct((-F.col(size)).alias("less"), F.col(key).isNull().alias("no_id"), F.col(key).alias("doc_id")))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that stay; only possible repeats are shuffled."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("__row"), F.col(f"`{key}`").alias("__id"), F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("__size"), normalised_sha(F.col(f"`{text}`")).alias("__sha"))
    hashes = cut(packed.select(F.xxhash64("__sha").alias("h")))
    probed = _probed(packed.withColumn("__h", F.xxhash64("__sha")), hashes, hashes.count())
    alone = probed.where("NOT __again").select("__row.*")
    again = probed.where("__again")
    best = cut(again.groupBy("__sha").agg(_best("__id", "__size").alias("best")))
    winners = best.select("__sha", F.col("best.doc_id").alias("__keep"), F.expr("-best.less").alias("__keep_size"))
    kept = again.join(winners, "__sha").where("__id <=> __keep AND __size = __keep_size")
    first = Window.partitionBy("__sha").orderBy("__id")
    # identical rows: one of them
    kept = kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__row.*")
    return alone.unionByName(kept)


COPIES_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

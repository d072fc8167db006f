"""Small Spark helpers of this subpackage: shared storage, lineage cuts, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) an own folder is set; a cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc._jsc.sc().getCheckpointDir().isDefined() and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="engram-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets the driver give back what ended jobs left: their plans and broadcasts are garbage, which the JVM otherwise lets
    grow up to its largest heap, while little is in use."""
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared folder that live for one operator call.

    Use as a context manager; what is returned from the block must not read them lazily (end the block
    with :func:`cut`).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *exc: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def one_thread() -> None:
    """Lets numpy's linear algebra use one thread in this process: a Spark task has one core, and on products as small as
    ours further threads only wait for each other.  Where the library can't be told, nothing happens."""
    import ctypes
    import glob
    import os

    import numpy

    for path in glob.glob(os.path.join(os.path.dirname(numpy.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def tidy(run):
    """The task function, giving free memory back to the system when a task ends: a Python worker lives on for the next
    tasks, and what its allocators hold counts against the executor while native stages run beside it."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def bare(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, by exact name; columns that the caller added can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, label) of every vertex of ``edges`` (src, dst: long): label is the component's smallest id.

    Smallest-label propagation with pointer jumping.  A vertex of very many edges costs one partial
    aggregate per task; the joins read stored tables on both sides, so adaptive execution can
    split a hub's partition.  A round is one write: its rows carry their label of before, so that no
    join tells whether one moved.  The result lives as long as ``scratch``; without one it is a checkpoint.
    """
    spark = edges.sparkSession
    with Scratch(spark) as own:
        edges = own.save(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        labels = own.save(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("src"), F.min("dst")).alias("label")))
        moved = True
        while moved:
            # neighbours' labels, then the label of the label
            near = both.join(labels, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label", F.lit(None).cast("long").alias("was"))
            hooked = near.unionByName(labels.withColumn("was", F.col("label"))).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was"))
            target = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
            fresh = own.save(
                hooked.join(target, "label", "left")
                .select("id", F.least("label", F.coalesce("beyond", "label")).alias("label"), "was")
            )
            moved = not fresh.where("label <> was").isEmpty()
            labels = fresh.select("id", "label")
        return scratch.save(labels) if scratch is not None else cut(labels)


#: Bits in a bucket of a filter table (the length that bitmap_construct_agg makes) and ids dealt to it.
BUCKET_BITS, BUCKET_IDS = 32768, 2048
#: A filter never has more buckets than this (4 KB each).  With more members it is fuller and clears fewer rows; no result changes.
BROADCAST_BUCKETS = 8192


def buckets_for(members: int) -> int:
    return max(1, min(BROADCAST_BUCKETS, -(-members // BUCKET_IDS)))


def filter_table(hashes: DataFrame, column: str, expected: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of the long ``column`` as rows (__bucket, __bits), and its number of buckets."""
    buckets = buckets_for(expected)
    table = (
        hashes.select(F.explode(filter_positions(F.col(column), buckets)).alias("p"))
        .groupBy(F.col("p.bucket").alias("__bucket")).agg(F.expr("bitmap_construct_agg(p.bit)").alias("__bits"))
    )
    return table, buckets


def filter_positions(column, buckets: int, probes: int = 3):
    """Array of (bucket, bit): the probes of a value, all in one bucket."""
    bucket = F.pmod(F.xxhash64(column, F.lit(0)), F.lit(buckets)).alias("bucket")
    return F.array(*[F.struct(bucket, F.pmod(F.xxhash64(column, F.lit(i)), F.lit(BUCKET_BITS)).alias("bit")) for i in range(1, probes + 1)])


def bit_is_set(bits: str, bit: str) -> str:
    """SQL that tests one bit of a bitmap of bitmap_construct_agg (lowest bit of a byte first)."""
    return f"(conv(hex(substring({bits}, CAST({bit} DIV 8 AS INT) + 1, 1)), 16, 10) & shiftleft(1, CAST({bit} % 8 AS INT))) <> 0"


def _probed(df: DataFrame, column: str, members: DataFrame, expected: int) -> DataFrame:
    """Adds __maybe: whether ``column`` may be in ``members`` (false only if it certainly isn't)."""
    table, buckets = filter_table(members.toDF("member"), "member", expected)
    probes = df.withColumn("__probe", filter_positions(F.col(f"`{column}`"), buckets))
    joined = probes.join(F.broadcast(table), F.col("__probe")[0]["bucket"] == F.col("__bucket"), "left")
    hit = " AND ".join(bit_is_set("__bits", f"__probe[{i}].bit") for i in range(3))
    return joined.withColumn("__maybe", F.coalesce(F.expr(hit), F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns], "__maybe")


def possibly_in(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``members`` (one column; no row in it is lost).

    The filter that is broadcast takes at most BROADCAST_BUCKETS * 4 KB, however many members there are.
    """
    return _probed(df, column, members, members.count()).where("__maybe").drop("__maybe")


def drop_members(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` (long, not null) is not in ``members`` (one column).

    Rows that a filter of the same size bound as in :func:`possibly_in` clears pass straight through; only
    the others are shuffled to be looked up.
    """
    expected = members.count()
    if expected == 0:
        return df
    members = members.toDF("__member")
    probed = _probed(df, column, members, expected)
    clear = probed.where("NOT __maybe").drop("__maybe")
    looked_up = probed.where("__maybe").drop("__maybe").join(members, F.col(f"`{column}`") == F.col("__member"), "left_anti")
    return clear.unionByName(looked_up)

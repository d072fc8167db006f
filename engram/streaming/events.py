"""Streams over files of events, and folds of ordered state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.results import last_writes


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """Files of a folder as a stream with a true timestamp column."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares: spark.checkpoint.dir, or the warehouse where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns the result as a table.

    Every batch is written to a folder of its own number in the shared storage, so a batch that is repeated after a
    failure changes nothing; in complete mode the last batch is the result, else all of them.
    """
    spark = stream.sparkSession
    root = shared_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{root}/rows/batch={number}" if mode != "complete" else f"{root}/rows"
        batch.write.mode("overwrite").parquet(folder)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))


def by_session(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))


def fold_documents(rows: DataFrame, key: str, order: str) -> DataFrame:
    """ST1 in batch: every row with the document that holds after it, by key in order.

    Rows carry ``outcome`` (parsed, empty, unparsed, failed) and ``document``; parsed documents are taken
    over, all others keep the one before.  Only the last accepted document matters, so the fold is a
    window, not a loop.
    """
    return rows.withColumn(
        "holds", F.expr(f"last_value(CASE WHEN outcome = 'parsed' THEN document END) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY `{order}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    )


_STATE = T.StructType([T.StructField("document", T.StringType()), T.StructField("n", T.LongType())])
_FOLDED = T.StructType([T.StructField("reviewer", T.LongType()), T.StructField("holds", T.StringType()), T.StructField("n", T.LongType())])


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    document, n = state.get if state.exists else (None, 0)
    last = None
    for rows in parts:  # only the last accepted row of what came so far is held
        n += len(rows)
        accepted = rows[rows["outcome"] == "parsed"]
        if len(accepted):
            latest = accepted.loc[accepted["ix"].idxmax()]
            if last is None or latest["ix"] > last:
                last, document = latest["ix"], latest["document"]
    state.update((document, n))
    yield pd.DataFrame({"reviewer": [key[0]], "holds": [document], "n": [n]})


def fold_stream(rows: DataFrame) -> DataFrame:
    """ST1 as a stream: per reviewer the document that holds after each batch (columns reviewer, ix, outcome, document)."""
    return rows.groupBy("reviewer").applyInPandasWithState(_fold, _FOLDED, _STATE, "update", "NoTimeout")


def journal_upsert(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """ST3: a stream of results into a journal whose last write of each key counts.

    A batch writes only its own last writes, to a folder of its number; a batch that is repeated changes nothing.
    :func:`read_journal` merges, :func:`compact_journal` writes the merged rows as a new journal.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = last_writes(batch.withColumnRenamed(order, "__order").withColumn(order, F.col("__order")), keys, "__order").drop("position", "__order")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_journal(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """ST3: the last write of every key, later batches over earlier ones between equal orders."""
    rows = spark.read.parquet(path).withColumn("__at", F.struct(order, "batch"))
    return last_writes(rows, keys, "__at").drop("position", "batch", "__at")


def compact_journal(spark: SparkSession, path: str, keys: list[str], order: str, target: str) -> None:
    """ST3: the journal's merged rows as the first batch of a new one."""
    read_journal(spark, path, keys, order).write.parquet(f"{target}/batch=0")


def stale_tasks(tasks: DataFrame, now, threshold_seconds: int = 300) -> DataFrame:
    """ST4: running tasks without a heartbeat for longer than the threshold are interrupted."""
    old = now.cast("double") - F.col("heartbeat_at").cast("double") > threshold_seconds
    return tasks.withColumn("status", F.when((F.col("status") == "running") & old, "interrupted").otherwise(F.col("status")))

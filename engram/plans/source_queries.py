"""Queries over what the sinks write and the readers read again, in the storage that the cluster shares, and over streams with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DIMENSIONS
from ..sources import tables
from ..streaming import events as streams
from ..streaming import stateful
from . import views as V
from .queries import query

_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("task_type", T.StringType())])


def _events(spark, d):
    return V.table(spark, d, "events").select("event_id", "event_type", "user_id")


@query("SELECT event_id, event_type FROM events")
def q_jsonl_scan(spark, d):
    path = streams.shared_folder(spark, "jsonl")
    tables.write_jsonl(_events(spark, d), path)
    return tables.read_jsonl(spark, path, _EVENT).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, upper(event_type) FROM events WHERE event_id % 3 = 0")
def q_jsonl_append(spark, d):
    path = streams.shared_folder(spark, "journal")
    tables.append_jsonl(_events(spark, d), path)
    tables.append_jsonl(_events(spark, d).where("event_id % 3 = 0").withColumn("event_type", F.upper("event_type")), path)
    return tables.read_jsonl(spark, path, _EVENT).select("event_id", "event_type")


@query("SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'memory_md' ELSE 'user_md' END AS task_type FROM events")
def q_json_default_type(spark, d):
    path = streams.shared_folder(spark, "json")
    rows = _events(spark, d).withColumn("task_type", F.when(F.col("event_id") % 3 == 0, "memory_md"))
    # an array of objects a file
    files = rows.groupBy((F.col("user_id") % 20).alias("k")).agg(F.to_json(F.collect_list(F.struct("event_id", "event_type", "task_type"))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return tables.read_json(spark, path, _EVENT, "user_md").select("event_id", "event_type", "task_type")


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'corrupt' ELSE 'good' END AS kind, count(*) AS lines FROM events GROUP BY 1")
def q_corrupt_lines(spark, d):
    path = streams.shared_folder(spark, "lines")
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    _events(spark, d).select(line.alias("value")).write.text(path)
    good, corrupt = tables.split_corrupt(spark, path)
    return good.select(F.lit("good").alias("kind")).unionByName(corrupt.select(F.lit("corrupt").alias("kind"))).groupBy("kind").agg(F.count("*").alias("lines"))


_BAD = "ix % 13 = 0"


@query(f"""WITH {V.RES} SELECT case_id, CASE WHEN {_BAD} THEN NULL ELSE score_milli END AS score_milli, CASE WHEN ix % 5 = 0 THEN NULL ELSE correctness END AS correctness, array_to_string(list_sort(error_tags), ',') AS tags, CAST(CASE WHEN {_BAD} THEN 1 ELSE 0 END AS INT) AS problems, fatal FROM res""")
def q_result_table(spark, d):
    path = f"{streams.shared_folder(spark, 'results')}.csv"
    r = V.results(spark, d)
    score = F.when(F.expr(_BAD), "n/a").otherwise((F.col("score_milli") / 1000).cast("string"))
    tags = F.array_sort("error_tags")
    cell = F.when(F.col("ix") % 2 == 0, F.to_json(tags)).otherwise(F.array_join(tags, ", "))
    dims = [F.when((F.col("ix") % 5 != 0) | F.lit(x != "correctness"), (F.col("dims")[x] / 10).cast("string")).alias(f"score_{x}") for x in DIMENSIONS]
    r.select("case_id", score.alias("score_total"), *dims, cell.alias("error_tags"), F.col("fatal").alias("fatal_error")).write.csv(path, header=True, escape='"')
    found = tables.read_result_table(spark, path, DIMENSIONS)
    return found.select("case_id", "score_milli", F.try_element_at("dims", F.lit("correctness")).alias("correctness"), F.array_join(F.array_sort("error_tags"), ",").alias("tags"), F.size("problems").alias("problems"), "fatal")


@query("SELECT CASE WHEN user_id % 10 < 6 THEN 'discovery' WHEN user_id % 10 < 8 THEN 'validation' ELSE 'locked_test' END AS part, count(*) AS rows, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def q_split_manifest(spark, d):
    part = F.when(F.col("user_id") % 10 < 6, "discovery").when(F.col("user_id") % 10 < 8, "validation").otherwise("locked_test")
    said = tables.write_split(_events(spark, d).withColumn("part", part), streams.shared_folder(spark, "split"), order="event_id", about={"seed": "s"})
    return said.select("part", "rows", "first", "last")


def _in_files(spark, rows, order: str, files: int = 4):
    """A stream over the rows in so many files, one a micro-batch."""
    path = streams.shared_folder(spark, "files")
    rows.repartitionByRange(files, order).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("""WITH e AS (SELECT user_id AS reviewer, event_id AS ix, event_id // 400 AS segment, event_id % 4 = 0 AS accepted FROM events), s AS (SELECT reviewer, max(segment) AS segment, count(*) AS n FROM e GROUP BY 1)
SELECT s.reviewer, s.segment, s.n, 'doc ' || max(ix) FILTER (accepted) AS holds FROM s JOIN e ON e.reviewer = s.reviewer AND e.segment = s.segment GROUP BY ALL""")
def q_held_stream(spark, d):
    rows = V.event_rows(spark, d).withColumn("segment", F.expr("ix DIV 400")).select("reviewer", "segment", "ix", "outcome", "document")
    updates = streams.run_to_end(stateful.held_documents(_in_files(spark, rows, "ix")), "update")
    return updates.groupBy("reviewer").agg(F.max_by(F.struct("segment", "holds"), "n").alias("v"), F.max("n").alias("n")).select("reviewer", "v.segment", "n", "v.holds")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def q_journal_stream(spark, d):
    root = streams.shared_folder(spark, "upsert")
    stream = _in_files(spark, _events(spark, d), "event_type")
    streams.journal_upsert(stream, ["user_id"], "event_id", f"{root}/journal", f"{root}/checkpoint").awaitTermination()
    return streams.read_journal(spark, f"{root}/journal", ["user_id"], "event_id").select("user_id", "event_id", "event_type")

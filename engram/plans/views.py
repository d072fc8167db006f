"""The test tables seen as the data model, by whole-number arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import weighted_total
from ..schemas import DIMENSIONS, WEIGHTS

#: Multiplier and offset of each dimension's tenths.
_FORMULA = dict(zip(DIMENSIONS, ((7, 3), (11, 5), (13, 1), (17, 9), (19, 2), (23, 4)), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str, side: str = "") -> DataFrame:
    """orders as judged results; sides ``a`` and ``b`` lack some keys, and ``b`` differs a little."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    if side:
        o = o.where(k % (17 if side == "a" else 13) != 0)
    shift = k % 7 - 3 if side == "b" else F.lit(0)
    tenths = {d: F.greatest(F.lit(0), F.least(F.lit(50), (k * p + q) % 51 + shift)).cast("int") for d, (p, q) in _FORMULA.items()}
    tag = lambda name, test: F.when(test, F.lit(name))
    tags = [tag("hallucination", k % 10 == 1), tag("wrong_fact", k % 14 == 3), tag("over_memory", k % 6 == 2), tag("verbose_or_noisy", k % 9 == 4)]
    if side == "b":
        tags = [tag("hallucination", (k % 10 == 1) | (k % 10 == 2)), tag("wrong_fact", k % 14 == 5), tag("over_memory", k % 6 == 2), tag("missing_key_info", k % 8 == 1)]
    output = F.when(k % 5 == 0, F.concat(F.lit("same "), k.cast("string"))).otherwise(F.concat(F.lit(f"{side} "), k.cast("string")))
    dims = F.map_from_arrays(F.array(*[F.lit(d) for d in DIMENSIONS]), F.array(*tenths.values()))
    rows = o.select(
        k.alias("ix"), k.cast("string").alias("case_id"), F.col("o_orderpriority").alias("model_name"), F.col("o_orderstatus").alias("prompt_version"),
        (F.col("o_custkey") % 7).cast("string").alias("reviewer"), dims.alias("dims"), F.array_compact(F.array(*tags)).alias("error_tags"),
        (k % 4).cast("int").alias("n_diagnostics") if side != "b" else (k % 3).cast("int").alias("n_diagnostics"),
        (k % 37 == 0).alias("fatal"), F.when(k % 11 == 0, F.when(k % 2 == 0, "judge_api_failed").otherwise("judge_parse_failed")).otherwise("success").alias("evaluation_status"),
        F.lit(None).cast("boolean").alias("score_eligible"),
        F.when(k % 11 == 0, F.when(k % 2 == 0, "HTTP error: rate limit 429").otherwise("JSON decode error")).alias("failure_message"), output.alias("output"),
    )
    return rows.withColumn("score_milli", weighted_total(F.col("dims"), WEIGHTS))


def _sql(name: str, side: str) -> str:
    shift = " + o_orderkey % 7 - 3" if side == "b" else ""
    dims = ", ".join(f"greatest(0, least(50, (o_orderkey * {p} + {q}) % 51{shift})) AS {d}" for d, (p, q) in _FORMULA.items())
    total = " + ".join(f"{w} * {d}" for d, w in WEIGHTS.items())
    tags = "[CASE WHEN ix % 10 = 1 THEN 'hallucination' END, CASE WHEN ix % 14 = 3 THEN 'wrong_fact' END, CASE WHEN ix % 6 = 2 THEN 'over_memory' END, CASE WHEN ix % 9 = 4 THEN 'verbose_or_noisy' END]"
    if side == "b":
        tags = "[CASE WHEN ix % 10 IN (1, 2) THEN 'hallucination' END, CASE WHEN ix % 14 = 5 THEN 'wrong_fact' END, CASE WHEN ix % 6 = 2 THEN 'over_memory' END, CASE WHEN ix % 8 = 1 THEN 'missing_key_info' END]"
    where = {"": "", "a": "WHERE o_orderkey % 17 <> 0", "b": "WHERE o_orderkey % 13 <> 0"}[side]
    return f"""{name} AS (
  SELECT *, CAST({total} AS BIGINT) AS score_milli, list_filter({tags}, lambda x: x IS NOT NULL) AS error_tags,
         CASE WHEN ix % 5 = 0 THEN 'same ' ELSE '{side} ' END || case_id AS output
  FROM (SELECT o_orderkey AS ix, CAST(o_orderkey AS VARCHAR) AS case_id, o_orderpriority AS model_name, o_orderstatus AS prompt_version,
               CAST(o_custkey % 7 AS VARCHAR) AS reviewer, {dims}, o_orderkey % {3 if side == "b" else 4} AS n_diagnostics,
               o_orderkey % 37 = 0 AS fatal, o_orderkey % 11 <> 0 AS ok,
               CASE WHEN o_orderkey % 11 <> 0 THEN 'success' WHEN o_orderkey % 2 = 0 THEN 'judge_api_failed' ELSE 'judge_parse_failed' END AS status
        FROM orders {where})
)"""


RES, RES_A, RES_B = _sql("res", ""), _sql("res_a", "a"), _sql("res_b", "b")


def dialogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as dialogue rows: a user turn with the assistant turn after it; files of 50 conversations."""
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(by), "next_text": F.lead("text").over(by)}).where("role = 'user'")
    n = F.row_number().over(by)
    doc = F.when(F.col("row_ix") % 5 == 0, "").otherwise(F.concat(F.lit("- memory "), F.col("row_ix").cast("string")))
    return c.select(
        F.floor(F.col("conv_id") / 50).cast("long").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_ix"), n.cast("string").alias("turn_no"),
        F.col("text").alias("query"), F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("answer"), (F.col("conv_id") % 5).cast("string").alias("reviewer"),
    ).withColumns({
        "document": doc, "raw_output": F.lit(""), "reasoning": F.lit(""), "status": F.when(F.col("row_ix") % 7 == 0, "api_failed").when(F.col("row_ix") % 3 == 0, "success").otherwise(""),
        "call_status": F.lit(""), "parse_status": F.lit(""), "case_status": F.lit(""),
    })


ROWS = """rows_ AS (
  SELECT *, CASE WHEN row_ix % 5 = 0 THEN '' ELSE '- memory ' || CAST(row_ix AS VARCHAR) END AS document,
         CASE WHEN row_ix % 7 = 0 THEN 'api_failed' WHEN row_ix % 3 = 0 THEN 'success' ELSE '' END AS status
  FROM (SELECT CAST(floor(conv_id / 50) AS BIGINT) AS file, conv_id * 1000 + turn AS row_ix, CAST(row_number() OVER w AS INT) AS turn_no, text AS query,
               CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS answer, CAST(conv_id % 5 AS VARCHAR) AS reviewer
        FROM (SELECT *, lead(role) OVER v AS next_role, lead(text) OVER v AS next_text FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
), sess AS (
  SELECT *, sum(CASE WHEN turn_no = 1 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY row_ix) AS session_ix
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_ix) AS rn FROM rows_)
), chunked AS (
  SELECT *, (row_number() OVER (PARTITION BY file, session_ix ORDER BY row_ix) - 1) // 2 AS chunk_in_session FROM sess
), turns_ AS (
  SELECT file, session_ix, chunk_in_session, row_ix, reviewer, document, status,
         (CASE WHEN trim(coalesce(query, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(answer, '')) <> '' THEN 1 ELSE 0 END) AS n_turns,
         concat_ws(chr(10), CASE WHEN trim(coalesce(query, '')) <> '' THEN '- user: ' || trim(query) END, CASE WHEN trim(coalesce(answer, '')) <> '' THEN '- assistant: ' || trim(answer) END) AS said
  FROM chunked
), chunk_ AS (
  SELECT file, session_ix, chunk_in_session, min(row_ix) AS row_start, max(row_ix) AS row_end, count(*) AS rows, sum(n_turns) AS n_turns,
         string_agg(said, chr(10) ORDER BY row_ix) FILTER (WHERE said <> '') AS dialogue,
         arg_max(reviewer, row_ix) AS reviewer, arg_max(document, row_ix) AS document, arg_max(status, row_ix) AS status
  FROM turns_ GROUP BY ALL
), state_ AS (
  SELECT *, CASE WHEN status = 'success' THEN 'ready' WHEN status = 'api_failed' THEN 'skip' WHEN document <> '' THEN 'ready' ELSE 'skip' END AS case_state
  FROM chunk_
)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows of reviewers (users) with an outcome."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 4
    return e.select(
        F.col("user_id").alias("reviewer"), F.col("event_id").alias("ix"), "event_type",
        F.when(m == 0, "parsed").when(m == 1, "empty").when(m == 2, "unparsed").otherwise("failed").alias("outcome"), F.concat(F.lit("doc "), F.col("event_id").cast("string")).alias("document"),
    )


def failure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a failure message each."""
    messages = ("API error: QPS limit", "Connection idle timeout", "request timed out", "connection reset by peer", "JSON decode failed", "empty body", "missing required key", "status code 418", "boom", "schema validation: x")
    pick = F.element_at(F.array(*[F.lit(m) for m in messages]), (F.col("event_id") % len(messages) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pick.alias("message"))

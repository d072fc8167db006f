"""Schemas and constants of the data model.

Scores are kept as whole thousandths (``score_milli``, 0 .. 5000) and dimension scores as whole tenths
(``dims``: map of name to 0 .. 50), so that sums are exact whatever the order of rows.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
DIMENSIONS = ("correctness", "coverage", "update_logic", "memory_boundary", "conciseness", "format")
WEIGHTS = {"correctness": 30, "coverage": 20, "update_logic": 20, "memory_boundary": 15, "conciseness": 10, "format": 5}
CRITICAL_TAGS = ("privacy_sensitive", "hallucination", "wrong_fact")
INELIGIBLE = ("judge_api_failed", "judge_parse_failed", "judge_runtime_failed", "stopped")
SUCCESS, RUNTIME_FAILED = "success", "judge_runtime_failed"

RESULT = T.StructType(
    [
        T.StructField("ix", T.LongType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("reviewer", T.StringType()),
        T.StructField("score_milli", T.LongType()),
        T.StructField("dims", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("error_tags", T.ArrayType(T.StringType())),
        T.StructField("n_diagnostics", T.IntegerType()),
        T.StructField("fatal", T.BooleanType()),
        T.StructField("evaluation_status", T.StringType()),
        T.StructField("score_eligible", T.BooleanType()),
        T.StructField("failure_message", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)

TURN_ROW = T.StructType(
    [
        T.StructField("row_ix", T.LongType()),
        T.StructField("turn_no", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("reviewer", T.StringType()),
        T.StructField("session_id", T.StringType()),
    ]
)

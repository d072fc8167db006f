"""From dialogue rows to sessions, chunks, inherited documents and evaluation cases.

Rows come from files; within a file ``row_ix`` is the order of everything.  All windows are partitioned by
the ``file`` column, so a table of many files is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null


def _start(turn: str) -> Column:
    return F.coalesce(F.expr(f"CAST(try_cast({turn} AS DOUBLE) AS INT)") == 1, F.lit(False))


def sessions(rows: DataFrame, file: str = "file", turn: str = "turn_no") -> DataFrame:
    """Adds session_ix; a session starts at the first row and wherever the turn number is 1."""
    order = Window.partitionBy(file).orderBy("row_ix")
    start = (F.row_number().over(order) == 1) | _start(turn)
    return rows.withColumn("session_ix", F.sum(start.cast("int")).over(order))


def chunks(rows: DataFrame, size: int, file: str = "file") -> DataFrame:
    """Adds chunk_in_session (0, 1, ...) of ``size`` rows each, the last one shorter."""
    order = Window.partitionBy(file, "session_ix").orderBy("row_ix")
    return rows.withColumn("chunk_in_session", ((F.row_number().over(order) - 1) / size).cast("int"))


def chunk_count(rows: DataFrame, size: int, file: str = "file") -> DataFrame:
    """Chunks of each file."""
    per = rows.groupBy(file, "session_ix").agg(F.count("*").alias("n"))
    return per.groupBy(file).agg(F.sum(F.ceil(F.col("n") / size)).cast("long").alias("chunks"), F.count("*").alias("sessions"))


def assemble(rows: DataFrame, file: str = "file", boundary: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: the dialogue in order, its reviewer, and the boundary (last) row's columns."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    own = F.filter(said, lambda t: F.coalesce(F.trim(t["content"]), F.lit("")) != "")
    reviewer = blank_to_null(F.col("reviewer"))
    chunk = rows.groupBy(file, "session_ix", "chunk_in_session").agg(
        F.min("row_ix").alias("row_start"), F.max("row_ix").alias("row_end"), F.count("*").alias("rows"),
        F.array_sort(F.collect_list(F.struct("row_ix", own.alias("turns")))).alias("__turns"),
        F.coalesce(F.max_by(reviewer, "row_ix"), F.min_by(reviewer, F.when(reviewer.isNotNull(), F.col("row_ix")))).alias("reviewer"),
        *[F.max_by(c, "row_ix").alias(c) for c in boundary],
    )
    turns = F.flatten(F.transform("__turns", lambda t: t["turns"]))
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("- "), t["role"], F.lit(": "), F.trim(t["content"]))), "\n")
    return chunk.withColumn("n_turns", F.size(turns)).withColumn("dialogue", text).drop("__turns")


def inherit_by_reviewer(chunk_rows: DataFrame, accepted: str, document: str, file: str = "file") -> DataFrame:
    """Adds old_document: that of the reviewer's latest earlier accepted chunk; an empty one overwrites."""
    before = Window.partitionBy(file, "reviewer").orderBy("row_start").rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col(accepted), F.coalesce(F.col(document), F.lit("")))
    return chunk_rows.withColumn("old_document", F.nullif(F.last(value, ignorenulls=True).over(before), F.lit("")))


def reviewer_runs(rows: DataFrame, reviewer: str = "reviewer", file: str = "file", order: str = "row_start") -> DataFrame:
    """Adds segment, which grows wherever the reviewer differs from the row before."""
    by = Window.partitionBy(file).orderBy(order)
    changed = (F.row_number().over(by) == 1) | ~F.col(reviewer).eqNullSafe(F.lag(reviewer).over(by))
    return rows.withColumn("segment", F.sum(changed.cast("int")).over(by))


def inherit_with_reset(chunk_rows: DataFrame, accepted: str, document: str, file: str = "file") -> DataFrame:
    """Like W6 inside a run of one reviewer; a change of reviewer starts anew, empty documents don't overwrite."""
    rows = reviewer_runs(chunk_rows, file=file)
    before = Window.partitionBy(file, "segment").orderBy("row_start").rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col(accepted) & (F.coalesce(document, F.lit("")) != ""), F.col(document))
    return rows.withColumn("old_document", F.last(value, ignorenulls=True).over(before))


# Fixed values of the three states of an extraction.
CALLS = ("success", "failed", "stopped", "skipped", "not_attempted")
PARSES = ("structured", "raw_fallback", "empty", "unknown", "not_attempted")
CASES = ("ready", "review_required", "skip")


def extraction_state() -> Column:
    """struct (call, parse, case) from call_status, parse_status, case_status if all three are known
    values, else from the older ``status`` column and from what the row holds (document, raw_output, reasoning)."""
    def norm(c: str) -> Column:
        return F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), "[- ]", "_")

    def state(call: str, parse: str | Column, case: str | Column) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(call).alias("call"), lit(parse).alias("parse"), lit(case).alias("case"))

    def has(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""

    old = norm("status")
    anything = has("document") | has("raw_output")
    unstructured = F.when(anything, "review_required").otherwise("skip")
    explicit = norm("call_status").isin(*CALLS) & norm("parse_status").isin(*PARSES) & norm("case_status").isin(*CASES)
    return (
        F.when(explicit, F.struct(norm("call_status").alias("call"), norm("parse_status").alias("parse"), norm("case_status").alias("case")))
        .when(old.rlike("^(success_unstructured|parse_failed|parse_uncertain)"), state("success", F.when(anything, "raw_fallback").otherwise("empty"), unstructured))
        .when(old.rlike("^(success|succeeded|completed)|^ok$|成功"), state("success", "structured", "ready"))
        .when(old == "output_empty", state("success", "empty", "skip"))
        .when(old.isin("stopped", "cancelled", "canceled") | old.rlike("已终止|已取消"), state("stopped", "not_attempted", "skip"))
        .when(old.rlike("^skipped|跳过"), state("skipped", "not_attempted", "skip"))
        .when(old == "unknown", state("not_attempted", "not_attempted", "skip"))
        .when(old.rlike("api_failed|failure|error|timeout|failed|失败|错误|超时"), state("failed", "not_attempted", "skip"))
        .when(has("document"), state("success", "unknown", "ready"))
        .when(has("raw_output") | has("reasoning"), state("success", "unknown", "review_required"))
        .otherwise(state("not_attempted", "not_attempted", "skip"))
    )


def skip_reason() -> Column:
    """For chunks that give no case."""
    old = F.coalesce(F.trim(F.col("status")), F.lit(""))
    return (
        F.when(old != "", F.concat(F.lit("upstream_status_"), F.regexp_replace(old, r"[^\p{L}\p{N}]", "_")))
        .when(~F.col("state.call").isin("not_attempted", "success"), F.concat(F.lit("call_"), F.col("state.call")))
        .otherwise("chunk_last_row_has_no_document")
    )


def generate_cases(rows: DataFrame, size: int, memory: str = "by_reviewer", file: str = "file") -> DataFrame:
    """Every chunk with its state, inherited document and kind: case, missed (no case though tried) or skipped.

    ``memory`` is by_reviewer (W6) or sequential (W7).
    """
    boundary = ("document", "raw_output", "reasoning", "status", "call_status", "parse_status", "case_status")
    out = assemble(chunks(sessions(rows, file), size, file), file, boundary).withColumn("state", extraction_state())
    accepted = F.col("state.case").isin("ready") & (F.col("state.parse") != "raw_fallback")
    inherit = inherit_by_reviewer if memory == "by_reviewer" else inherit_with_reset
    out = inherit(out.withColumn("__ok", accepted), "__ok", "document", file).drop("__ok")
    kind = F.when(F.col("n_turns") == 0, "skipped").when(F.col("state.case") == "skip", "missed").otherwise("case")
    return out.withColumn("kind", kind).withColumn("skip_reason", F.when(kind != "case", skip_reason()))

"""Judged results: counts, means, histograms, quality of a run, last writes and resumption.

Frames have the columns of schemas.RESULT that an operator names.  Failed judge calls never count as zero
scores; they leave the denominators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import effective_status, eligible, list_cell


def _stats() -> list[Column]:
    ok = eligible()
    scored = F.count(F.when(ok, 1))
    return [
        F.count("*").alias("total"),
        scored.alias("scored"),
        (F.count("*") - scored).alias("judge_failures"),
        F.coalesce(F.sum(F.when(ok, F.col("score_milli"))) / scored / 1000, F.lit(0.0)).alias("avg_score"),
        F.count(F.when(ok & F.col("fatal"), 1)).alias("fatal_count"),
        F.coalesce(F.count(F.when(ok & F.col("fatal"), 1)) / F.when(scored > 0, scored), F.lit(0.0)).alias("fatal_rate"),
        F.coalesce(scored / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)).alias("score_coverage"),
        ((F.count("*") > 0) & (scored == F.count("*"))).alias("run_complete"),
    ]


def result_stats(results: DataFrame) -> DataFrame:
    """A1: one row."""
    return results.agg(*_stats())


def stats_by(results: DataFrame, field: str) -> DataFrame:
    """A1 for each value of a field."""
    return results.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("")).alias("group")).agg(*_stats())


def dimension_means(results: DataFrame) -> DataFrame:
    """A2: over the eligible rows that have the dimension; in score units."""
    rows = results.where(eligible()).select(F.explode("dims").alias("dimension", "tenths"))
    return rows.groupBy("dimension").agg((F.sum("tenths") / F.count("*") / 10).alias("mean"), F.count("*").alias("rows"))


def dimension_means_zero_filled(results: DataFrame) -> DataFrame:
    """A3: missing dimensions count as 0, over all eligible rows."""
    ok = results.where(eligible())
    rows = ok.select(F.explode("dims").alias("dimension", "tenths")).groupBy("dimension").agg(F.sum("tenths").alias("sum"))
    scored = ok.count()
    return rows.select("dimension", (F.col("sum") / F.lit(max(scored, 1)) / 10).alias("mean"))


def tag_histogram(results: DataFrame) -> DataFrame:
    """A4: every occurrence counts; position is the rank by count, then first appearance."""
    tags = results.where(eligible()).select("ix", F.explode("error_tags").alias("tag"))
    counted = tags.groupBy("tag").agg(F.count("*").alias("n"), F.min("ix").alias("first_ix"))
    return counted.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "first_ix", "tag")))


def status_histogram(results: DataFrame) -> DataFrame:
    """A5: all rows."""
    return results.groupBy(effective_status().alias("status")).agg(F.count("*").alias("n"))


def side_summary(results: DataFrame) -> DataFrame:
    """Totals of one side of a comparison of judges."""
    ok = eligible()
    return results.agg(
        F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("scored"),
        F.coalesce(F.sum(F.when(ok, F.col("score_milli"))) / F.count(F.when(ok, 1)) / 1000, F.lit(0.0)).alias("avg_score"),
        F.count(F.when(ok & F.col("fatal"), 1)).alias("fatal"), F.count(F.when(ok & (F.size("error_tags") > 0), 1)).alias("tagged"),
        F.coalesce(F.sum(F.when(ok, F.col("n_diagnostics"))), F.lit(0)).alias("diagnostics"),
    )


def matching(results: DataFrame, mode: str, low_milli: int = 4000) -> DataFrame:
    """P5: rows of one of the modes fatal, failed, low, tagged, diagnosed, all."""
    ok = eligible()
    modes = {
        "fatal": ok & F.col("fatal"), "failed": ~ok, "low": ok & (F.col("score_milli") < low_milli),
        "tagged": F.size("error_tags") > 0, "diagnosed": F.col("n_diagnostics") > 0, "all": F.lit(True),
    }
    return results.where(F.coalesce(modes[mode], F.lit(False)))


def missed_kind(call: Column | None = None, parse: Column | None = None) -> Column:
    """Why a chunk gave no case, from call_status and parse_status."""
    call, parse = (F.lower(F.trim(F.coalesce(F.col(n) if c is None else c, F.lit("")))) for c, n in ((call, "call_status"), (parse, "parse_status")))
    return (
        F.when(call.isin("failed", "stopped"), "infrastructure")
        .when((call == "success") & parse.isin("empty", "unknown", "not_attempted", ""), "quality")
        .otherwise("unknown")
    )


def run_quality(results: DataFrame, missed: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """Extraction misses for reasons of quality weigh as zero scores, failures to run don't."""
    ok = eligible()
    r = results.agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("scored"), F.coalesce(F.sum(F.when(ok, F.col("score_milli"))), F.lit(0)).alias("milli"))
    kind = missed_kind()
    m = missed.agg(*[F.count(F.when(kind == k, 1)).alias(k) for k in ("quality", "infrastructure", "unknown")])
    c = (ready if ready is not None else results.limit(0)).agg(F.count("*").alias("cases"))
    one = r.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one").join(c.withColumn("one", F.lit(1)), "one")  # one row each
    one = one.withColumn("ready", F.when(F.col("cases") > 0, F.col("cases")).otherwise(F.col("total")))
    known = F.col("ready") + F.col("quality")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    open_ends = F.col("total") - F.col("scored") + F.col("infrastructure")
    complete = (open_ends == 0) & (F.col("unknown") == 0)
    return one.select(
        "total", "scored", (F.col("total") - F.col("scored")).alias("judge_failures"),
        ratio(F.col("milli") / 1000, F.col("scored")).alias("conditional_avg_score"), F.col("ready").alias("ready_cases"),
        F.col("quality").alias("quality_failures"), F.col("infrastructure").alias("infrastructure_failures"), F.col("unknown").alias("unknown_chunks"),
        ratio(F.col("ready"), known).alias("extraction_coverage"), ratio(known, known + F.col("infrastructure")).alias("infrastructure_success_rate"),
        ratio(F.col("milli") / 1000, F.col("scored") + F.col("quality")).alias("end_to_end_score"), (F.col("scored") + F.col("quality")).alias("end_to_end_denominator"),
        complete.alias("run_complete"), (complete & (F.col("scored") + F.col("quality") > 0)).alias("replacement_eligible"),
    )


def last_writes(rows: DataFrame, keys: list[str], order: str = "ix") -> DataFrame:
    """Of each key the values of its last row, and the position of its first.

    A partial aggregate, so a key with very many writes is settled before the shuffle.
    """
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"), F.min(order).alias("position"))
    return last.select(*keys, "v.*", "position")


def open_cases(cases: DataFrame, done: DataFrame, keys: list[str], strategy: str = "skip_all") -> DataFrame:
    """Cases that are still to run: skip_all, skip_success or rerun_all."""
    if strategy == "rerun_all":
        return cases
    seen = done if strategy == "skip_all" else done.where(eligible())
    return cases.join(seen.select(*keys).distinct(), keys, "left_anti")


def flat_export(results: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """One flat row per result; scores as text with two digits, ineligible rows without."""
    ok = eligible()
    hundredths = F.expr("(score_milli + 5) DIV 10")
    shown = F.when(ok, F.concat(F.expr("CAST((score_milli + 5) DIV 1000 AS STRING)"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))).otherwise("未评分")
    return results.select(
        "case_id", "model_name", "prompt_version", shown.alias("score_display"), effective_status().alias("status"), "fatal",
        list_cell(F.coalesce("error_tags", F.array())).alias("tags"),
        *[F.element_at("dims", F.lit(d)).alias(f"score_{d}") for d in dimensions],
    )

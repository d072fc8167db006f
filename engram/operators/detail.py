"""Comparison of two extraction runs in detail: four inputs, verdicts without a judge, rows and chunks side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_id, eligible, output_text
from .cases import first_filled
from .results import last_writes, missed_kind, run_quality

ROLES = ("case_a", "missed_a", "case_b", "missed_b")


def pair_four(inputs: dict[str, DataFrame], key: str = "source_key", order: str = "ix") -> DataFrame:
    """One row per source key with a struct per role of ROLES, and ``duplicate``: the key stands twice in an input.

    The inputs have the same columns; one aggregate pairs all four, so a repeated key never multiplies rows.
    """
    columns = [c for c in inputs[ROLES[0]].columns if c != key]
    union = None
    for role in ROLES:
        rows = inputs[role].select(key, F.lit(role).alias("__role"), F.struct(*columns).alias("__row"))
        union = rows if union is None else union.unionByName(rows)
    is_role = {r: F.col("__role") == r for r in ROLES}
    paired = union.groupBy(key).agg(
        *[F.min_by("__row", F.when(t, F.col(f"__row.{order}"))).alias(r) for r, t in is_role.items()], *[F.count(F.when(t, 1)).alias(f"__n_{r}") for r, t in is_role.items()]
    )
    return paired.withColumn("duplicate", F.greatest(*[F.col(f"__n_{r}") for r in ROLES]) > 1).drop(*[f"__n_{r}" for r in ROLES])


def _missed(side: str) -> Column:
    """Why a side has no case: ready, missing, quality, infrastructure or unknown."""
    row = F.col(f"missed_{side}")
    kind = missed_kind(row["call_status"], row["parse_status"])
    return F.when(F.col(f"case_{side}").isNotNull(), "ready").when(row.isNull(), "missing").otherwise(kind)


def pair_verdict() -> Column:
    """struct (winner, kind) of a pair that needs no judge; null where one is needed."""
    a, b = F.col("case_a"), F.col("case_b")
    text = lambda row, c: output_text(row[c])
    said = lambda winner, kind: F.struct(F.lit(winner).alias("winner"), F.lit(kind).alias("kind"))
    kind_a, kind_b = _missed("a"), _missed("b")
    both = a.isNotNull() & b.isNotNull()
    unchanged = (text(a, "output") == text(a, "old_memory")) & (text(b, "output") == text(b, "old_memory"))
    return (
        F.when(both & (text(a, "output") == text(b, "output")), said("TIE", "identical_output"))
        .when(both & unchanged, said("HISTORICAL_DIFFERENCE", "historical_baseline_difference"))
        .when(both, F.lit(None))
        .when((kind_a == "infrastructure") | (kind_b == "infrastructure"), said("INSUFFICIENT", "runtime_failure"))
        .when(((kind_a == "ready") & (kind_b == "quality")) | ((kind_b == "ready") & (kind_a == "quality")), F.lit(None))
        .when((kind_a == "quality") & (kind_b == "quality"), said("TIE", "both_missed"))
        .otherwise(said("INSUFFICIENT", "source_mismatch"))
    )


def history_relation() -> Column:
    """M9: whether both sides began from the same old document."""
    a, b = output_text(F.col("case_a.old_memory")), output_text(F.col("case_b.old_memory"))
    return F.when((a == "") & (b == ""), "both_empty").when(a == b, "same").otherwise("different")


def recommendation() -> Column:
    """F19, of a row of gate counts and rates: which run to take."""
    return (
        F.when(F.col("duplicates") > 0, "undecided: duplicate keys").when(F.col("accepted"), "take B").when(~F.col("complete_a") | ~F.col("complete_b"), "undecided: runs incomplete")
        .when(F.col("mean_delta") < -F.greatest(F.lit(0.0), F.col("tolerance")), "keep A: scores fell").when(F.col("coverage_drop") > 0, "keep A: coverage fell").otherwise("keep A: no proof")
    )


def preference_recommendation(min_delta: float = 0.0, min_bound: float = 0.0) -> Column:
    """F19, of a row of pairwise preferences: effect first, the prompts' quality only between equals."""
    gain, bound = max(1e-9, min_delta), max(0.0, min_bound)
    open_ends = (F.col("failures") > 0) | F.col("lower").isNull() | (F.col("decided") == 0)
    return (
        F.when(open_ends, "undecided").when((F.col("preference") >= gain) & (F.col("lower") > bound), "take B").when((F.col("preference") <= -gain) & (F.col("upper") < -bound), "take A")
        .when(F.col("prompt_delta") >= 0.5, "take B").when(F.col("prompt_delta") <= -0.5, "take A").otherwise("undecided")
    )


#: M5: columns that a comparison row lends to the rows of its chunk.
COMPARED = ("verdict", "delta_milli", "score_a", "score_b", "reason")


def chunk_key() -> list[Column]:
    """Reviewer, session and chunk of a comparison row; a blank chunk is one more than its index."""
    chunk, index = canonical_id(F.col("chunk_id")), canonical_id(F.col("chunk_index"))
    next_index = F.when(index.rlike(r"^-*\d+$"), (F.expr("0") + index.cast("long") + 1).cast("string")).otherwise(index)
    return [F.trim(F.coalesce(F.col("reviewer"), F.lit(""))).alias("reviewer"), canonical_id(F.col("session_id")).alias("session_id"), F.when(chunk == "", next_index).otherwise(chunk).alias("chunk_id")]


KEYS = ["reviewer", "session_id", "chunk_id"]


def with_comparison(chunks: DataFrame, comparison: DataFrame, order: str = "ix") -> DataFrame:
    """Chunks with the fields of their last comparison row, blank where there is none."""
    rows = comparison.select(*chunk_key(), order, *COMPARED)
    last = last_writes(rows, KEYS, order).drop("position")
    joined = chunks.join(last, KEYS, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COMPARED})


def side_by_side(a: DataFrame, b: DataFrame, order: str = "ix", outputs: tuple[str, ...] = ("document", "raw_output")) -> tuple[DataFrame, DataFrame]:
    """M4: the rows of two runs paired by place inside a chunk, and the chunks with texts joined by blank lines.

    A chunk is consistent if both sides have as many rows and all pairs the same query and answer; outputs stand on the
    chunk's last row only.
    """
    sides = None
    for side, df in (("a", a), ("b", b)):
        rows = df.select(*KEYS, F.lit(side).alias("side"), F.col(order).alias("at"), "query", "answer", first_filled(*outputs).alias("output"))
        sides = rows if sides is None else sides.unionByName(rows)
    # all that follows is by chunk, so rows are shuffled once; a side's place in its chunk pairs it with the other's
    chunk, in_a = Window.partitionBy(*KEYS), F.col("side") == "a"
    nth = F.row_number().over(chunk.orderBy("side", "at"))
    sides = sides.withColumns({"nth": nth, "of_a": F.count(F.when(in_a, 1)).over(chunk)}).withColumn("n", F.when(in_a, F.col("nth")).otherwise(F.col("nth") - F.col("of_a")).cast("int"))
    row = F.struct("query", "answer", "at", "output")
    paired = sides.groupBy(*KEYS, "n").agg(F.first(F.when(in_a, row), True).alias("a"), F.first(F.when(~in_a, row), True).alias("b"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    either = lambda c: F.coalesce(F.nullif(text(f"a.{c}"), F.lit("")), text(f"b.{c}"))
    same = F.coalesce((text("a.query") == text("b.query")) & (text("a.answer") == text("b.answer")) & F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(False))
    paired = paired.select(*KEYS, "n", either("query").alias("query"), either("answer").alias("answer"), same.alias("same"), *[F.struct(F.col(f"{s}.at"), F.col(f"{s}.output")).alias(s) for s in "ab"])
    last = {f"output_{s}": F.max_by(F.col(f"{s}.output"), F.when(F.col(f"{s}.output").isNotNull(), F.col(f"{s}.at"))) for s in "ab"}
    joined = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), lambda x: x != ""), "\n\n")
    chunks = paired.groupBy(*KEYS).agg(joined("query").alias("query"), joined("answer").alias("answer"), F.min("same").alias("consistent"), F.max("n").alias("rows"), *[F.coalesce(v, F.lit("")).alias(c) for c, v in last.items()])
    rows = paired.withColumns({"boundary": F.col("n") == F.max("n").over(chunk), "consistent": F.min("same").over(chunk), **{c: v.over(chunk) for c, v in last.items()}})
    ends = [F.coalesce(F.when(F.col("boundary"), F.col(c)), F.lit("")).alias(c) for c in last]
    return rows.select(*KEYS, "n", "query", "answer", *ends, F.when(F.col("boundary"), F.col("consistent")).alias("consistent"), "boundary"), chunks


def rekeyed_for_gate(results: DataFrame, cases: DataFrame, duplicates: DataFrame, order: str = "ix") -> DataFrame:
    """Results under their case's source key (the case's last row); results without a case, and duplicate keys, are out."""
    own = last_writes(cases.select("case_id", order, "source_key"), ["case_id"], order).select("case_id", "source_key")
    kept = results.join(own, "case_id").join(duplicates.select("source_key"), "source_key", "left_anti")
    return kept.withColumn("case_id", F.col("source_key"))


def direct_quality(ready: DataFrame, missed: DataFrame, results: DataFrame) -> DataFrame:
    """The quality of an extraction that no judge has seen: A8 without results."""
    return run_quality(results.limit(0), missed, ready).select("ready_cases", "quality_failures", "infrastructure_failures", "unknown_chunks", "extraction_coverage", "infrastructure_success_rate")


def excluded_pairs(pairs: DataFrame, configuration: tuple[str, ...]) -> DataFrame:
    """A row for each pair that stability leaves out: a different configuration, or a side that failed."""
    moved = F.array_compact(F.array(*[F.when(~F.col(f"c.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in configuration]))
    ok = lambda side: F.col(f"{side}.ok")
    label = F.when(~ok("c") & ~ok("b"), "both failed").when(~ok("c"), "current failed").when(~ok("b"), "baseline failed").when(F.size(moved) > 0, "configuration differs")
    return pairs.withColumn("moved", moved).withColumn("label", label).where("label IS NOT NULL")


def paired_runs(current: DataFrame, baseline: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of both runs with structs ``c`` and ``b`` and whether each was scored."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("ok", eligible()).select(key, F.struct(*[c for c in [*df.columns, "ok"] if c != key]).alias(name))

    return side(current, "c").join(side(baseline, "b"), key)

"""Cases from spreadsheet rows, and small operators over rows, groups and values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, trim_u
from ..functions.ranks import number_buckets, positions
from .documents import memory_body


def turns_in_row() -> Column:
    """Turns that a row adds: query and answer, where not empty."""
    return (F.coalesce(F.col("query"), F.lit("")) != "").cast("int") + (F.coalesce(F.col("answer"), F.lit("")) != "").cast("int")


def turn_groups(rows: DataFrame, size: int, file: str = "file") -> DataFrame:
    """Adds group_ix: a case is full once ``size`` pairs of turns are gathered, whatever rows they came from.

    The count starts anew with every case, so it is a fold over a file's rows; it runs over two numbers a row, and a
    spreadsheet has at most about a million rows.
    """
    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_ix")
        group, held, out = 0, 0, []
        for turns in part["turns"].tolist():
            held += turns
            out.append(group)
            if held >= 2 * size:
                group, held = group + 1, 0
        return pd.DataFrame({"__file": part["__file"], "row_ix": part["row_ix"], "group_ix": out})

    own = rows.select(F.col(file).alias("__file"), "row_ix", turns_in_row().alias("turns"))
    kind = rows.schema[file].dataType.simpleString()
    numbered = own.groupBy("__file").applyInPandas(lambda part: number(part), f"__file {kind}, row_ix long, group_ix long")
    return rows.join(numbered.withColumnRenamed("row_ix", "__row"), F.col(file).eqNullSafe(F.col("__file")) & (F.col("row_ix") == F.col("__row"))).drop("__file", "__row")


#: Columns of a case row that are text, as the headers resolve to them.
CASE_TEXT = ("case_id", "session_id", "old_memory", "candidate_output", "reference_output", "model_name", "prompt_version", "reasoning")


def build_cases(rows: DataFrame, n_turns: str = "n_turns") -> DataFrame:
    """A case per row with defaults; ``row_ix`` counts from 0 in its file, missing columns count as empty."""
    have = {c: blank_to_null(F.col(c)) if c in rows.columns else F.lit(None).cast("string") for c in CASE_TEXT}
    at = F.col("row_ix")
    default = {
        "case_id": F.concat(F.lit("case_"), at.cast("string")), "session_id": F.concat(F.lit("session_"), at.cast("string")),
        "model_name": F.lit("unknown"), "prompt_version": F.lit("unknown"), "reasoning": F.lit(""),
    }
    filled = {c: F.coalesce(v, default[c]) if c in default else v for c, v in have.items()}
    return rows.withColumns(filled | {"row_index_start": at - F.floor(F.col(n_turns) / 2) + 1, "row_index_end": at + 1})


def sheet_cases(rows: DataFrame, size: int | None, file: str = "file") -> DataFrame:
    """One case per row, or per ``size`` pairs of turns; the case's other columns are those of its last row."""
    turns = turns_in_row()
    if size is None:
        return build_cases(rows.withColumn("n_turns", turns))
    last_of_file = Window.partitionBy(file)
    grouped = turn_groups(rows, size, file).withColumn("__end", F.max("row_ix").over(last_of_file)).withColumn("__turns", turns)
    rest = [c for c in rows.columns if c not in (file, "row_ix", "query", "answer")]
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    cases = grouped.groupBy(file, "group_ix").agg(
        F.max("row_ix").alias("row_ix"), F.sum("__turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("row_ix", said.alias("said")))).alias("said"),
        *[F.max_by(c, "row_ix").alias(c) for c in rest],
    )
    turns = F.filter(F.flatten(F.transform("said", lambda s: s["said"])), lambda t: F.coalesce(t["content"], F.lit("")) != "")
    return build_cases(cases.where("n_turns > 0").withColumn("dialogue", turns).drop("said"))


def case_errors() -> Column:
    """What a case lacks."""
    lacks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is required")) for c in ("case_id", "task_type", "session_id")]
    return F.array_compact(F.array(*lacks))


def of_reviewers(rows: DataFrame, wanted: str, reviewer: str = "reviewer") -> DataFrame:
    """Rows of the named reviewers (commas of either width between names); raises, naming some, if there are none."""
    names = [n.strip() for n in wanted.replace("，", ",").split(",") if n.strip()]
    if not names:
        return rows
    chosen = rows.where(F.col(reviewer).isin(names))
    if not chosen.limit(1).count():
        known = sorted(r[0] for r in rows.where(blank_to_null(F.col(reviewer)).isNotNull()).select(reviewer).distinct().limit(100).collect())
        raise ValueError(f"no reviewer {names}; there are {known}")
    return chosen


def value_summary(rows: DataFrame, column: str, none: str = "none", many: str = "several ({})") -> DataFrame:
    """One row: the only value of a column, how many there are, or that there is none."""
    value = blank_to_null(F.col(column).cast("string"))
    found = rows.agg(F.countDistinct(value).alias("n"), F.min(value).alias("one"))
    before, after = many.split("{}")
    return found.select("n", F.when(F.col("n") == 0, none).when(F.col("n") == 1, F.col("one")).otherwise(F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after))).alias("summary"))


def first_cases(rows: DataFrame, n: int, order: str = "row_ix") -> DataFrame:
    """The first ``n`` rows in order (a top-k per task, then of the tasks)."""
    return rows.orderBy(order).limit(n)


def in_source_order(rows: DataFrame, order: str = "row_ix") -> DataFrame:
    """Adds the position that each row had in the source, after work that lost the order."""
    return positions(rows, [number_buckets(rows, order)], [F.col(order)])


def ordered_groups(rows: DataFrame, keys: list[str], order: str = "ix") -> DataFrame:
    """M1: groups with the position of their first row and their rows in order."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [order, *[c for c in rest if c != order]]
    return rows.groupBy(*keys).agg(F.min(order).alias("first_ix"), F.array_sort(F.collect_list(F.struct(*ordered))).alias("rows"))


def first_filled(*columns: str) -> Column:
    """M3: the first of the columns that isn't blank."""
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in columns])


def last_filled(columns: tuple[str, ...], order: str = "ix") -> Column:
    """M2, an aggregate: of the last row that has one, the first of the columns that isn't blank."""
    value = first_filled(*columns)
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def explicit_memory(chunks: DataFrame, rows: DataFrame, columns: tuple[str, ...] = ("old_memory", "old_document"), file: str = "file") -> DataFrame:
    """Where the source has a column of old documents, it overrides inheritance for all rows, blanks included."""
    own = [c for c in columns if c in rows.columns]
    if not own:
        return chunks
    said = rows.select(F.col(file).alias("__file"), F.col("row_ix").alias("__row"), first_filled(*own).alias("__said"))
    joined = chunks.join(said, (F.col(file) == F.col("__file")) & (F.col("row_end") == F.col("__row")), "left")
    return joined.withColumn("old_document", F.col("__said")).drop("__file", "__row", "__said")


def missed_reasons(chunks: DataFrame) -> DataFrame:
    """Missed and skipped chunks by reason."""
    return chunks.where("kind <> 'case'").groupBy("skip_reason").agg(F.count("*").alias("n"))


def distinct_in_order(values: Column) -> Column:
    """SO5: an array without repeats, first places kept."""
    return F.array_distinct(values)


def without_wrappers(text: Column, name: str) -> Column:
    """a document's body without fence, wrapper and blank lines around it."""
    return memory_body(text, name)


def round_progress(done: str = "done", total: str = "total") -> Column:
    """Share of a round that is done, from its stage; The stages' shares."""
    part = F.when(F.col(total) > 0, F.col(done) / F.col(total)).otherwise(0.0)
    stage = {"gate": 0.98, "candidate": 0.9, "draft": 0.65, "discovery": 0.45}
    out = F.when(F.col("stage") == "finished", 1.0)
    for name, share in stage.items():
        out = out.when(F.col("stage") == name, share)
    return out.when(F.col("stage") == "extraction", 0.05 + 0.2 * part).when(F.col("stage") == "evaluation", 0.25 + 0.2 * part).otherwise(0.0)


def loop_progress(rounds: DataFrame, key: str, planned: str) -> DataFrame:
    """Progress of each loop: the mean share of its planned rounds, those not begun being 0."""
    return rounds.groupBy(key).agg((F.sum(round_progress()) / F.greatest(F.max(planned), F.count("*"))).alias("progress"))


def overriding_union(base: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """Names of either table, once each; the user's row wins over the bundled one."""
    rest = [c for c in base.columns if c != key]
    both = base.withColumn("__rank", F.lit(0)).unionByName(own.withColumn("__rank", F.lit(1)))
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), "__rank").alias("v"), F.max("__rank").alias("__rank"))
    return last.select(key, "v.*", F.when(F.col("__rank") == 1, "user").otherwise("bundled").alias("origin"))


def bounded_distinct(rows: DataFrame, key: str, value: str, order: str, limit: int) -> DataFrame:
    """Of each key the first ``limit`` distinct values in order."""
    first = rows.groupBy(key, value).agg(F.min(order).alias(order))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order, value))).where(F.col("place") <= limit)


def excerpt(message: Column, begin: str, end: str) -> Column:
    """The text between two marks, without the begin mark's line and the first paragraph."""
    after = F.regexp_extract(message, rf"(?s)\Q{begin}\E[^\n]*\n(.*?)\Q{end}\E", 1)
    body = trim_u(after)
    cut = F.instr(body, "\n\n")
    return F.when(cut > 0, trim_u(F.substr(body, cut + 2))).otherwise(body)


def has_candidate(message: Column, marks: tuple[str, ...], reasoning: str) -> Column:
    """Whether more than five characters follow the last of the first mark that occurs, or stand as reasoning before it."""
    out = F.lit(True)
    for mark in reversed(marks):
        after = trim_u(F.substring_index(message, mark, -1))
        before = F.left(message, F.length(message) - F.length(F.substring_index(message, mark, -1)) - len(mark))
        thought = F.when(F.contains(before, F.lit(reasoning)), trim_u(F.substring_index(before, reasoning, -1))).otherwise("")
        out = F.when(F.contains(message, F.lit(mark)), (F.length(after) > 5) | ((F.length(thought) > 5) & (thought != "（空）"))).otherwise(out)
    return out


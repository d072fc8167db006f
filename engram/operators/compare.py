"""Two extraction runs side by side: pairing by source, verdicts, counts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import eligible, output_text
from ..functions.ranks import number_buckets, positions

VERDICTS = ("A only", "B only", "not comparable", "same output", "B better", "A better", "tie")


def duplicate_keys(inputs: list[DataFrame], key: str) -> DataFrame:
    """Keys that stand more than once in any one of the inputs."""
    counted = [df.groupBy(key).count().where("count > 1").select(key) for df in inputs]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out.distinct()


def pair_by_source(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer pairing on the source key with structs ``a`` and ``b``; keys that are duplicated on
    either side are left out entirely, before the join could multiply them."""
    def unique(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        df = df.withColumn("ok", eligible())
        # one aggregate both finds the duplicates and keeps the single rows
        one = df.groupBy(key).agg(F.count("*").alias("n"), F.first(F.struct(*rest, "ok")).alias(name))
        return one

    left, right = unique(a, "a").withColumnRenamed("n", "n_a"), unique(b, "b").withColumnRenamed("n", "n_b")
    both = left.join(right, key, "full_outer")
    return both.where("coalesce(n_a, 1) = 1 AND coalesce(n_b, 1) = 1").drop("n_a", "n_b")


def verdict(tolerance_milli: int = 50) -> Column:
    """the ordered rules over structs ``a`` and ``b``; a difference must exceed the tolerance."""
    delta = F.col("b.score_milli") - F.col("a.score_milli")
    same = output_text(F.col("a.output")) == output_text(F.col("b.output"))
    return (
        F.when(F.col("a").isNull(), "B only").when(F.col("b").isNull(), "A only")
        .when(F.col("a.score_milli").isNull() | F.col("b.score_milli").isNull() | ~F.col("a.ok") | ~F.col("b.ok"), "not comparable")
        .when(same, "same output").when(delta > tolerance_milli, "B better").when(delta < -tolerance_milli, "A better").otherwise("tie")
    )


def judges_disagree() -> Column:
    """M8: equal outputs that were judged differently."""
    def tags(side: str) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(F.col(f"{side}.error_tags"), F.array())))

    def dims(side: str) -> Column:
        return F.array_sort(F.map_entries(F.col(f"{side}.dims")))

    return (F.col("a.score_milli") != F.col("b.score_milli")) | (dims("a") != dims("b")) | (tags("a") != tags("b")) | (F.col("a.fatal") != F.col("b.fatal"))


def winner_counts(pairs: DataFrame) -> DataFrame:
    """Every verdict, also those that don't occur."""
    labels = pairs.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    counted = pairs.groupBy("verdict").agg(F.count("*").alias("n"))
    return labels.join(counted, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


def dimension_summary(pairs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Means by dimension over pairs with both sides scored; for equal outputs B has A's scores (M7)."""
    rows = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a.ok AND b.ok").withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dimensions])))
    a = F.coalesce(F.element_at("a.dims", F.col("dimension")), F.lit(0))
    b = F.when(F.col("verdict") == "same output", a).otherwise(F.coalesce(F.element_at("b.dims", F.col("dimension")), F.lit(0)))
    return rows.groupBy("dimension").agg(
        F.count("*").alias("pairs"), (F.sum(a) / F.count("*") / 10).alias("avg_a"), (F.sum(b) / F.count("*") / 10).alias("avg_b"), (F.sum(b - a) / F.count("*") / 10).alias("delta"),
    )


def preference_rates(pairs: DataFrame) -> DataFrame:
    """Share of wins and ties among decided pairs, and B's net preference; one row."""
    outcome = F.when(F.col("verdict") == "B better", 1).when(F.col("verdict") == "A better", -1).when(F.col("verdict").isin("tie", "same output"), 0)
    n = F.greatest(F.count(outcome), F.lit(1))
    return pairs.agg(
        F.count(outcome).alias("decided"), (F.count(F.when(outcome == 1, 1)) / n).alias("b_win_rate"), (F.count(F.when(outcome == -1, 1)) / n).alias("a_win_rate"),
        (F.count(F.when(outcome == 0, 1)) / n).alias("tie_rate"), (F.coalesce(F.sum(outcome), F.lit(0)) / n).alias("net_preference"),
    )


def zip_by_position(a: DataFrame, b: DataFrame, order: str, partition: str | None = None) -> DataFrame:
    """Pairs the n-th rows of two runs, or of each value of a partition column; ``order`` is a whole number.

    Places are found by ranges of the order, so neither a run nor a value of the partition column must fit a task.
    """
    own = [partition] if partition else []

    def numbered(df: DataFrame, name: str) -> DataFrame:
        keep = [c for c in df.columns if c not in own]
        placed = positions(df, [*map(F.col, own), number_buckets(df, order)], [F.col(order)])
        if own:  # places inside the value: less those of the values before
            first = placed.groupBy(*own).agg((F.min("position") - 1).alias("__first"))
            placed = placed.join(first, own).withColumn("position", F.col("position") - F.col("__first")).drop("__first")
        return placed.select(*own, "position", F.struct(*keep).alias(name))

    return numbered(a, "a").join(numbered(b, "b"), [*own, "position"])


def match_two_levels(results: DataFrame, cases: DataFrame, exact: list[str], loose: list[str], order: str) -> DataFrame:
    """The case with all ``exact`` keys (its last row), else the first with the ``loose`` ones; else null."""
    rest = [c for c in cases.columns if c not in exact]
    last = cases.groupBy(*exact).agg(F.max_by(F.struct(*rest), order).alias("exact_case"))
    first = cases.groupBy(*loose).agg(F.min_by(F.struct(*[c for c in cases.columns if c not in loose]), order).alias("loose_case"))
    joined = results.join(last, exact, "left").join(first, loose, "left")
    level = F.when(F.col("exact_case").isNotNull(), "exact").when(F.col("loose_case").isNotNull(), "loose").otherwise("none")
    return joined.withColumn("match_level", level)


def chunk_rows(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a chunk paired by their ordinal, the shorter side padded; the last row is the boundary."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).select(*keys, "n", F.struct(*rest).alias(name))

    both = numbered(a, "a").join(numbered(b, "b"), [*keys, "n"], "full_outer")
    return both.withColumn("boundary", F.col("n") == F.max("n").over(Window.partitionBy(*keys)))


def line_bag_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """SO4: lines retained, added and removed, with multiplicity; summed by key."""
    def lines(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.col(key), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).where("trim(line) <> ''")
        return each.groupBy(key, "line").agg(F.count("*").alias(name))

    both = lines(old, "was").join(lines(new, "now"), [key, "line"], "full_outer").fillna(0, ["was", "now"])
    return both.groupBy(key).agg(
        F.sum(F.least("was", "now")).alias("retained"), F.sum(F.greatest(F.col("now") - F.col("was"), F.lit(0))).alias("added"),
        F.sum(F.greatest(F.col("was") - F.col("now"), F.lit(0))).alias("removed"),
    )

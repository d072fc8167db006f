"""How far two runs over the same cases agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import eligible, jaccard
from .results import last_writes

BINS = 11
#: Kinds of instability and what each adds to a pair's priority.
PRIORITIES = (("score", 100), ("dimension", 80), ("tags", 60), ("diagnostics", 40))


def pair_runs(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either run with structs ``c`` and ``b`` (null if absent); last row of a key wins."""
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = last_writes(df.withColumn("ok", eligible()), keys)
        return rows.select(*keys, F.struct(*[c for c in rows.columns if c not in keys]).alias(name))

    return side(current, "c").join(side(baseline, "b"), keys, "full_outer")


def _compared(pairs: DataFrame) -> DataFrame:
    return pairs.where("c IS NOT NULL AND b IS NOT NULL AND c.ok AND b.ok")


def compare_pairs(pairs: DataFrame, dimensions: tuple[str, ...], tolerance_milli: int = 10) -> DataFrame:
    """The pairs with both sides scored: deltas, what changed, and the ordering columns of O1."""
    rows = _compared(pairs)
    tags_c, tags_b = F.coalesce("c.error_tags", F.array()), F.coalesce("b.error_tags", F.array())
    delta = F.col("c.score_milli") - F.col("b.score_milli")
    moved = [F.abs(F.coalesce(F.element_at("c.dims", F.lit(d)), F.lit(0)) - F.coalesce(F.element_at("b.dims", F.lit(d)), F.lit(0))) * 100 > tolerance_milli for d in dimensions]
    changed_dims = sum((m.cast("int") for m in moved), F.lit(0))
    score, tags = F.abs(delta) > tolerance_milli, (F.size(F.array_except(tags_c, tags_b)) + F.size(F.array_except(tags_b, tags_c))) > 0
    flags = {"score": score, "dimension": changed_dims > 0, "tags": tags, "diagnostics": F.col("c.n_diagnostics") != F.col("b.n_diagnostics")}
    rows = rows.withColumns({"delta_milli": delta, "changed_dims": changed_dims, "tag_jaccard": jaccard(tags_c, tags_b), "added": F.array_except(tags_c, tags_b), "removed": F.array_except(tags_b, tags_c)})
    rows = rows.withColumns({f"changed_{k}": v for k, v in flags.items()})
    priority = sum((F.col(f"changed_{k}").cast("int") * p for k, p in PRIORITIES), F.lit(0))
    return rows.withColumn("priority", priority)


def stability_summary(pairs: DataFrame, compared: DataFrame, tolerance_milli: int = 10) -> DataFrame:
    """Counts of all pairs, means over the compared ones; one row."""
    both = F.col("c").isNotNull() & F.col("b").isNotNull()
    counts = pairs.agg(
        F.count(F.when(F.col("c").isNotNull(), 1)).alias("current_keys"), F.count(F.when(F.col("b").isNotNull(), 1)).alias("baseline_keys"),
        F.count(F.when(both, 1)).alias("matched"), F.count(F.when(both & F.expr("c.ok AND b.ok"), 1)).alias("common"),
        F.count(F.when(both & ~F.expr("c.ok AND b.ok"), 1)).alias("failure_pairs"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("current_only"), F.count(F.when(F.col("c").isNull(), 1)).alias("baseline_only"),
    )
    n = F.greatest(F.count("*"), F.lit(1))
    stable = ~(F.col("changed_score") | F.col("changed_dimension") | F.col("changed_tags") | F.col("changed_diagnostics"))
    means = compared.agg(
        (F.coalesce(F.sum("c.score_milli"), F.lit(0)) / n / 1000).alias("current_avg"), (F.coalesce(F.sum("b.score_milli"), F.lit(0)) / n / 1000).alias("baseline_avg"),
        (F.coalesce(F.sum(F.abs("delta_milli")), F.lit(0)) / n / 1000).alias("avg_abs_delta"), (F.coalesce(F.max(F.abs("delta_milli")), F.lit(0)) / 1000).alias("max_abs_delta"),
        (F.count(F.when(F.abs("delta_milli") <= tolerance_milli, 1)) / n).alias("score_exact_rate"), (F.count(F.when(~F.col("changed_tags"), 1)) / n).alias("tag_exact_rate"),
        F.count(F.when(~stable, 1)).alias("unstable"), F.count(F.when(stable, 1)).alias("stable"),
    )
    return counts.withColumn("one", F.lit(1)).join(means.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def dimension_drift(compared: DataFrame, dimensions: tuple[str, ...], tolerance_milli: int = 10) -> DataFrame:
    """A dimension that one side lacks counts as 0 there."""
    gap = F.abs(F.coalesce(F.element_at("c.dims", F.col("dimension")), F.lit(0)) - F.coalesce(F.element_at("b.dims", F.col("dimension")), F.lit(0)))
    rows = compared.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dimensions]))).withColumn("gap", gap)
    return rows.groupBy("dimension").agg(
        (F.sum("gap") / F.count("*") / 10).alias("avg_abs_delta"), (F.max("gap") / 10).alias("max_abs_delta"),
        (F.count(F.when(F.col("gap") * 100 <= tolerance_milli, 1)) / F.count("*")).alias("exact_rate"),
    )


def tag_drift(compared: DataFrame) -> DataFrame:
    """How often each tag was added or removed."""
    moves = compared.select(F.explode("added").alias("tag"), F.lit(1).alias("plus"), F.lit(0).alias("minus")).unionByName(
        compared.select(F.explode("removed").alias("tag"), F.lit(0).alias("plus"), F.lit(1).alias("minus"))
    )
    return moves.groupBy("tag").agg(F.sum("plus").alias("added"), F.sum("minus").alias("removed"))


def instability_kinds(compared: DataFrame) -> DataFrame:
    """A19."""
    kinds = F.array_compact(F.array(*[F.when(F.col(f"changed_{k}"), F.lit(k)) for k, _ in PRIORITIES]))
    return compared.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def most_unstable(compared: DataFrame, keys: list[str], n: int) -> DataFrame:
    """O1: the n first by priority, score gap, tag distance, changed dimensions, key."""
    order = [F.desc("priority"), F.abs("delta_milli").desc(), F.asc("tag_jaccard"), F.desc("changed_dims"), *keys]
    return compared.orderBy(*order).limit(n)


def distribution(results: DataFrame) -> DataFrame:
    """Share of eligible scores in each of 11 bins of 0.5, ties to the even bin; zeros if nothing is scored."""
    bins = results.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    clipped = F.greatest(F.lit(0), F.least(F.lit(5000), F.col("score_milli")))
    counted = results.where(eligible()).groupBy(F.bround(clipped / F.lit(500)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("one", F.lit(1))
    rows = bins.join(counted, "bin", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # 11 bins, one total
    return rows.select("bin", F.coalesce(F.col("n") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0)).alias("share"))


def divergences(current: DataFrame, baseline: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Kullback-Leibler and Jensen-Shannon divergence of two distributions; one row."""
    def kl(p: Column, q: Column) -> Column:
        return F.sum(F.when(p > 0, p * F.log((p + eps) / (q + eps))).otherwise(0.0))

    both = current.withColumnRenamed("share", "p").join(baseline.withColumnRenamed("share", "q"), "bin")
    mid = (F.col("p") + F.col("q")) / 2
    return both.agg(F.round(kl(F.col("p"), F.col("q")), 6).alias("kl"), F.round((kl(F.col("p"), mid) + kl(F.col("q"), mid)) / 2, 6).alias("js"))

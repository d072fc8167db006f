"""URL filter: rules first, then a character language-model ratio (operator 4); DataFrame functions only.

Two variable-order Markov models over the characters of host and path are learnt, one from the URLs that
a rule blocks and one from all others (allowed by a rule, or not covered).  A gram is a character with up
to ``ORDER`` characters before it; its probability interpolates all orders (Witten-Bell: a context passes
on as much weight to the shorter one as it has distinct continuations).  URLs are dealt to two folds by a hash, and
each fold is scored by the models of the other, so no URL trains what judges it.  All URLs are counted.  A URL's
score is the mean over its characters of log10 P(blocked model) - log10 P(other model), so length doesn't
count.  The threshold is calibrated on the URLs that the rules cover, scored like this by models that haven't seen
them: at most ``FALSE_BLOCKS`` of the allowed ones lie above it, and it is never below 0.  Without allowed URLs it is
the score that half of the blocked ones reach.

Defined results: a null URL or one without ``://`` has empty host and path, is covered by no rule and is
scored by its end mark alone; a very long URL counts and is scored whole; repeated rows stay repeated; a table without
rows gives none; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparktools import bare, cut

#: (verdict, host, path). Fixed values of the operator's contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ORDER = 4
#: Share of the allowed URLs that the method may block.
FALSE_BLOCKS = 0.01
#: Gram tables of at most this many rows (about 20 MB) are broadcast; larger ones are joined by shuffle, salted.
SMALL, SALTS = 300_000, 32
START, END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or without ``://``."""
    rest = f"coalesce(CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) END, '')"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    path = f"regexp_extract(substring({rest}, length({host}) + 1), '^[^?#]*', 0)"
    return F.translate(F.expr(host), _UPPER, _LOWER), F.expr(path)


def rule_of(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits columns host and path; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _grams(text: Column, order: int) -> Column:
    """The gram that ends at each character of host + path + end mark, ``order`` + 1 characters long."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


#: Count columns of the two folds: URLs that a rule blocks, and all others.
CLASSES = ("blocked0", "other0", "blocked1", "other1")


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio0, ratio1: by the models of fold 0 and 1) from rows (gram, CLASSES: counts of full grams)."""
    counts = cut(grams)
    known = None
    for n in range(order + 1):
        level = counts.groupBy(F.expr(f"substring(gram, {order - n + 1}, {n + 1})").alias("gram")).agg(*[F.sum(c).alias(c) for c in CLASSES])
        level = level.withColumn("context", F.expr(f"substring(gram, 1, {n})"))
        contexts = level.groupBy("context").agg(
            *[f(c).alias(f"{c}_{k}") for c in CLASSES for k, f in (("all", F.sum), ("kinds", lambda c: F.sum((F.col(c) > 0).cast("long"))))]
        )
        level = level.join(contexts, "context")
        if known is None:
            kinds = counts.select(F.substring("gram", order + 1, 1).alias("c")).distinct().agg((F.count("*") + 1).alias("n")).head()[0]
            shorter = {c: F.lit(1.0 / kinds) for c in CLASSES}
        else:
            level = level.join(known.select(F.col("gram").alias("shorter"), *[F.col(f"p_{c}").alias(f"s_{c}") for c in CLASSES]), F.expr("substring(gram, 2)") == F.col("shorter"))
            shorter = {c: F.col(f"s_{c}") for c in CLASSES}
        ps = [
            F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * shorter[c]) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(shorter[c]).alias(f"p_{c}")
            for c in CLASSES
        ]
        known = cut(level.select("gram", *ps))
    return known.select("gram", *[(F.log10(f"p_blocked{k}") - F.log10(f"p_other{k}")).alias(f"ratio{k}") for k in (0, 1)])


def _threshold(scored: DataFrame, false_blocks: float) -> float:
    """Calibrated on the covered URLs, all of them scored by models that they didn't train."""
    at = lambda says, share: F.percentile_approx(F.when(F.col("says") == says, F.col("score")), F.lit(share), F.lit(10000))
    allowed, blocked = scored.agg(at("allow", 1 - false_blocks), at("block", 0.5)).head()
    mark = blocked if allowed is None else allowed
    return max(0.0, mark) if mark is not None and math.isfinite(mark) else 0.0


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER, false_blocks: float = FALSE_BLOCKS, small: int = SMALL) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score, threshold."""
    host, path = host_and_path("url")
    rows = bare(pages, key, url).toDF("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, says = rule_of(rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), says.alias("says"), F.pmod(F.xxhash64("host", "path"), F.lit(2)).alias("fold"))
    ends = rows.withColumn("gram", F.explode(_grams(F.concat("host", "path"), order)))
    blocked = F.coalesce(F.col("says") == "block", F.lit(False))
    of = {f"{c}{k}": F.sum(((F.col("fold") == k) & (blocked if c == "blocked" else ~blocked)).cast("long")).alias(f"{c}{k}") for c in ("blocked", "other") for k in (0, 1)}
    ratios = log_ratios(ends.groupBy("gram").agg(*[of[c] for c in CLASSES]), order)
    if ratios.count() <= small:
        matched = ends.join(F.broadcast(ratios), "gram")
    else:
        salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = ends.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    ratio = F.when(F.col("fold") == 0, F.col("ratio1")).otherwise(F.col("ratio0"))
    scored = matched.groupBy("page_id", "host", "path", "rule", "says").agg(F.avg(ratio).alias("score"), F.count("*").alias("grams"))
    copies = F.expr("sequence(1L, grams DIV (length(host) + length(path) + 1))")
    scored = cut(scored.withColumn("copy", F.explode(copies)).drop("copy", "grams"))
    threshold = _threshold(scored, false_blocks)
    verdict = F.coalesce("says", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return scored.select(F.col("page_id").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))

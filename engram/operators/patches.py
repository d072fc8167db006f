"""Patches of prompts by place: sections with their offsets, spans of edits inside them, budget, overlaps, and the patched text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import WHITE, trim_u
from .diffs import lines_of

# What a heading, a list item and their indents look like, the titles of texts without headings, and an edit's operations.
HEADING = r"(?U)^#{1,6}\s+\S"
LIST_ITEM = r"(?U)^\s*(?:[-*+]\s+|\d+[.)、]\s+)"
LIST_INDENT = r"(?U)^(\s*)(?:[-*+]\s+|\d+[.)、]\s+)"
HEADING_INDENT = r"(?U)^(\s*)#{1,6}\s+\S"
WHOLE, PARAGRAPH = "全文", "段落 "
OPERATIONS = ("insert_before_section", "insert_after_section", "append_to_section", "replace_within_section", "delete_within_section")
RATIO, LEAST = 0.25, 800


def _ends_trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def section_spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """one row per section: key, section_id (S001, ...), title, level, begin, end (offsets in characters), body.

    A section goes from a heading to the next one; what stands before the first belongs to none.  Without headings, paragraphs
    between blank lines are sections of level 0, a single one is the whole text.  A row is cut where it stands, without a shuffle.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(whole, r"(?mdU)^(?=#{1,6}\s+\S)")
    ends = "aggregate(__parts, named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRUCT<begin: INT, end: INT>>)), (s, x) -> named_struct('at', s.at + length(x), 'out', concat(s.out, array(named_struct('begin', s.at, 'end', s.at + length(x))))), s -> s.out)"
    blank = "regexp_replace(x, '(?U)\\\\s+', '') = ''"
    blocks = f"""aggregate(__lines, named_struct('at', 0, 'begin', 0, 'out', CAST(array() AS ARRAY<STRUCT<begin: INT, end: INT>>)),
        (s, x) -> named_struct('at', s.at + length(x), 'begin', if({blank} AND s.at > s.begin, s.at + length(x), s.begin), 'out', if({blank} AND s.at > s.begin, concat(s.out, array(named_struct('begin', s.begin, 'end', s.at))), s.out)),
        s -> if(s.begin < s.at, concat(s.out, array(named_struct('begin', s.begin, 'end', s.at))), s.out))"""
    cut = rows.select(F.col(key), whole.alias("__text"), parts.alias("__parts"), F.split(whole, r"(?<=\n)").alias("__lines")).where("__text <> ''")
    cut = cut.withColumn("__spans", F.filter(F.expr(ends), lambda s: F.substr("__text", s["begin"] + 1, s["end"] - s["begin"]).rlike(HEADING)))
    cut = cut.withColumn("__headed", F.size("__spans") > 0).withColumn("__blocks", F.when(~F.col("__headed"), F.expr(blocks)))
    one = F.array(F.struct(F.lit(0).alias("begin"), F.length("__text").alias("end")))
    cut = cut.withColumn("__s", F.when(F.col("__headed"), F.col("__spans")).when(F.size("__blocks") <= 1, one).otherwise(F.col("__blocks")))
    found = cut.select(key, "__headed", F.size("__s").alias("__n"), "__text", F.posexplode("__s").alias("__at", "__span"))
    found = found.withColumn("body", F.substr("__text", F.col("__span.begin") + 1, F.col("__span.end") - F.col("__span.begin")))
    first = F.coalesce(F.try_element_at(F.filter(F.transform(lines_of(F.col("body")), trim_u), lambda x: x != ""), F.lit(1)), F.lit(""))
    number = (F.col("__at") + 1).cast("string")
    paragraph = F.when(first == "", F.concat(F.lit(PARAGRAPH), number)).otherwise(F.concat(F.lit(PARAGRAPH), number, F.lit(": "), F.substring(first, 1, 60)))
    title = F.when(F.col("__headed"), trim_u(F.regexp_extract("body", r"(?U)^(#{1,6}\s+[^\n]+)", 1))).when(F.col("__n") == 1, WHOLE).otherwise(paragraph)
    level = F.when(F.col("__headed"), F.length(F.regexp_extract("body", "^(#+)", 1))).otherwise(0)
    return found.select(key, F.format_string("S%03d", F.col("__at") + 1).alias("section_id"), title.alias("title"), level.alias("level"), F.col("__span.begin").alias("begin"), F.col("__span.end").alias("end"), "body")


def _inserted(text: Column, strip_headings: bool) -> Column:
    """An inserted text's lines: marks of a diff taken off, list marks followed by a space, blank lines (and headings) dropped."""
    def clean(line: Column) -> Column:
        x = trim_u(line)
        x = F.when(x.startswith("+") & ~x.startswith("+++"), F.regexp_replace(x, r"(?U)^\+\s*", "")).otherwise(x)
        return F.regexp_replace(F.regexp_replace(x, r"(?U)^\+\s+", "- "), r"(?U)^([-*])(?=\S)", "$1 ")

    lines = F.filter(F.transform(lines_of(text), clean), lambda x: trim_u(x) != "")
    if strip_headings:
        lines = F.filter(lines, lambda x: ~trim_u(x).rlike(HEADING))
    return F.transform(lines, trim_u)


def _is_list(body: Column) -> Column:
    """Whether at least half of a section's lines are list items."""
    lines = F.filter(lines_of(body), lambda x: (trim_u(x) != "") & ~trim_u(x).rlike(HEADING))
    items = F.size(F.filter(lines, lambda x: x.rlike(LIST_ITEM)))
    return (items > 0) & (items >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2)))


def _indent(body: Column) -> Column:
    """The indent of most of a section's list items, the shorter of equals; without items that of its first heading."""
    indents = F.transform(F.filter(lines_of(body), lambda x: x.rlike(LIST_ITEM)), lambda x: F.regexp_extract(x, LIST_INDENT, 1))
    ranked = F.array_sort(F.transform(F.array_distinct(indents), lambda i: F.struct((-F.size(F.filter(indents, lambda x: x == i))).alias("n"), F.length(i).alias("size"), F.array_position(indents, i).alias("at"), i.alias("indent"))))
    heads = F.filter(lines_of(body), lambda x: x.rlike(HEADING_INDENT))
    return F.coalesce(F.try_element_at(ranked, F.lit(1))["indent"], F.regexp_extract(F.try_element_at(heads, F.lit(1)), HEADING_INDENT, 1), F.lit(""))


def placed_edits(prompts: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits (prompt_id, ix, op, target_id, old_text, new_text, text, evidence_refs) of prompts (prompt_id, prompt) with problem (null: can be applied), begin, end, replacement and change."""
    spans = section_spans(prompts, "prompt_id", "prompt").select("prompt_id", F.struct("section_id", "begin", "end", "body", _is_list(F.col("body")).alias("listed"), _indent(F.col("body")).alias("indent"), F.length(_ends_trimmed(F.col("body"))).alias("filled")).alias("s"))
    # edits meet a prompt and all its sections at once, and stay by prompt: they are shuffled once.  Texts and edits are many times what a
    # compressed file of them takes, so no side is broadcast by its size
    sections = spans.groupBy("prompt_id").agg(F.collect_list("s").alias("__sections"))
    spans = prompts.select("prompt_id", F.col("prompt").alias("__prompt")).join(sections.hint("merge"), "prompt_id", "left")
    text = lambda c: trim_u(F.coalesce(F.col(c), F.lit("")))
    rows = edits.withColumns({"op": text("op"), "target_id": text("target_id"), "old_text": text("old_text"), "new_text": text("new_text")})
    rows = rows.withColumn("text", F.when(text("text") != "", text("text")).otherwise(F.col("new_text")))
    rows = rows.join(spans.hint("merge"), "prompt_id").withColumn("__s", F.try_element_at(F.filter("__sections", lambda s: s["section_id"] == F.col("target_id")), F.lit(1)))
    rows = rows.withColumns({c: F.col(f"__s.{c}") for c in ("begin", "end", "body")}).drop("__sections")
    within, appends = F.col("op").isin("replace_within_section", "delete_within_section"), F.col("op") == "append_to_section"
    rows = rows.withColumn("__in", F.when(appends, _inserted(F.col("text"), True)).when(~within, _inserted(F.col("text"), False)))
    rows = rows.withColumn("__found", F.when(within, F.instr("body", F.col("old_text"))))
    misfit = appends & F.col("__s.listed") & F.exists("__in", lambda x: ~x.rlike(LIST_ITEM))
    problem = (
        F.when(~F.col("op").isin(*OPERATIONS), "unknown operation").when(F.col("begin").isNull(), "no such section").when(F.size(F.coalesce("evidence_refs", F.array())) == 0, "no evidence")
        .when(within & (F.col("old_text") == ""), "no old text").when((F.col("op") == "replace_within_section") & (F.col("new_text") == ""), "no new text").when(~within & (F.col("text") == ""), "no text")
        .when(within & (F.col("__found") == 0), "old text not found").when(~within & (F.size("__in") == 0), "nothing to insert").when(misfit, "no list item")
    )
    place = (
        F.when(within, F.col("begin") + F.col("__found") - 1).when(F.col("op") == "insert_before_section", F.col("begin")).when(F.col("op") == "insert_after_section", F.col("end"))
        .otherwise(F.col("begin") + F.col("__s.filled"))
    )
    rows = rows.withColumn("problem", problem).withColumn("__place", place)
    indent = F.when(appends, F.col("__s.indent")).otherwise("")
    put = F.array_join(F.transform("__in", lambda x: F.concat(indent, x)), "\n")
    before, after = F.substr("__prompt", F.col("__place"), F.lit(1)), F.substr("__prompt", F.col("__place") + 1, F.lit(1))
    put = F.concat(F.when((F.col("__place") > 0) & (before != "\n"), "\n").otherwise(""), put, F.when((F.col("__place") < F.length("__prompt")) & (after != "\n"), "\n").otherwise(""))
    replacement = F.when(F.col("op") == "replace_within_section", F.col("new_text")).when(F.col("op") == "delete_within_section", "").otherwise(put)
    gone = F.when(within, F.length("old_text")).otherwise(0)
    good = F.col("problem").isNull()
    return rows.withColumns({
        "begin": F.when(good, F.col("__place")), "end": F.when(good, F.col("__place") + gone), "replacement": F.when(good, replacement), "change": F.when(good, gone + F.length(replacement)),
    }).drop("__prompt", "__in", "__found", "__place", "__s", "body")


def patched(prompts: DataFrame, edits: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """prompt_id, candidate, change_chars, max_change_chars, change_ratio and edits (ix, status, message), in their order.

    Edits are taken in order while their characters (taken out and put in) stay within max(least, ratio x length); one that does not fit
    is left out and later ones may still fit.  A span that meets the span of an edit taken before is refused.  The text
    is put together from the spans, so no edit moves another.
    """
    placed = placed_edits(prompts, edits)
    packed = placed.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("ix", "begin", "end", "replacement", "change", "problem"))).alias("__edits"))
    rows = prompts.select("prompt_id", F.coalesce("prompt", F.lit("")).alias("prompt")).join(packed.hint("merge"), "prompt_id", "left")
    rows = rows.withColumn("max_change_chars", F.greatest(F.lit(least), F.floor(F.length("prompt") * F.lit(ratio)).cast("int"))).withColumn("__max", F.col("max_change_chars"))
    meets = "exists(s.taken, t -> e.begin < t.end AND t.begin < e.end)"
    problem = f"coalesce(e.problem, if({meets}, 'overlaps', if(s.used + e.change > __max, 'over budget', NULL)))"
    start = "named_struct('used', 0, 'taken', CAST(array() AS ARRAY<STRUCT<begin: INT, end: INT, ix: BIGINT, replacement: STRING>>), 'said', CAST(array() AS ARRAY<STRUCT<ix: BIGINT, status: STRING, message: STRING>>))"
    step = f"""transform(array({problem}), p -> named_struct('used', s.used + if(p IS NULL, e.change, 0),
        'taken', if(p IS NULL, concat(s.taken, array(named_struct('begin', e.begin, 'end', e.end, 'ix', CAST(e.ix AS BIGINT), 'replacement', e.replacement))), s.taken),
        'said', concat(s.said, array(named_struct('ix', CAST(e.ix AS BIGINT), 'status', if(p IS NULL, 'applied', 'skipped'), 'message', coalesce(p, ''))))))[0]"""
    rows = rows.withColumn("__done", F.expr(f"aggregate(coalesce(__edits, array()), {start}, (s, e) -> {step})"))
    # pieces between the spans, an insertion before what is replaced at its place
    text = "aggregate(array_sort(__done.taken), named_struct('at', 0, 'text', ''), (s, t) -> named_struct('at', t.end, 'text', concat(s.text, substr(prompt, s.at + 1, t.begin - s.at), t.replacement)), s -> concat(s.text, substr(prompt, s.at + 1)))"
    return rows.select(
        "prompt_id", F.expr(text).alias("candidate"), F.col("__done.used").alias("change_chars"), "max_change_chars",
        F.when(F.col("prompt") != "", F.bround(F.col("__done.used") / F.length("prompt"), 4)).otherwise(0.0).alias("change_ratio"), F.col("__done.said").alias("edits"),
    )

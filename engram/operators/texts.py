"""Documents and prompts as text: sections, memory documents in model output, similar rules, patches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import trim_u


def normalise_reference(c: Column) -> Column:
    """markdown prefix, quotes and end punctuation off, white space to one space, lower case.

    NFKC, which Spark lacks, is applied only to texts with characters beyond ASCII; all else is Spark's own.
    """
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    plain = c.rlike(r"^[\x00-\x7F]*$")
    text = F.when(plain, c).otherwise(nfkc(F.when(plain, F.lit(None)).otherwise(c)))
    text = F.regexp_replace(trim_u(text), r"^(?:(?:#{1,6}|[-*+]|\d+[.)、])\s*)+", "")
    text = F.regexp_replace(text, r"""^["'“”‘’`「」.,;:!?，。；：！？]+|["'“”‘’`「」.,;:!?，。；：！？]+$""", "")
    return F.lower(trim_u(F.regexp_replace(text, r"(?U)\s+", " ")))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """one row per section: key, section_id (S001, ...), level, title, body.

    A section starts at a markdown heading; text before the first heading is no section; without any
    heading, blocks between blank lines are sections.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("n", "line"))
    by = Window.partitionBy(key).orderBy("n")
    whole = Window.partitionBy(key)
    heading = F.col("line").rlike(r"^#{1,6}\s+\S")
    lines = lines.withColumn("heading", heading).withColumn("headed", F.max("heading").over(whole))
    blank = F.trim("line") == ""
    start = F.when(F.col("headed"), F.col("heading")).otherwise(~blank & F.coalesce(F.lag(blank).over(by), F.lit(True)))
    lines = lines.withColumn("section", F.sum(start.cast("int")).over(by)).where("section > 0")
    lines = lines.where(F.col("headed") | (F.trim("line") != ""))
    out = lines.groupBy(key, "section").agg(F.min_by("line", "n").alias("first"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("all"), F.first("headed").alias("headed"))
    return out.select(
        key, F.format_string("S%03d", "section").alias("section_id"),
        F.when(F.col("headed"), F.length(F.regexp_extract("first", "^(#+)", 1))).otherwise(0).alias("level"),
        F.when(F.col("headed"), F.trim(F.regexp_replace("first", r"^#+\s+", ""))).otherwise(F.substring("first", 1, 60)).alias("title"),
        F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("body"),
    )


def message_content(envelope: Column) -> Column:
    """the text of an interface's JSON answer, whichever of the usual fields has it."""
    fields = ("$.choices[0].message.content", "$.choices[0].message.reasoning", "$.choices[0].text", "$.content", "$.result", "$.answer")
    return F.coalesce(*[F.when(F.get_json_object(envelope, p) != "", F.get_json_object(envelope, p)) for p in fields], envelope)


def json_body(c: Column) -> Column:
    """the JSON object in a model's answer: code fence off, then from the first to the last brace."""
    text = F.regexp_replace(c, r"(?s)^\s*```\w*\s*\n?|```\s*$", "")
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def stream_content(lines: Column) -> Column:
    """ST5: content folded from the data lines of an event stream."""
    data = F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("data:") & ~F.contains(x, F.lit("[DONE]")))
    return F.array_join(F.transform(data, lambda x: F.coalesce(F.get_json_object(F.substring(x, 6, 1 << 30), "$.choices[0].delta.content"), F.lit(""))), "")

"""Two versions of a text line by line: matched blocks, what was put in and taken out, hunks, and the diff as text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import trim_u

# The characters that end a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
_OP = T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("a0", "a1", "b0", "b1")]])


def lines_of(text: Column) -> Column:
    """The lines of a text; what ends the last one begins no other."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(whole, rf"(?:{LINE_END})\z", ""), LINE_END))


def aligned(a: Column, b: Column, frequent: bool = False) -> Column:
    """Opcodes of the longest matched blocks, and those of each hunk with three lines around it; unless ``frequent``, very frequent lines of long texts match nothing by themselves."""
    named = lambda op: dict(zip(("tag", "a0", "a1", "b0", "b1"), op, strict=True))

    @F.pandas_udf(T.StructType([T.StructField("ops", T.ArrayType(_OP)), T.StructField("hunks", T.ArrayType(T.ArrayType(_OP)))]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            matcher = difflib.SequenceMatcher(a=list(x), b=list(y), autojunk=not frequent)
            ops = [named(op) for op in matcher.get_opcodes()]
            rows.append((ops, [[named(op) for op in hunk] for hunk in matcher.get_grouped_opcodes(3)] if ops else []))
        return pd.DataFrame(rows, columns=["ops", "hunks"])

    return run(a, b)


def _range(begin: Column, end: Column) -> Column:
    """Lines begin .. end as a hunk's header names them: one line by its number, none by the line before."""
    n = end - begin
    one, start = (begin + 1).cast("string"), F.when(n == 0, begin).otherwise(begin + 1).cast("string")
    return F.when(n == 1, one).otherwise(F.concat(start, F.lit(","), n.cast("string")))


def _part(lines: Column, begin: Column, end: Column, mark: str) -> Column:
    return F.transform(F.slice(lines, begin + 1, end - begin), lambda x: F.concat(F.lit(mark), x))


def line_diff(rows: DataFrame, old: str, new: str, old_name: str = "old", new_name: str = "new", frequent: bool = False) -> DataFrame:
    """adds diff (ops, hunks, added, removed, old_chars, new_chars, growth, repeated_headings, old_hash, new_hash, text).

    A row is aligned by itself, where it stands: nothing is shuffled.  Equal lines are matched in the order of the longest blocks, so a moved
    line counts as taken out and put in.  Null texts count as empty.  Like the standard library's matcher, lines that are more than 1 % of a text of
    200 lines or more begin no block, unless ``frequent``.
    """
    a, b = F.col("__a"), F.col("__b")
    rows = rows.withColumns({"__a": lines_of(F.col(old)), "__b": lines_of(F.col(new))}).withColumn("__d", aligned(a, b, frequent))
    ops, hunks = F.col("__d.ops"), F.col("__d.hunks")
    total = lambda tags, n: F.aggregate(F.filter(ops, lambda o: o["tag"].isin(*tags)), F.lit(0), lambda s, o: s + n(o))
    of_op = lambda o: F.when(o["tag"] == "equal", _part(a, o["a0"], o["a1"], " ")).otherwise(F.concat(_part(a, o["a0"], o["a1"], "-"), _part(b, o["b0"], o["b1"], "+")))
    head = lambda h: F.concat(F.lit("@@ -"), _range(h[0]["a0"], F.element_at(h, -1)["a1"]), F.lit(" +"), _range(h[0]["b0"], F.element_at(h, -1)["b1"]), F.lit(" @@"))
    body = F.flatten(F.transform(hunks, lambda h: F.concat(F.array(head(h)), F.flatten(F.transform(h, of_op)))))
    text = F.when(F.size(hunks) == 0, "").otherwise(F.array_join(F.concat(F.array(F.lit(f"--- {old_name}"), F.lit(f"+++ {new_name}")), body), "\n"))
    before, after = (F.coalesce(F.col(c), F.lit("")) for c in (old, new))
    heads = F.filter(F.transform(b, trim_u), lambda x: x.startswith("#"))
    repeated = F.array_sort(F.filter(F.array_distinct(heads), lambda h: F.size(F.filter(heads, lambda x: x == h)) > 1))
    diff = F.struct(
        ops.alias("ops"), hunks.alias("hunks"), total(("insert", "replace"), lambda o: o["b1"] - o["b0"]).alias("added"), total(("delete", "replace"), lambda o: o["a1"] - o["a0"]).alias("removed"),
        F.length(before).alias("old_chars"), F.length(after).alias("new_chars"),
        F.when(before != "", (F.length(after) - F.length(before)) / F.length(before)).otherwise((after != "").cast("double")).alias("growth"),
        repeated.alias("repeated_headings"), F.sha2(before, 256).alias("old_hash"), F.sha2(after, 256).alias("new_hash"), text.alias("text"),
    )
    return rows.withColumn("diff", diff).drop("__a", "__b", "__d")

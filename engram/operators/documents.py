"""Memory documents in model output: where the document begins and ends, and its body without wrappers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trim_u

# The fence around a whole answer, lines that only wrap a document, the marks of an envelope, and the headings that part
# a document from what stands before it (by name of the rule; of equal ends the earlier rule counts).
FENCE = r"(?isU)^\s*```(?:markdown|md|text|json)?[ \t]*\r?\n?(.*?)\r?\n?```\s*\z"
WRAPPER = r"(?iU)^(?:#{1,6}\s*(?:Output|输出|@)\s*[:：]?|---+\s*@\s*---+|(?:\*{1,2}|_{1,2})?(?:Output|输出)(?:\*{1,2}|_{1,2})?\s*[:：]?)\z"
ENVELOPE = r"(?i)^[ \t]*<<<MEMORY_DOCUMENT_V1:@>>>[ \t]*\z"
ENVELOPE_END = r"(?i)^[ \t]*<<<END_MEMORY_DOCUMENT_V1>>>[ \t]*\z"
MARKERS = {
    "output_heading": r"(?i)^[ \t]*#{1,6}[ \t]*(?:Output|输出)[ \t]*[:：]?[ \t]*\z",
    "output_marker": r"(?i)^[ \t]*(?:\*{1,2}|_{1,2})?(?:Output|输出)(?:\*{1,2}|_{1,2})?[ \t]*[:：]?[ \t]*\z",
    "document_separator": r"(?i)^[ \t]*---+[ \t]*@[ \t]*---+[ \t]*\z",
    "document_heading": r"(?i)^[ \t]*#{1,6}[ \t]*@[ \t]*\z",
}
REASONING = r"(?iU)^[ \t]*(?:#{1,6}[ \t]*)?(?:(?:Think|Reasoning)\b|(?:思考|推理|分析)(?:过程)?(?=[ \t]*[:：]|[ \t]*\z))"
STRUCTURED = r"(?U)^[ \t]*(?:#{1,6}[ \t]+\S|第[一二三四五六七八九十]+分区|[一二三四五六七八九十]+、)"
LISTED = r"(?U)^[ \t]*(?:[-*•]|\d+[.、])[ \t]+\S"
JSON_TEXT = ("document", "document_text", "content", "output", "result", "answer", "response")
JSON_INSIDE = ("data", "result", "output", "response")
CONFIDENCE = {"document_envelope_v1": 1.0, "unterminated": 0.9, "json": 0.98, "marker": 0.97, "structured_markdown_fallback": 0.78, "list_fallback": 0.7}
WARNINGS = {
    "unterminated": "统一输出协议缺少结束标记", "reasoning_only": "检测到推理段但没有明确输出边界", "structured_markdown_fallback": "未检测到明确输出标记，按结构化 Markdown 正文解析",
    "list_fallback": "未检测到明确输出标记，按列表正文解析", "unrecognized": "无法识别可靠的正文边界",
}


def _named(pattern: str, name: str) -> str:
    """The pattern for one document name (``@`` stands for it)."""
    return pattern.replace("@", re.sub(r"([^\w])", r"\\\1", name))


def _unfenced(text: Column) -> Column:
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def memory_body(text: Column, name: str) -> Column:
    """a document's body: outer fence off, lines' ends trimmed, without the wrapper and blank lines before it and the blank ones after it."""
    body = F.regexp_replace(_unfenced(trim_u(F.coalesce(text, F.lit("")))), "\r\n?", "\n")
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    wraps = lambda x: trim_u(x).rlike(_named(WRAPPER, name))
    first = F.array_min(F.transform(lines, lambda x, i: F.when((x != "") & ~wraps(x), i)))
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x != "", i)))
    return F.when(first.isNull(), "").otherwise(F.array_join(F.slice(lines, first + 1, F.greatest(F.lit(1), last - first + 1)), "\n"))


def _text_in(value: dict, names: tuple[str, ...]) -> tuple[str, str] | None:
    """(path, text) of the first of the names that holds a text; a node before what is inside it."""
    todo = [("", value)]
    while todo:
        path, node = todo.pop()
        for name in names:
            if isinstance(node.get(name), str):
                return path + name, node[name]
        todo += [(f"{path}{k}.", node[k]) for k in reversed(JSON_INSIDE) if isinstance(node.get(k), dict)]
    return None


def _json_outcome(name: str):
    plain = lambda x: re.sub(r"[^a-z0-9]", "", str(x).lower())
    names = (name, name.lower(), name.lower().replace(".", "_"), *JSON_TEXT)

    def outcome(text: str | None) -> tuple[str | None, str | None, str | None]:
        """(path, body, other type that it declares) of a JSON object, as far as it has them."""
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return None, None, None
        if not isinstance(value, dict):
            return None, None, None
        declared = value.get("document_type")
        if declared not in (None, "") and plain(declared) != plain(name):
            return None, None, str(declared)
        return *(_text_in(value, names) or (None, None)), None

    @F.pandas_udf("path string, body string, other string")
    def outcomes(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outcome(x) for x in texts], columns=["path", "body", "other"], dtype=object)

    return outcomes


def parsed_documents(rows: DataFrame, raw: str, name: str = "USER.md") -> DataFrame:
    """F12 over a column: adds parsed (document, method, confidence, warnings).

    The first of these decides: an envelope, with or without its end; a JSON object that declares another type; one that holds
    the document under a known path; the marker that ends last; a heading of reasoning (no document); headings; list items.
    Only texts that begin like a JSON object are handed to Python, for its reading of JSON; all else is Spark's own.
    """
    text = trim_u(_unfenced(trim_u(F.coalesce(F.col(raw), F.lit("")))))
    rows = rows.withColumn("__text", text).withColumn("__json", _json_outcome(name)(F.when(F.col("__text").startswith("{"), F.col("__text"))))
    rows = rows.withColumn("__lines", F.split("__text", "\n"))
    lines = F.col("__lines")
    marks = F.coalesce(*[F.lit(None).cast("string")])
    place = lambda pattern: F.transform(lines, lambda x, i: F.when(x.rlike(_named(pattern, name)), i))
    marker = lambda x: F.coalesce(*[F.when(x.rlike(_named(p, name)), method) for method, p in MARKERS.items()], marks)
    rows = rows.withColumns({
        "__begin": F.array_min(place(ENVELOPE)), "__mark": F.array_max(F.transform(lines, lambda x, i: F.when(marker(x).isNotNull(), i))),
    })
    rows = rows.withColumn("__end", F.array_min(F.filter(place(ENVELOPE_END), lambda i: i > F.col("__begin"))))
    has = lambda pattern: F.exists(lines, lambda x: x.rlike(pattern))
    begin, end, mark = F.col("__begin"), F.col("__end"), F.col("__mark")
    method = (
        F.when(F.col("__text") == "", "none").when(begin.isNotNull(), "document_envelope_v1").when(F.col("__json.other").isNotNull(), "json_document_type_mismatch")
        .when(F.col("__json.path").isNotNull(), F.concat(F.lit("json:"), F.col("__json.path"))).when(mark.isNotNull(), marker(F.element_at(lines, mark + 1)))
        .when(has(REASONING), "reasoning_only").when(has(STRUCTURED), "structured_markdown_fallback").when(has(LISTED), "list_fallback").otherwise("unrecognized")
    )
    rows = rows.withColumn("__method", method)
    upto = F.coalesce(end, F.size(lines))
    cut = lambda a, b: F.array_join(F.slice(lines, a + 1, F.greatest(F.lit(0), b - a)), "\n")
    kind = F.col("__method")
    open_ended = (kind == "document_envelope_v1") & end.isNull()
    body = (
        F.when(kind == "document_envelope_v1", cut(begin + 1, upto)).when(kind.startswith("json:"), F.col("__json.body")).when(kind.isin(*MARKERS), cut(mark + 1, F.size(lines)))
        .when(kind.isin("structured_markdown_fallback", "list_fallback"), F.col("__text"))
    )
    sure = F.when(open_ended, CONFIDENCE["unterminated"]).when(kind.startswith("json:"), CONFIDENCE["json"]).when(kind.isin(*MARKERS), CONFIDENCE["marker"])
    for fixed in ("document_envelope_v1", "structured_markdown_fallback", "list_fallback"):
        sure = sure.when(kind == fixed, CONFIDENCE[fixed])
    said = F.when(open_ended, WARNINGS["unterminated"]).when(kind == "json_document_type_mismatch", F.concat(F.lit("JSON 声明的文档类型为 "), F.col("__json.other"), F.lit(f"，预期为 {name}")))
    for fixed in ("reasoning_only", "structured_markdown_fallback", "list_fallback", "unrecognized"):
        said = said.when(kind == fixed, WARNINGS[fixed])
    parsed = F.struct(
        F.when(body.isNotNull(), memory_body(body, name)).alias("document"), kind.alias("method"), sure.otherwise(0.0).alias("confidence"), F.array_compact(F.array(said)).alias("warnings"),
    )
    return rows.withColumn("parsed", parsed).drop("__text", "__json", "__lines", "__begin", "__end", "__mark", "__method")

"""Column functions built from Spark's own; nulls and empty strings count as the same where text is compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import INELIGIBLE, RUNTIME_FAILED, SUCCESS


#: The characters that Java's Unicode white space class matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_u(c: Column) -> Column:
    """Trims white space at both ends, that beyond ASCII included; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.when(trim_u(c) != "", trim_u(c))


def squeeze(c: Column) -> Column:
    """runs of white space become one space, ends trimmed."""
    return trim_u(F.regexp_replace(c, r"(?U)\s+", " "))


def eligible() -> Column:
    """An explicit flag wins, else the status must not be one of the failures."""
    status = F.coalesce(F.col("evaluation_status"), F.lit(""))
    return F.coalesce(F.col("score_eligible"), ~status.isin(*INELIGIBLE))


def effective_status() -> Column:
    """P2."""
    return F.coalesce(blank_to_null(F.col("evaluation_status")), F.when(eligible(), SUCCESS).otherwise(RUNTIME_FAILED))


# Markers of failed judge calls, in the order in which they are looked for.
PARSE_MARKERS = ("不是可解析 json", "无法解析", "json 解析", "json解析", "json decode", "jsondecode", "不符合评分格式", "missing required", "schema validation")
API_MARKERS = (
    "api error", "qps limit", "rate limit", "too many requests", "connection idle timeout", "idle timeout", "websocket",
    "connection reset", "connection aborted", "going away", "timed out", "timeout", "request error", "requestexception",
    "http error", "status code", "429", "502", "503", "504",
)
FAILURE_KINDS = (
    ("rate_limit", ("qps limit", "rate limit", "too many requests", "429")),
    ("idle_timeout", ("connection idle timeout", "idle timeout")),
    ("timeout", ("timeout", "timed out")),
    ("connection", ("websocket", "connection reset", "connection aborted", "going away")),
    ("json_parse", ("json", "parse", "解析")),
    ("empty_response", ("empty", "为空", "no content")),
    ("schema", ("required", "missing field", "字段")),
    ("api_error", ("api error", "http", "status code")),
)


def _has_any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def failure_status(message: Column) -> Column:
    """Status of a failed judge call; parse markers are looked for before those of the interface."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.when(_has_any(text, PARSE_MARKERS), "judge_parse_failed").when(_has_any(text, API_MARKERS), "judge_api_failed").otherwise("judge_runtime_failed")


def failure_kind(message: Column) -> Column:
    """One of nine kinds, the first that fits."""
    text, kind = F.lower(F.coalesce(message, F.lit(""))), None
    for name, markers in FAILURE_KINDS:
        kind = F.when(_has_any(text, markers), name) if kind is None else kind.when(_has_any(text, markers), name)
    return kind.otherwise("unknown")


def shorten(c: Column, limit: int, mark: str = "...") -> Column:
    """The first ``limit`` characters and a mark, if there are more."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def head_and_tail(c: Column, limit: int, mark: str = "\n...\n") -> Column:
    """55 % of the limit from the front, a mark, the rest from the end."""
    head = int(limit * 0.55)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(limit - head)))).otherwise(c)


def preview(c: Column, limit: int = 120) -> Column:
    """Line ends become spaces, then shortened."""
    return shorten(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "), limit)


def jaccard(a: Column, b: Column) -> Column:
    """SO2: of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def precision_recall_f1(found: Column, expected: Column) -> tuple[Column, Column, Column]:
    """SO3: of two arrays as sets; all 1 if both are empty."""
    a, b = F.array_distinct(found), F.array_distinct(expected)
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    empty = (n == 0) & (m == 0)
    p = F.when(empty, 1.0).when(n == 0, 0.0).otherwise(both / n)
    r = F.when(empty, 1.0).when(m == 0, 0.0).otherwise(both / m)
    f1 = F.when(empty, 1.0).when(n + m == 0, 0.0).otherwise(2.0 * both / (n + m))
    return p, r, f1


def output_text(c: Column) -> Column:
    """line ends unified, each line's end and the whole trimmed."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return trim_u(F.regexp_replace(text, r"(?m)[ \t]+$", ""))


def canonical_id(c: Column) -> Column:
    """'1.0' and '1' are the same id; nan is none."""
    text = trim_u(F.coalesce(c.cast("string"), F.lit("")))
    whole = F.regexp_extract(text, r"^(-?\d+)\.0+$", 1)
    return F.when(F.lower(text).isin("nan", "none", "null"), "").when(whole != "", whole).otherwise(text)


def source_key(task: Column, reviewer: Column, session: Column, chunk: Column, begin: Column, end: Column) -> Column:
    """F16: the key under which the same source chunk is found in two runs."""
    parts = [F.coalesce(task, F.lit("")), F.coalesce(blank_to_null(reviewer), F.lit("unknown_reviewer")), F.coalesce(blank_to_null(session), F.lit("unknown_session"))]
    parts += [F.coalesce(c.cast("string"), F.lit("")) for c in (chunk, begin, end)]
    return F.concat_ws("|", *parts)


def weighted_total(dims: Column, weights: dict[str, int]) -> Column:
    """thousandths of the weighted total; dimensions are tenths, clamped to 0 .. 50, missing ones 0."""
    total = F.lit(0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.greatest(F.lit(0), F.least(F.lit(50), F.coalesce(F.element_at(dims, F.lit(name)), F.lit(0))))
    return total.cast("long")


def stable_swap(key: Column) -> Column:
    """whether A and B change places, by the lowest bit of the first byte of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 2, 1), 16, 10).cast("int") % 2 == 1


def rule_ids(text: Column) -> Column:
    """F8: distinct rule numbers (R and digits) in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(R\d+)\b"), 1))


def headings(text: Column, limit: int = 80, width: int = 120) -> Column:
    """F32: distinct heading lines, cut to ``width``, the first ``limit``."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), trim_u)
    lines = F.filter(lines, lambda line: line.startswith("#"))
    return F.slice(F.array_distinct(F.transform(lines, lambda line: F.substring(line, 1, width))), 1, limit)


def safe_name(c: Column) -> Column:
    """everything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(trim_u(c), r"[^\p{L}\p{N}._-]+", "_")


def backoff_seconds(attempt: Column, rate_limited: Column, qps: Column, configured: Column) -> Column:
    """wait before the next attempt."""
    power = F.pow(F.lit(2.0), attempt)
    return F.when(rate_limited, F.greatest(configured, F.when(qps > 0, 1.0 / qps + 1.0).otherwise(power))).otherwise(power)


def map_cell(m: Column) -> Column:
    """sorted name=value pairs in one cell."""
    pairs = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "；")


def list_cell(a: Column) -> Column:
    """a sorted set in one cell."""
    return F.array_join(F.array_sort(F.array_distinct(a)), "、")

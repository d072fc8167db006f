"""Canonical JSON (sorted keys, no spaces, characters beyond ASCII kept) and the hashes that are taken of it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The escapes of JSON; other characters below space are written by their number.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
ESCAPES |= {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in ESCAPES}


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    out = text
    for char, escape in ESCAPES.items():  # the backslash first
        out = F.replace(out, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text), F.lit('"'))


def json_double(x: Column) -> Column:
    """A double with the fewest digits that tell it, by powers of ten only below 1e-4 and from 1e16 on."""
    forms = F.array(*[F.format_string(f"%.{n}e", F.abs(x)) for n in range(17)])
    found = F.try_element_at(F.filter(forms, lambda f: f.try_cast("double") == F.abs(x)), F.lit(1))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(found, r"^([\d.]+)e", 1), r"\.", ""), r"(?<=\d)0+$", "")
    power = F.regexp_extract(found, r"e([+-]\d+)$", 1).try_cast("int")
    n = F.length(digits)
    large = F.when(n > power + 1, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n))).otherwise(F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    powered = F.concat(mantissa, F.regexp_extract(found, r"(e[+-]\d+)$", 1))
    text = F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(powered)
    plain = x.cast("string")
    return F.when(plain.isin("NaN", "Infinity", "-Infinity"), plain).otherwise(F.concat(F.when(plain.startswith("-"), "-").otherwise(""), text))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """canonical JSON of a column of any nesting of structs, arrays, maps with text keys, texts, numbers and booleans, in Spark's own expressions.

    Struct fields and map keys stand in the order of their code points; null is null.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("k"), F.concat(json_string(k), F.lit(":"), canonical_json(F.element_at(value, k), kind.valueType)).alias("t"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["t"]), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = json_double(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    else:
        text = json_string(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


@F.pandas_udf(T.StringType())
def _sorted_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def canonical_json_text(text: Column, empty: str = "{}") -> Column:
    """F4 of JSON that is a text of any shape; ``empty`` where there is none.  Only texts that hold something go to Python, for its numbers."""
    some = ~F.coalesce(F.trim(text), F.lit("")).isin("", "null", "{}", "[]")
    return F.when(some, _sorted_json(F.when(some, text))).otherwise(F.lit(empty))


def hash_payload(text: Column) -> Column:
    return F.sha2(text, 256)


def _object(parts: dict[str, Column]) -> Column:
    """A JSON object of values that are JSON already."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]), F.lit("}"))


def case_input_hash(rows: DataFrame) -> Column:
    """hash of all of a case that a judge's decision can depend on; its id, model and prompt version are not among it.

    ``rows`` has task_type, old_memory, instructions, candidate_output, reference_output, reasoning (texts, null is empty), session_id (null stays
    null), turn_range (array of int) and dialogue (array of struct role, content, metadata: a struct or map, or canonical JSON as text).
    """
    text = lambda c: json_string(F.coalesce(F.col(c), F.lit("")))
    kind = rows.schema["dialogue"].dataType.elementType["metadata"].dataType
    about = lambda t: F.coalesce(t["metadata"] if isinstance(kind, T.StringType) else F.when(t["metadata"].isNotNull(), canonical_json(t["metadata"], kind)), F.lit("{}"))
    turns = F.transform("dialogue", lambda t: _object({"role": json_string(t["role"]), "content": json_string(t["content"]), "metadata": about(t)}))
    parts = {c: text(c) for c in ("task_type", "old_memory", "instructions", "candidate_output", "reference_output", "reasoning")}
    parts |= {
        "session_id": F.coalesce(json_string(F.col("session_id")), F.lit("null")),
        "turn_range": canonical_json(F.coalesce(F.col("turn_range"), F.array().cast("array<int>")), rows.schema["turn_range"].dataType),
        "dialogue": F.concat(F.lit("["), F.coalesce(F.array_join(turns, ","), F.lit("")), F.lit("]")),
    }
    return hash_payload(_object(parts))


def evaluation_fingerprint(case_hash: Column, config_hash: Column) -> Column:
    """hash of a case's hash and of the hash of the scoring's configuration."""
    text = lambda c: json_string(F.coalesce(c, F.lit("")))
    return hash_payload(_object({"case_input_hash": text(case_hash), "scoring_config_hash": text(config_hash)}))


def config_hash(config: Column, kind: T.StructType) -> Column:
    """hash of a configuration, a struct of any fields."""
    return hash_payload(canonical_json(config, kind))


def prompt_hash(text: Column) -> Column:
    """SHA-1 of a prompt, nothing for none."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.sha1(text))

"""Readers and writers: journals of JSON lines, JSON, result tables, markdown cases, spreadsheets."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import trim_u


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, tolerate_tail: bool = True) -> DataFrame:
    """Typed rows of JSON lines with ``file`` and ``line_ix``; blank lines are skipped, unknown fields dropped.

    A broken last line of a file (an append that was cut off) is left out; any other broken line raises.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_ix"), F.regexp_replace("value", "^﻿", "").alias("value"))
    rows = raw.where(trim_u(F.col("value")) != "").withColumn("ok", F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    # a large file's splits may lie in any partition, so the last line is that of the last block
    last = rows.groupBy("file").agg(F.max_by("line_ix", F.struct("block", "line_ix")).alias("last_ix"))
    rows = rows.join(last, "file") if tolerate_tail else rows.withColumn("last_ix", F.lit(-1))
    rows = rows.where(F.col("ok") | (F.col("line_ix") != F.col("last_ix")))
    checked = F.when(F.col("ok"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))).cast("string"))
    return rows.select("file", "line_ix", F.from_json(checked, schema).alias("row")).select("file", "line_ix", "row.*")


# The types of a task.
TASK_TYPES = ("raw_dialogue", "user_md_update", "day_memory", "long_memory", "summary")


def read_cases(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed cases of JSON lines; a task type that is none raises, naming the file."""
    rows = read_jsonl(spark, path, schema)
    wrong = F.raise_error(F.concat(F.lit("not a task type: "), F.col("task_type"), F.lit(" in "), F.col("file"))).cast("string")
    return rows.withColumn("task_type", F.when(F.col("task_type").isNull() | F.col("task_type").isin(*TASK_TYPES), F.col("task_type")).otherwise(wrong))


def split_corrupt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, corrupt) lines of JSON files."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")
    good = F.try_parse_json("value").isNotNull()
    return raw.where(good), raw.where(~good)


def read_json(spark: SparkSession, path: str, schema: T.StructType, task_type: str) -> DataFrame:
    """A JSON object or array per file, with a default task type."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("task_type", F.coalesce("task_type", F.lit(task_type))) if "task_type" in rows.columns else rows.withColumn("task_type", F.lit(task_type))


# What a result table must have, the columns that are kept as text, and those that hold lists with the mark that parts them.
RESULT_REQUIRED = ("case_id", "score_total")
RESULT_TEXTS = (
    "comment", "judge_model", "judge_prompt_version", "extraction_prompt_version", "extraction_prompt_hash", "judge_prompt_hash", "scoring_schema_version", "dimension_weights_version",
    "scoring_config_hash", "case_input_hash", "evaluation_fingerprint", "failure_type", "failure_message", "timestamp", "evaluation_status",
)
RESULT_LISTS = {"error_tags": "[,;]", "rule_refs": "[;]", "evidence_refs": "[;]", "output_refs": "[;]", "reasoning_refs": "[;]"}
TRUE_WORDS = ("1", "true", "yes", "y", "是", "1.0")


def _list_cell(c: Column, mark: str) -> Column:
    """A cell that holds a JSON array, or texts parted by a mark."""
    text = trim_u(c)
    parsed = F.try_variant_get(F.try_parse_json(F.when(text.startswith("["), text)), "$", "array<string>")
    parts = F.coalesce(parsed, F.split(text, mark))
    return F.filter(F.transform(parts, trim_u), lambda x: x != "")


def table_results(raw: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Rows of a result table (text columns, row_ix from 0) as results with ``problems``, what is wrong with the row (empty: nothing).

    ``score_<dimension>`` columns become the map ``dims`` (tenths), lists are JSON arrays or parted texts.  Columns that the table lacks are empty.
    """
    missing = sorted(set(RESULT_REQUIRED) - set(raw.columns))
    if missing and raw.columns:
        raise ValueError(f"columns are missing: {missing}")
    cell = lambda c: trim_u(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c in raw.columns else F.lit("")
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    have = [d for d in dimensions if f"score_{d}" in raw.columns]
    row = (F.col("row_ix") + 2).cast("string")
    wrong = lambda test, text: F.when(test, F.concat(F.lit("row "), row, F.lit(f": {text}")))
    no_id, no_score = cell("case_id") == "", (cell("case_id") != "") & number("score_total").isNull()
    readable = ~no_id & ~no_score
    problems = [wrong(no_id, "no case_id"), wrong(no_score, "score_total is not a number"), *[wrong(readable & (cell(f"score_{d}") != "") & number(f"score_{d}").isNull(), f"score_{d} is not a number") for d in have]]
    entries = F.array(*[F.struct(F.lit(d).alias("key"), F.round(number(f"score_{d}") * 10).cast("int").alias("value")) for d in have])
    dims = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())) if have else F.create_map().cast("map<string,int>")
    flag = lambda c: F.lower(cell(c)).isin(*TRUE_WORDS)
    named = lambda c, otherwise: F.when(cell(c) != "", cell(c)).otherwise(otherwise)
    return raw.select(
        "row_ix", cell("case_id").alias("case_id"), named("task_type", TASK_TYPES[1]).alias("task_type"), F.round(number("score_total") * 1000).cast("long").alias("score_milli"), dims.alias("dims"),
        *[_list_cell(cell(c), mark).alias(c) for c, mark in RESULT_LISTS.items()], flag("fatal_error").alias("fatal"), F.when(cell("score_eligible") != "", flag("score_eligible")).alias("score_eligible"),
        named("model_name", "unknown").alias("model_name"), named("prompt_version", "unknown").alias("prompt_version"), *[cell(c).alias(c) for c in RESULT_TEXTS], F.array_compact(F.array(*problems)).alias("problems"),
    )


def good_results(results: DataFrame, shown: int = 5) -> DataFrame:
    """The rows without problems; raises with the first problems and their number if there are any."""
    bad = results.where(F.size("problems") > 0).select("row_ix", F.posexplode("problems").alias("at", "problem"))
    first = [r.problem for r in bad.orderBy("row_ix", "at").limit(shown).collect()]
    if first:
        more = bad.count() - len(first)
        raise ValueError(f"rows that can't be read: {'; '.join(first)}" + (f"; and {more} more" if more else ""))
    return results.drop("problems", "row_ix")


def read_result_table(spark: SparkSession, path: str, dimensions: tuple[str, ...]) -> DataFrame:
    """Results with problems from a .csv, .jsonl or .xlsx table, by the path's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        # a quoted cell may hold line ends, so a file is read by one task; rows are numbered in their file's order
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("row_ix", F.monotonically_increasing_id())
    elif kind == "jsonl":
        lines = spark.read.text(path).where(trim_u(F.col("value")) != "").withColumn("row_ix", F.monotonically_increasing_id())
        cells = F.from_json(F.regexp_replace("value", "^\ufeff", ""), "map<string,string>")
        # scores stand under their own names or inside one object
        inside = F.from_json(F.try_element_at("c", F.lit("scores")), "map<string,string>")
        names = sorted({*RESULT_REQUIRED, "task_type", "model_name", "prompt_version", "fatal_error", "score_eligible", *RESULT_LISTS, *RESULT_TEXTS})
        plain = [F.try_element_at("c", F.lit(n)).alias(n) for n in names]
        scores = [F.coalesce(F.try_element_at("c", F.lit(f"score_{d}")), F.try_element_at(inside, F.lit(d))).alias(f"score_{d}") for d in dimensions]
        raw = lines.withColumn("c", cells).select("row_ix", *plain, *scores)
    elif kind == "xlsx":
        sheet = read_spreadsheets(spark, path)
        headers = [r[0] for r in sheet.where("row_ix = 0").select(F.explode(F.map_keys("cells"))).distinct().collect()]
        raw = sheet.select("row_ix", *[F.try_element_at("cells", F.lit(h)).alias(h) for h in headers])
    else:
        raise ValueError(f"not a result table: {path}")
    return table_results(raw, dimensions)


def read_results_csv(spark: SparkSession, path: str, dimensions: tuple[str, ...]) -> DataFrame:
    """The results of a CSV table; raises if rows can't be read."""
    return good_results(read_result_table(spark, path, dimensions))


_CASE_FILES = ("old_user.md", "dialogue.md", "new_user.md")


def read_markdown_cases(spark: SparkSession, root: str) -> DataFrame:
    """One row per directory that has old_user.md, dialogue.md and new_user.md; dialogue as an array of turns."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    cases = files.select(folder.alias("case_id"), name.alias("name"), "value").groupBy("case_id").pivot("name", list(_CASE_FILES)).agg(F.first("value"))
    lines = F.filter(F.split(F.col("`dialogue.md`"), r"\r?\n"), lambda x: F.trim(x) != "")
    turn = r"^\s*-\s*(user|assistant)\s*[:：]\s*(.*)$"
    bad = F.filter(lines, lambda x: ~x.rlike(turn))
    checked = F.when(F.size(bad) == 0, lines).otherwise(F.raise_error(F.concat(F.lit("not a dialogue line: "), F.element_at(bad, 1))).cast("array<string>"))
    turns = F.transform(checked, lambda x: F.struct(F.regexp_extract(x, turn, 1).alias("role"), F.regexp_extract(x, turn, 2).alias("content")))
    complete = F.col("`old_user.md`").isNotNull() & F.col("`dialogue.md`").isNotNull() & F.col("`new_user.md`").isNotNull()
    return cases.where(complete).select("case_id", F.col("`old_user.md`").alias("old_memory"), turns.alias("dialogue"), F.col("`new_user.md`").alias("candidate_output"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part that the workbook lists first; without a list that of the smallest number."""
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheet = next(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"), None)
        for link in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            if sheet is not None and link.get("Id") == sheet.get(_REL):
                target = link.get("Target", "").lstrip("/")
                return target if target.startswith("xl/") else f"xl/{target}"
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def _rows_of(z: zipfile.ZipFile, part: str) -> Iterator[ET.Element]:
    """The sheet's row elements one by one; each is emptied once read, so no tree of the whole sheet is held."""
    with z.open(part) as stream:
        for _, element in ET.iterparse(stream):
            if element.tag == f"{{{_NS['m']}}}row":
                yield element
                element.clear()


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Cell texts of the first sheet of an .xlsx file, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        for row in _rows_of(z, _first_sheet(z)):
            cells: dict[int, str] = {}
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                value, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif value is None or value.text is None:
                    text = ""
                elif kind == "s":
                    text = shared[int(value.text)]
                elif kind == "b":
                    text = "true" if value.text == "1" else "false"
                else:
                    text = value.text
                cells[at] = text
            yield [cells.get(i, "") for i in range(1, max(cells, default=0) + 1)]


#: Rows of a sheet that are handed on together.
SHEET_ROWS = 4096


def read_spreadsheets(spark: SparkSession, path: str) -> DataFrame:
    """S3: rows of .xlsx files, one task per file: file, row_ix, cells (map of header to text)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = sheet_rows(content)
                header, held = next(rows, []), []
                for i, row in enumerate(rows):  # a sheet is never held whole
                    held.append((name, i, dict(zip(header, row, strict=False))))
                    if len(held) == SHEET_ROWS:
                        yield pd.DataFrame(held, columns=["file", "row_ix", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["file", "row_ix", "cells"])

    return files.mapInPandas(run, "file string, row_ix long, cells map<string,string>")


# What headers may be called, in order of preference.
ALIASES = {
    "case_id": ("case_id", "case id", "用例id", "case标识", "case", "case_no", "编号", "case number"),
    "session_id": ("session_id", "session", "对话id", "会话id", "会话"),
    "old_memory": ("old_memory", "旧user.md", "旧画像", "user.md_old", "原始user.md", "旧memory", "old user", "old_user_md", "原始记忆"),
    "dialogue": ("dialogue", "对话记录", "对话内容", "对话"),
    "candidate_output": ("candidate_output", "新user.md", "候选输出", "new_user.md", "new_user_md", "模型输出", "generated", "生成结果"),
    "reference_output": ("reference_output", "参考答案", "gold输出", "标注答案", "reference", "ground_truth", "gold", "人工标注"),
    "model_name": ("model_name", "模型", "模型名称", "model"),
    "prompt_version": ("prompt_version", "prompt版本", "版本", "version", "prompt"),
    "reasoning": ("reasoning", "reason", "推理", "思考过程", "分析过程", "模型reasoning"),
}
TURN_ALIASES = {
    "query": ("query", "user", "提问", "用户", "user_input", "问题"),
    "answer": ("answer", "assistant", "回答", "助手", "assistant_output", "回复"),
}


def resolve_headers(headers: list[str]) -> dict[str, str]:
    """S3: canonical name -> header.

    A header means the first name, in the order of ALIASES, of which an alias is part of it in lower case; only headers
    that mean none of these may be a query or an answer.  Of headers that mean the same the last counts.
    """
    out: dict[str, str] = {}
    for header in headers:
        text = header.strip().lower()
        names = (name for table in (ALIASES, TURN_ALIASES) for name, words in table.items() if any(w in text for w in words))
        name = next(names, None)
        if name is not None:
            out[name] = header
    return out


def sheet_columns(rows: DataFrame, headers: list[str]) -> DataFrame:
    """S3: rows of :func:`read_spreadsheets` with the columns that their headers mean, as text."""
    return rows.select("file", "row_ix", *[F.coalesce(F.try_element_at("cells", F.lit(header)), F.lit("")).alias(name) for name, header in resolve_headers(headers).items()])


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; the job's committer makes the overwrite all or nothing."""
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """S11."""
    df.write.mode("append").json(path)


def write_split(df: DataFrame, path: str, order: str = "row_ix", part: str = "part", about: dict | None = None) -> DataFrame:
    """One folder per part with its rows in source order, and a manifest (part, rows, first, last, digest) that is committed last.

    Rows are dealt by ranges of their place, so no part is sorted in one task; files of a part follow each other by name.  The digest is the sum of
    row hashes, computed on what was written, so the manifest stands for files that can be read.  A run that fails leaves no manifest: the one of
    an earlier run goes first.  ``about`` (text values) becomes columns of the manifest.
    """
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    df.repartitionByRange(part, order).sortWithinPartitions(part, order).write.mode("overwrite").partitionBy(part).parquet(f"{path}/rows")
    back = spark.read.parquet(f"{path}/rows")
    columns = [F.col(f"`{c}`") for c in df.columns if c != part]
    manifest = back.groupBy(part).agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))
    manifest = manifest.select("*", *[F.lit(v).alias(k) for k, v in (about or {}).items()])
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def read_split(spark: SparkSession, path: str, part: str, name: str = "part") -> DataFrame:
    """The rows of one part; raises without a manifest, or if what is there is not what it says."""
    whole = spark.read.json(f"{path}/manifest")
    said = {str(r[name]): r.rows for r in whole.select(name, "rows").collect()}
    rows = spark.read.parquet(f"{path}/rows").where(F.col(name).cast("string") == part)
    if rows.count() != said.get(part, 0):
        raise ValueError(f"part {part} of {path} has not the {said.get(part, 0)} rows of its manifest")
    return rows.drop(name)


def cell_safe(c):
    """Text that fits a spreadsheet cell: no control characters, at most 32,767 characters."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, 32767)

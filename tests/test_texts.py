"""Text operators against the standard library, brute force and cases worked out by hand."""

import difflib
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions import canonical
from engram.operators import containment, diffs, documents, evidence, rules

LONG = "- kept\n\n  # USER.md\n- more  \n"


@pytest.mark.parametrize(("raw", "want"), [
    (None, (None, "none", 0.0, 0)), (" \n", (None, "none", 0.0, 0)), ("```\n\n```", (None, "none", 0.0, 0)),
    ("said\n <<<MEMORY_DOCUMENT_V1:USER.md>>> \nOutput:\n- a\n<<<END_MEMORY_DOCUMENT_V1>>>\nafter", ("- a", "document_envelope_v1", 1.0, 0)),
    ("<<<END_MEMORY_DOCUMENT_V1>>>\n<<<memory_document_v1:user.md>>>\n" + LONG, ("- kept\n\n  # USER.md\n- more", "document_envelope_v1", 0.9, 1)),
    ("<<<MEMORY_DOCUMENT_V1:MEMORY.md>>>\n- a", ("<<<MEMORY_DOCUMENT_V1:MEMORY.md>>>\n- a", "list_fallback", 0.7, 1)),
    ('{"document_type": "memory_md", "document": "x"}', (None, "json_document_type_mismatch", 0.0, 1)), ('{"document_type": "user md", "result": "- x"}', ("- x", "json:result", 0.98, 0)),
    ('```json\n{"user_md": "# USER.md\\n- x", "content": "no"}\n```', ("- x", "json:user_md", 0.98, 0)), ('{"data": {"response": {"answer": "- y"}}, "output": {"answer": "- z"}}', ("- y", "json:data.response.answer", 0.98, 0)),
    ('{"data": {"x": 1}, "output": {"answer": "- z"}, "result": 3}', ("- z", "json:output.answer", 0.98, 0)), ('{"other": "- x"}', (None, "unrecognized", 0.0, 1)), ('{"broken": \n# Output\n- x', ("- x", "output_heading", 0.97, 0)),
    ("USER.md\n- new", ("USER.md\n- new", "list_fallback", 0.7, 1)), ("# Output\n- a\n# USER.md\n- b", ("- b", "document_heading", 0.97, 0)), ("--- USER.md ---\n- a\n**输出**：\n- b", ("- b", "output_marker", 0.97, 0)),
    ("输出\n- a\n ---- user.md ----\n", ("", "document_separator", 0.97, 0)), ("# Output x\n- a", ("# Output x\n- a", "structured_markdown_fallback", 0.78, 1)), ("Output\r\n- a", ("- a", "list_fallback", 0.7, 1)),
    ("Reasoning: because\n- a", (None, "reasoning_only", 0.0, 1)), ("## 思考过程：\n# T", (None, "reasoning_only", 0.0, 1)), ("分析\n- a", (None, "reasoning_only", 0.0, 1)), ("分析师\n- a", ("分析师\n- a", "list_fallback", 0.7, 1)), ("Thinking\n- a", ("Thinking\n- a", "list_fallback", 0.7, 1)),
    ("第二分区 x", ("第二分区 x", "structured_markdown_fallback", 0.78, 1)), ("三、x", ("三、x", "structured_markdown_fallback", 0.78, 1)), ("2. x", ("2. x", "list_fallback", 0.7, 1)), ("1.x", (None, "unrecognized", 0.0, 1)), ("words", (None, "unrecognized", 0.0, 1)),
])
def test_parsed_document(spark, raw, want):
    row = documents.parsed_documents(spark.createDataFrame([(raw,)], "raw string"), "raw").select("parsed.*").head()
    assert (row.document, row.method, row.confidence, len(row.warnings)) == want


def test_long_documents_and_other_names(spark):
    text = "Reasoning\n" + "x " * 100_000 + "\n# MEMORY.md\n- " + "y" * 100_000
    row = documents.parsed_documents(spark.createDataFrame([(text,)], "raw string"), "raw", "MEMORY.md").select("parsed.*").head()
    assert row.method == "document_heading" and row.document == "- " + "y" * 100_000
    assert documents.parsed_documents(spark.createDataFrame([], "raw string"), "raw").collect() == []


def test_line_diff_equals_the_standard_library(spark):
    rng = random.Random(5)
    rows = [(None, None), ("", ""), ("", "a"), ("a\n", "a"), ("a\r\nb\x0bc d", "b\nc"), ("a\nb\nc\nb", "b\na\nc"), ("# H\nx", "# H\n # H \n#H\nx\nx")]
    for _ in range(120):
        old = [rng.choice(["", "a", "b", "# head", f"line {rng.randrange(30)}"]) for _ in range(rng.randrange(60))]
        new = list(old)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = rng.choices(["b", "new", f"line {rng.randrange(30)}"], k=rng.randrange(3))
        if rng.random() < 0.3:
            rng.shuffle(new)
        rows.append(("\n".join(old), "\n".join(new)))
    rows.append(("\n".join(["same"] * 300 + ["x"]), "\n".join(["y", *["same"] * 280])))
    got = {r.k: r.diff for r in diffs.line_diff(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, o string, n string"), "o", "n", "was", "is").collect()}
    for i, (old, new) in enumerate(rows):
        old, new = old or "", new or ""
        a, b = old.splitlines(), new.splitlines()
        ops = difflib.SequenceMatcher(a=a, b=b).get_opcodes()
        d = got[i]
        assert [tuple(o) for o in d.ops] == ops
        assert (d.added, d.removed) == (sum(o[4] - o[3] for o in ops if o[0] in ("insert", "replace")), sum(o[2] - o[1] for o in ops if o[0] in ("delete", "replace")))
        assert d.text == "\n".join(difflib.unified_diff(a, b, "was", "is", lineterm=""))
        assert d.growth == ((len(new) - len(old)) / len(old) if old else float(bool(new)))
        heads = [x.strip() for x in b if x.lstrip().startswith("#")]
        assert d.repeated_headings == sorted({h for h in heads if heads.count(h) > 1}) and d.new_hash == hashlib.sha256(new.encode()).hexdigest()


@pytest.mark.parametrize("part", [10_000, 3])
def test_contained_texts_are_those_of_all_pairs(spark, part):
    rng = random.Random(7)
    words = ["记录", "规则", "记录规则", "a", "ab", "b", "边界", "x1", "过滤"]
    texts = {"".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in range(300)} | {"记录", "记", "abab", "lonely text"}
    one, two = sorted(texts)[::2], sorted(texts)[1::3] + ["记录规则边界", "b"]
    frame = lambda values: spark.createDataFrame([(v,) for v in [*values, ""]], "t string")
    got = [tuple(r) for r in containment.contained(frame(one), frame(two), part=part).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in one for y in two if x in y}


def test_evidence_finds_sections_by_either_text(spark):
    found = spark.createDataFrame([("e1", 1, 0, "《记录 规则》", "c"), ("e1", 1, 1, "边界", "c"), ("e2", 0, 0, None, "n"), ("e3", 2, 0, "R1: Keep, names!", "d"), ("e4", 3, 0, "keep", "e")], "evidence_id string, ix int, ref_ix int, ref string, comment string")
    sections = spark.createDataFrame([("S1", 1, "## 记录"), ("S2", 2, "记录规则与边界"), ("S3", 3, "keep names"), ("S4", 4, "--")], "section_id string, place int, title string")
    assert {tuple(r) for r in evidence.sections_for_evidence(found, sections).collect()} == {("e1", "S1"), ("e1", "S2"), ("e3", "S3"), ("e4", "S3")}
    assert [tuple(r) for r in evidence.local_intents(found, sections, 3).orderBy("intent_id").collect()] == [("L001", "S1", "e1", "c"), ("L002", "S2", "e1", "c"), ("L003", "S3", "e3", "d")]


@pytest.mark.parametrize(("ref", "exists", "stands"), [
    ("【R3 merge】", True, False), ("'R3 merge'", True, True), ("R3  merge。", True, False), ("see 「R3 merge」 or “R1”", True, False), ("R1/R3 merge", True, True), ("R1 / R9", False, False), ("see 「R9」", False, False), ("", False, True), (None, False, True),
])
def test_references(spark, ref, exists, stands):
    row = spark.createDataFrame([(ref, "# P\nR1 keep\nR3 merge")], "r string, p string").select(rules.reference_exists(F.col("r"), F.col("p")).alias("a"), rules.reference_stands(F.col("r"), F.col("p")).alias("b")).head()
    assert tuple(row) == (exists, stands)


def test_canonical_json_equals_the_standard_library(spark):
    dumps = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    kind = "s string, d double, l long, b boolean, a array<double>, m map<string,array<string>>, n struct<z:int,A:string,`é`:boolean>"
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-5, 1.5e-7, 1e-4, 0.001, 123456789.0, 1e15, 1e16, 1.25e22, 5e-324, 1.7976931348623157e308, -2.5e-10, 9007199254740993.0, 12345678.9, 1e7, float("inf"), float("-inf")]
    values = [{"s": t, "d": x, "l": -7, "b": True, "a": [x, None, 2.5], "m": {"b": ["x", None], "a": [], "ü\"": [t]}, "n": {"z": None, "A": t, "é": False}} for t, x in zip(["", 'q"\\/', "a\nb\t\r\b\f\x00\x1f\x7f", "é漢\U0001f600 "] * 5, numbers, strict=True)]
    values.append({"s": None, "d": None, "l": None, "b": None, "a": None, "m": None, "n": None})
    table = spark.createDataFrame(values, kind)
    whole = F.struct(*table.columns)
    got = [r[0] for r in table.select(canonical.canonical_json(whole, T.StructType(table.schema.fields))).collect()]
    assert got == [dumps(v) for v in values]
    texts = ['{"b": 1.0, "a": [1e5, {"d": null, "c": "é"}], "a": 12345678901234567890123}', "{}", None, "", " null ", '{"x": {}}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical_json_text(F.col("t"))).collect()]
    assert got == [dumps(json.loads(texts[0])), "{}", "{}", "{}", "{}", '{"x":{}}']


def test_case_hash_covers_what_a_judge_sees(spark):
    kind = "case_id string, task_type string, session_id string, old_memory string, instructions string, candidate_output string, reference_output string, reasoning string, turn_range array<int>, dialogue array<struct<role:string,content:string,metadata:map<string,string>>>"
    base = ["c1", "user_md", None, "- a\n", None, "out", "", "why", [1, 2], [("user", "hi \"x\"", {"b": "1", "a": "2"}), ("assistant", "é", None)]]
    payload = {
        "task_type": "user_md", "session_id": None, "old_memory": "- a\n", "dialogue": [{"role": "user", "content": 'hi "x"', "metadata": {"a": "2", "b": "1"}}, {"role": "assistant", "content": "é", "metadata": {}}],
        "instructions": "", "turn_range": [1, 2], "candidate_output": "out", "reference_output": "", "reasoning": "why",
    }
    other, turn = ["c2", *base[1:]], [*base[:9], [("user", "hi \"x\"", {"b": "1", "a": "3"}), ("assistant", "é", None)]]
    rows = spark.createDataFrame([base, other, turn], kind)
    a, b, c = (r[0] for r in rows.select(canonical.case_input_hash(rows)).collect())
    assert a == b == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() and c != a
    finger = rows.limit(1).select(canonical.evaluation_fingerprint(F.lit("x"), F.lit(None).cast("string")), canonical.prompt_hash(F.lit("p")), canonical.prompt_hash(F.lit(""))).head()
    assert tuple(finger) == (hashlib.sha256(b'{"case_input_hash":"x","scoring_config_hash":""}').hexdigest(), hashlib.sha1(b"p").hexdigest(), "")


def test_frequent_lines_of_long_texts_are_aligned_too(spark):
    old = "\n".join(["same"] * 210)
    rows = spark.createDataFrame([(1, old, old + "\nmore"), (2, "\n".join(f"{i % 7}" for i in range(250)), "\n".join(f"{i % 7}" for i in range(7, 257)))], "id long, old string, new string")
    got = {r.id: (r.added, r.removed) for r in diffs.line_diff(rows, "old", "new", frequent=True).select("id", "diff.added", "diff.removed").collect()}
    assert got[1] == (1, 0) and got[2][0] == got[2][1] < 250


def test_local_intents_meet_no_more_rows_than_it_takes(spark, monkeypatch):
    met = []
    whole = evidence.containing_pairs
    monkeypatch.setattr(evidence, "containing_pairs", lambda left, *rest: (met.append(left.count()), whole(left, *rest))[1])
    sections = spark.range(300).select(F.col("id").alias("section_id"), F.concat(F.lit("part "), (F.col("id") % 3).cast("string")).alias("title"), (-F.col("id")).alias("place"))
    rows = lambda step: spark.range(2000).select(F.col("id").alias("evidence_id"), F.col("id").alias("ix"), F.lit(0).alias("ref_ix"), F.when(F.col("id") % step == step - 1, "Part-1").otherwise("none").alias("ref"), F.lit("c").alias("comment"))
    # by hand: the first matching row alone has 100 sections of title "part 1", the last of them first
    for step in (2, 700):
        got = [(r.intent_id, r.section_id, r.evidence_id) for r in evidence.local_intents(rows(step), sections, 5).orderBy("intent_id").collect()]
        assert got == [(f"L{i + 1:03d}", 298 - 3 * i, step - 1) for i in range(5)]
    assert met[0] < 10 and max(met) <= 1300
    found = [(r.section_id, r.evidence_id) for r in evidence.local_intents(rows(700), sections, 250).orderBy("intent_id").collect()]
    assert len(found) == 200 and found[100] == (298, 1399)

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.sources import tables
from engram.streaming import events

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def test_jsonl_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "x", "v": 1, "extra": 2}\n\n{"k": "y", "v": 2}\n{"k": "z", ')
    assert sorted((r.k, r.v) for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), SCHEMA).collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "b.jsonl").write_text('{"k": "x"\n{"k": "y", "v": 2}\n')
    with pytest.raises(Exception, match="not a JSON object"):
        tables.read_jsonl(spark, str(tmp_path / "b.jsonl"), SCHEMA).collect()


def test_markdown_cases(spark, tmp_path):
    case = tmp_path / "case_1"
    case.mkdir()
    (case / "old_user.md").write_text("old")
    (case / "new_user.md").write_text("new")
    (case / "dialogue.md").write_text("- user: hi\n\n- assistant：yes\n")
    row = tables.read_markdown_cases(spark, str(tmp_path)).head()
    assert (row.case_id, row.old_memory, row.candidate_output) == ("case_1", "old", "new")
    assert [tuple(t) for t in row.dialogue] == [("user", "hi"), ("assistant", "yes")]


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Case_ID</t></si><si><t>query</t></si><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet10.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>other</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" r:id="r2"/><sheet name="y" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet10.xml"/><Relationship Id="r2" Target="worksheets/sheet1.xml"/></Relationships>')
    row = tables.read_spreadsheets(spark, str(tmp_path / "a.xlsx")).head()
    assert row.cells["Case_ID"] == "7" and row.cells["query"] == "hello"
    assert tables.resolve_headers(["Case_ID", "Session", "旧画像", "query", "answer", "模型输出", "模型", "版本"]) == {"case_id": "Case_ID", "session_id": "Session", "old_memory": "旧画像", "query": "query", "answer": "answer", "candidate_output": "模型输出", "model_name": "模型", "prompt_version": "版本"}


def test_csv_results_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text('case_id,score_total,score_correctness,error_tags\nc1,4.25,4.0,"a, b;c"\n')
    row = tables.read_results_csv(spark, str(tmp_path / "r.csv"), ("correctness", "coverage")).head()
    assert (row.score_milli, row.dims, row.error_tags) == (4250, {"correctness": 40}, ["a", "b", "c"])


def test_fold_keeps_last_parsed(spark):
    rows = spark.createDataFrame([(1, 1, "parsed", "A"), (1, 2, "empty", "x"), (1, 3, "parsed", "B"), (2, 1, "failed", "y")], "reviewer long, ix long, outcome string, document string")
    assert [x.holds for x in events.fold_documents(rows, "reviewer", "ix").orderBy("reviewer", "ix").collect()] == ["A", "A", "B", None]


def test_journal_upsert(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "k string, v int, ix int").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("k string, v int, ix int").parquet(str(src))
    events.journal_upsert(stream, ["k"], "ix", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    later = tmp_path / "more"
    spark.createDataFrame([("a", 9, 5), ("c", 4, 3), ("b", 0, 1)], "k string, v int, ix int").write.parquet(str(later))
    for part in later.glob("*.parquet"):
        part.rename(src / f"more-{part.name}")
    events.journal_upsert(stream, ["k"], "ix", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    events.compact_journal(spark, str(tmp_path / "out"), ["k"], "ix", str(tmp_path / "new"))
    for path in ("out", "new"):
        assert sorted((r.k, r.v) for r in events.read_journal(spark, str(tmp_path / path), ["k"], "ix").collect()) == [("a", 9), ("b", 3), ("c", 4)]


def test_stale_tasks(spark):
    rows = spark.createDataFrame([("running", 0), ("running", 900), ("done", 0)], "status string, at long").withColumn("heartbeat_at", F.timestamp_seconds("at"))
    assert [x.status for x in events.stale_tasks(rows, F.timestamp_seconds(F.lit(1000)), 300).collect()] == ["interrupted", "running", "done"]


def test_result_tables_tell_all_bad_rows(spark, tmp_path):
    rows = ["case_id,score_total,score_correctness,error_tags,rule_refs,fatal_error,model_name", 'c1,4.25,4.0,"a, b;c","[""R1"", "" R2 ""]",TRUE,m', ",1,,,,,", "c3,abc,x,,,,", "c4,2,x,,,,", 'c5,1,,"[bad",R1;R2,0,']
    (tmp_path / "r.csv").write_text("\n".join(rows) + "\n")
    found = tables.read_result_table(spark, str(tmp_path / "r.csv"), ("correctness", "coverage"))
    assert [list(r.problems) for r in found.orderBy("row_ix").collect()] == [[], ["row 3: no case_id"], ["row 4: score_total is not a number"], ["row 5: score_correctness is not a number"], []]
    good = {r.case_id: r for r in found.where(F.size("problems") == 0).collect()}
    assert (good["c1"].dims, good["c1"].error_tags, good["c1"].rule_refs, good["c1"].fatal, good["c1"].task_type, good["c1"].model_name) == ({"correctness": 40}, ["a", "b", "c"], ["R1", "R2"], True, "user_md_update", "m")
    assert (good["c5"].error_tags, good["c5"].rule_refs, good["c5"].fatal, good["c5"].model_name, good["c5"].score_milli) == (["[bad"], ["R1", "R2"], False, "unknown", 1000)
    with pytest.raises(ValueError, match="row 3: no case_id; row 4: score_total is not a number; row 5.*number$"):
        tables.good_results(found)
    with pytest.raises(ValueError, match="and 2 more"):
        tables.good_results(found, 1)
    (tmp_path / "r.jsonl").write_text('{"case_id": "j1", "score_total": 3.5, "scores": {"coverage": 2.5}, "error_tags": ["x"], "fatal_error": false}\n\n{"case_id": "j2"}\n')
    found = tables.read_result_table(spark, str(tmp_path / "r.jsonl"), ("correctness", "coverage")).orderBy("row_ix").collect()
    assert [(r.case_id, r.score_milli, r.dims, r.error_tags, len(r.problems)) for r in found] == [("j1", 3500, {"coverage": 25}, ["x"], 0), ("j2", None, {}, [], 1)]
    (tmp_path / "n.csv").write_text("case_id\nx\n")
    with pytest.raises(ValueError, match="score_total"):
        tables.read_result_table(spark, str(tmp_path / "n.csv"), ())


def test_split_keeps_order_and_commits_its_manifest_last(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("row_ix"), F.concat(F.lit("v"), F.col("id")).alias("v"), F.when(F.col("id") % 7 == 0, "validation").otherwise("discovery").alias("part"))
    said = {r.part: (r.rows, r.first, r.last, r.seed) for r in tables.write_split(rows, str(tmp_path / "s"), about={"seed": "x"}).collect()}
    assert said == {"validation": (143, 0, 994, "x"), "discovery": (857, 1, 999, "x")}
    for folder in (tmp_path / "s" / "rows").glob("part=*"):
        read = [r.row_ix for f in sorted(folder.glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert read == sorted(read) and len(read) == said[folder.name.split("=")[1]][0]
    assert tables.read_split(spark, str(tmp_path / "s"), "validation").count() == 143
    broken = rows.withColumn("v", F.when(F.col("row_ix") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        tables.write_split(broken, str(tmp_path / "s"))
    with pytest.raises(Exception, match="manifest"):
        tables.read_split(spark, str(tmp_path / "s"), "validation")


def _batches(spark, tmp_path, parts, schema, build):
    """Runs a stream over one file a micro-batch and returns all rows that it gave, in order of the batches."""
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (found,) = (tmp_path / f"p{i}").glob("*.parquet")
        found.rename(src / f"{i:03d}.parquet")
    out = []
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: out.extend((n, *r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_held_document_resets_with_the_segment(spark, tmp_path):
    from engram.streaming import stateful

    parts = [
        [(1, 0, 2, "parsed", "B"), (1, 0, 1, "parsed", "A"), (2, 0, 1, "failed", "x")],
        [(1, 0, 3, "empty", "y"), (2, 0, 2, "parsed", "C")],
        [(1, 1, 4, "unparsed", "z"), (2, 0, 3, "parsed", "D")],
        [(1, 1, 5, "parsed", "E"), (1, 0, 6, "parsed", "late")],
    ]
    got = _batches(spark, tmp_path, parts, "reviewer long, segment long, ix long, outcome string, document string", stateful.held_documents)
    assert sorted(got) == [(0, 1, 0, "B", 2), (0, 2, 0, None, 1), (1, 1, 0, "B", 3), (1, 2, 0, "C", 2), (2, 1, 1, None, 4), (2, 2, 0, "D", 3), (3, 1, 1, "E", 6)]


def test_tasks_without_heartbeat_are_interrupted_by_a_timer(spark, tmp_path):
    from engram.streaming import stateful

    parts = [[("a", "running", 1_000), ("b", "running", 1_000)], [("b", "running", 250_000), ("c", "done", 200_000)], [("b", "running", 400_000), ("z", "done", 500_000)], [("z", "done", 600_000)]]
    build = lambda s: stateful.task_fates(s.withColumn("ts", F.timestamp_millis("heartbeat_ms")).withWatermark("ts", "0 seconds"), 300, "EventTime")
    got = _batches(spark, tmp_path, parts, "task_id string, status string, heartbeat_ms long", build)
    last = {}
    for _, task, status, _ in got:
        last[task] = status
    assert last == {"a": "interrupted", "b": "running", "c": "done", "z": "done"}


def test_cases_of_unknown_type_raise(spark, tmp_path):
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("task_type", T.StringType())])
    (tmp_path / "c.jsonl").write_text('{"case_id": "1", "task_type": "summary"}\n{"case_id": "2"}\n')
    assert sorted((r.case_id, r.task_type) for r in tables.read_cases(spark, str(tmp_path / "c.jsonl"), schema).collect()) == [("1", "summary"), ("2", None)]
    (tmp_path / "d.jsonl").write_text('{"case_id": "1", "task_type": "poem"}\n')
    with pytest.raises(Exception, match="not a task type: poem"):
        tables.read_cases(spark, str(tmp_path / "d.jsonl"), schema).collect()

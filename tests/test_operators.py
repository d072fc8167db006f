"""Operators against small examples worked by hand."""

import random

import pytest
from pyspark.sql import functions as F

from engram.functions import columns as C
from engram.operators import compare, evidence, gate, results, sessions, stability, texts
from engram.schemas import DIMENSIONS, RESULT, WEIGHTS


def made(spark, rows):
    base = dict(ix=0, case_id="c", model_name="m", prompt_version="p", reviewer="", score_milli=0, dims={}, error_tags=[], n_diagnostics=0, fatal=False, evaluation_status="success", score_eligible=None, failure_message=None, output="")
    return spark.createDataFrame([tuple((base | {"ix": i} | r)[f.name] for f in RESULT) for i, r in enumerate(rows)], RESULT)


def test_stats_leave_failures_out(spark):
    r = made(spark, [dict(score_milli=4500), dict(score_milli=3000), dict(score_milli=1000, fatal=True), dict(score_milli=0, evaluation_status="judge_api_failed")])
    s = results.result_stats(r).head()
    assert (s.total, s.scored, s.judge_failures, s.fatal_count) == (4, 3, 1, 1)
    assert round(s.avg_score, 2) == 2.83 and round(s.fatal_rate, 3) == 0.333 and not s.run_complete
    assert results.result_stats(r.limit(0)).head().avg_score == 0.0


def test_explicit_flag_wins(spark):
    r = made(spark, [dict(score_eligible=True, evaluation_status="stopped"), dict(score_eligible=False)])
    assert [x.ok for x in r.orderBy("ix").select(C.eligible().alias("ok")).collect()] == [True, False]


def test_dimension_means(spark):
    r = made(spark, [dict(dims={"correctness": 50}), dict(dims={"correctness": 30, "format": 40})])
    assert {x.dimension: x.mean for x in results.dimension_means(r).collect()} == {"correctness": 4.0, "format": 4.0}
    assert {x.dimension: x.mean for x in results.dimension_means_zero_filled(r).collect()} == {"correctness": 4.0, "format": 2.0}


def test_run_quality_counts_quality_misses_as_zero(spark):
    r = made(spark, [dict(score_milli=4000), dict(evaluation_status="judge_api_failed")])
    missed = spark.createDataFrame([("success", "empty"), ("failed", "not_attempted"), ("not_attempted", "not_attempted")], "call_status string, parse_status string")
    q = results.run_quality(r, missed).head()
    assert (q.conditional_avg_score, q.judge_failures, q.quality_failures, q.infrastructure_failures, q.end_to_end_score, q.run_complete) == (4.0, 1, 1, 1, 2.0, False)


def test_last_write_keeps_first_position(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "k string, v int, ix int")
    assert sorted(map(tuple, results.last_writes(rows, ["k"]).select("k", "v", "position").collect())) == [("a", 3, 0), ("b", 2, 1)]


def test_failure_kinds(spark):
    rows = spark.createDataFrame([("QPS limit",), ("Connection idle timeout",), ("timed out",), ("going away",), ("json decode timeout",), ("输出为空",), (None,)], "m string")
    assert [x[0] for x in rows.select(C.failure_kind(F.col("m"))).collect()] == ["rate_limit", "idle_timeout", "timeout", "connection", "timeout", "empty_response", "unknown"]
    assert [x[0] for x in rows.limit(5).select(C.failure_status(F.col("m"))).collect()] == ["judge_api_failed"] * 4 + ["judge_parse_failed"]


def test_stability(spark):
    base = [dict(case_id="c1", score_milli=5000), dict(case_id="c2", score_milli=5000)]
    now = [dict(case_id="c1", score_milli=5000), dict(case_id="c2", score_milli=4500, error_tags=["missing_key_info"], n_diagnostics=1)]
    pairs = stability.pair_runs(made(spark, now), made(spark, base), ["case_id"])
    s = stability.stability_summary(pairs, stability.compare_pairs(pairs, DIMENSIONS)).head()
    assert (s.common, s.avg_abs_delta, s.tag_exact_rate, s.score_exact_rate, s.unstable) == (2, 0.25, 0.5, 0.5, 1)


def test_failed_side_is_a_failure_pair(spark):
    pairs = stability.pair_runs(made(spark, [dict(case_id="c")]), made(spark, [dict(case_id="c", evaluation_status="stopped")]), ["case_id"])
    s = stability.stability_summary(pairs, stability.compare_pairs(pairs, DIMENSIONS)).head()
    assert (s.matched, s.common, s.failure_pairs) == (1, 0, 1)


def test_verdicts(spark):
    a = made(spark, [dict(case_id="1", score_milli=4000, output="x"), dict(case_id="2", score_milli=4000, output="same \r\n"), dict(case_id="3"), dict(case_id="4", output="q"), dict(case_id="5"), dict(case_id="5")])
    b = made(spark, [dict(case_id="1", score_milli=4500, output="y"), dict(case_id="2", score_milli=4800, output="same"), dict(case_id="6"), dict(case_id="4", output="w", evaluation_status="judge_api_failed"), dict(case_id="5")])
    pairs = compare.pair_by_source(a, b, "case_id").withColumn("verdict", compare.verdict())
    assert dict(pairs.select("case_id", "verdict").collect()) == {"1": "B better", "2": "same output", "3": "A only", "6": "B only", "4": "not comparable"}
    assert {x.case_id for x in compare.duplicate_keys([a, b], "case_id").collect()} == {"5"}


def test_gate(spark):
    champion = made(spark, [dict(case_id=str(i), score_milli=4000, reviewer=f"r{i % 2}") for i in range(8)])
    candidate = made(spark, [dict(case_id=str(i), score_milli=4200) for i in range(8)])
    d = gate.paired_deltas(champion, candidate)
    assert gate.gate_decision(gate.gate_summary(d)).head().accepted
    ci = gate.bootstrap_interval(gate.cluster_means(d), "seed", samples=200).head()
    assert round(ci.point, 6) == round(ci.lower, 6) == 0.2
    worse = gate.paired_deltas(champion, made(spark, [dict(case_id=str(i), score_milli=3000, error_tags=["hallucination"]) for i in range(8)]))
    assert gate.gate_decision(gate.gate_summary(worse)).head().reasons == ["gain too small", "too many regressions", "new critical errors"]


def test_split(spark):
    assert gate.split_sizes(6) == (4, 1, 1) and gate.split_sizes(4, minimums=(1, 2, 1)) == (1, 2, 1)
    rows = spark.createDataFrame([(i, f"r{i % 6}") for i in range(24)], "row_ix int, reviewer string")
    out = gate.holdout_split(rows)
    assert out.count() == 24 and out.groupBy("reviewer").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


ROWS = "file long, row_ix long, turn_no string, query string, answer string, reviewer string, document string, raw_output string, reasoning string, status string, call_status string, parse_status string, case_status string"


def dialogue(spark, rows):
    return spark.createDataFrame([(0, i, t, f"q{i}", f"a{i}", who, doc, "", "", "", "", "", "") for i, (t, who, doc) in enumerate(rows, 1)], ROWS)


def test_chunks_and_inheritance(spark):
    rows = [("1", "alice", ""), ("2", "alice", "A"), ("3", "alice", "A2"), ("1", "alice", ""), ("2", "alice", "A3"), ("1", "bob", "B"), ("1", "alice", ""), ("2", "alice", "")]
    out = sessions.generate_cases(dialogue(spark, rows), 2).orderBy("row_start").collect()
    assert len(out) == 5
    assert [x.kind for x in out] == ["case"] * 4 + ["missed"]
    assert [x.old_document for x in out[:4]] == [None, "A", "A2", None]


def test_sequential_memory_resets(spark):
    rows = [("1", "alice", ""), ("2", "alice", "A1"), ("1", "alice", "A2"), ("1", "bob", "B1"), ("1", "alice", "A3")]
    out = sessions.generate_cases(dialogue(spark, rows), 2, memory="sequential").orderBy("row_start").collect()
    assert [x.old_document for x in out] == [None, "A1", None, None]


def test_triage_order(spark):
    r = made(spark, [dict(case_id="healthy", score_milli=5000), dict(case_id="low", score_milli=3500, error_tags=["x"]), dict(case_id="failed", evaluation_status="judge_api_failed", failure_message="timeout")])
    assert [x.case_id for x in evidence.triage(r).orderBy("position").collect()] == ["failed", "low"]


def test_judge_validation(spark):
    good = '{"score_total": 4, "scores": {' + ", ".join(f'"{d}": 5' for d in DIMENSIONS) + '}, "comment": "c", "fatal_error": false, "error_tags": []}'
    rows = spark.createDataFrame([(good,), ("[1]",), (good.replace("4,", '"4",', 1),), (good.replace("[]", '["nope"]'),), (None,)], "raw string")
    assert [x[0] for x in rows.select(evidence.judge_errors("raw", DIMENSIONS)).collect()] == [None, "not an object", "score_total is not a number", "unknown tag", "not an object"]


def test_text_functions(spark):
    one = spark.createDataFrame([("　## 1. “Keep  ＡＢＣ”。 ", "a  \r\nb\t", "1.0", {"x": 60, "correctness": 50, "format": 20})], "a string, b string, c string, d map<string,int>")
    r = one.select(texts.normalise_reference(F.col("a")).alias("a"), C.output_text(F.col("b")).alias("b"), C.canonical_id(F.col("c")).alias("c"), C.weighted_total(F.col("d"), WEIGHTS).alias("d")).head()
    assert tuple(r) == ("keep abc", "a\nb", "1", 1600)


def test_sections_and_patches(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny"), (2, "one\n\ntwo\nmore"), (3, None)], "id int, t string")
    got = [(x.id, x.section_id, x.level, x.title, x.body) for x in texts.sections(docs, "id", "t").orderBy("id", "section_id").collect()]
    assert got == [(1, "S001", 1, "A", "# A\nx"), (1, "S002", 2, "B", "## B\ny"), (2, "S001", 0, "one", "one"), (2, "S002", 0, "two", "two\nmore")]


def test_line_bag_diff(spark):
    old, new = (spark.createDataFrame([(1, t)], "k int, t string") for t in ("a\na\nb", "a\nb\nb\nc"))
    assert tuple(compare.line_bag_diff(old, new, "k", "t").head()) == (1, 2, 2, 1)


def test_the_registered_interval_uses_all_resamples(spark, monkeypatch):
    from engram.plans import queries

    clusters = spark.createDataFrame([(f"c{i}", i * i / 10) for i in range(7)], "cluster string, mean_delta double")
    monkeypatch.setattr(queries, "_deltas", lambda spark, d: None)
    monkeypatch.setattr(queries.gate, "cluster_means", lambda deltas: clusters)
    got = queries.q_bootstrap_ci(spark, "").head()
    every, fewer = (gate.bootstrap_interval(clusters, "validation", samples=n).head() for n in (2000, 500))
    assert list(got) == pytest.approx(list(every), abs=1e-6) and list(got) != pytest.approx(list(fewer), abs=1e-6)
    assert every.lower < every.point < every.upper


def same_rule(a, b):
    """What SURVEY says of two rule keys, for one pair."""
    from difflib import SequenceMatcher

    from engram.operators.prompts import NO_RECORD, RECORD

    n, m = sorted((len(a), len(b)))
    inside = a in b or b in a
    if n < 8 or inside or n < 14:
        return a == b if n < 8 else inside and n >= 12 and n / m >= 0.58
    kind = [("no" if any(w in k for w in NO_RECORD) else "yes" if any(w in k for w in RECORD) else "") for k in (a, b)]
    shares = []
    for size in (2, 1):
        x, y = ({k[i : i + size] for i in range(len(k) + 1 - size)} for k in (a, b))
        shares.append(len(x & y) / min(len(x), len(y)))
    return SequenceMatcher(None, a, b).ratio() >= 0.88 or (kind[0] != "" and kind[0] == kind[1] and shares[0] >= 0.6 and shares[1] >= 0.78)


def test_similar_rules_are_those_of_all_pairs(spark):
    from engram.operators import prompts

    rng = random.Random(3)
    base = ["必须记录用户明确说出的长期偏好和习惯", "不记录一次性的临时安排与当天行程", "keep every stable preference that the user states", "aaaaaaaaaaaaaaaaaaaaaaaa", "merge duplicate entries into a single line"]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = rng.choice("的用户abc偏好xyz")
        rows.append((i, f"g{i % 2}", f"- {''.join(words)}"))
    rows += [(900 + i, "g0", "短规则") for i in range(3)] + [(950, "g0", ""), (951, "g0", None)]
    table = spark.createDataFrame(rows, "id long, g string, t string")
    keys = {r.id: (r.g, r.k) for r in table.select("id", "g", prompts.rule_key(F.col("t")).alias("k")).collect() if r.k}
    want = {(a, b) for a in keys for b in keys if a < b and keys[a][0] == keys[b][0] and same_rule(keys[a][1], keys[b][1])}
    assert {(r.a, r.b) for r in prompts.similar_rules(table, "id", "g", "t").collect()} == want and len(want) > 100


def test_buckets_have_equal_shares_however_values_lie(spark):
    from engram.functions.ranks import number_buckets, positions

    rows = spark.range(40_000, numPartitions=4).select(F.monotonically_increasing_id().alias("v")).unionByName(spark.createDataFrame([(1 << 62,), (-5,), (None,)], "v long"))
    bucket = number_buckets(rows, "v")
    sizes = [r[1] for r in rows.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) > 200 and max(sizes) < 400
    got = [r.position for r in positions(rows, [bucket], [F.col("v")]).orderBy(F.col("v").asc_nulls_first()).collect()]
    assert got == list(range(1, 40_004))
    assert positions(rows.limit(0), [number_buckets(rows.limit(0), "v")], [F.col("v")]).collect() == []


def test_no_row_of_the_bootstrap_grows_with_the_clusters(spark):
    clusters = spark.range(3000).select(F.col("id").cast("string").alias("cluster"), (F.col("id") % 7).cast("double").alias("mean_delta"))
    got = gate.bootstrap_interval(clusters, "s", samples=100).head()
    assert got.lower < got.point < got.upper and got.point == pytest.approx(2.998, abs=0.01)

"""Plans and paths that keep work in proportion to the rows."""

import random

from pyspark.sql import functions as F

from engram.operators import containment, patches, prompts, rules


def test_a_judges_answer_is_read_in_few_steps(spark):
    raw = ['{"评估结果": {"总分": 3, "维度分": {"完整性": 2.5, "format": "1"}, "tags": "a，b c", "fatal": "yes", "reason": "r"}}', 'x {"result": [1], "score": "2", "errors": ["p", "q"], "update": 4}', '{"result": {}, "score": 1}', "no json", None]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")
    found = frame.select("k", F.struct(*[c.alias(n) for n, c in rules.judge_fields(F.col("raw")).items()]).alias("f"))
    rows = {r.k: r.f for r in found.collect()}
    assert (rows[0].score_total, rows[0].dims, rows[0].comment, rows[0].error_tags, rows[0].fatal) == (3.0, {"coverage": 2.5, "format": 1.0}, "r", ["a", "b", "c"], True)
    assert (rows[1].score_total, rows[1].dims, rows[1].error_tags, rows[1].fatal) == (2.0, {"update_logic": 4.0}, ["p", "q"], False)
    assert rows[2].score_total is None and rows[3].dims == {} and rows[4].error_tags == []
    # each name is read where it is needed, not once for each way that leads to it
    assert found._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") < 150


def test_small_groups_of_rules_are_compared_without_an_index(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(6, 40))) for _ in range(40)]
    texts += [t[:-2] + "zz" for t in texts[:20]] + [t + "g" for t in texts[:10]] + ["", "不应记录 这里的 所有 内容 甲乙丙丁", "不应记录 这里的 所有 内容 甲乙丙戊己"]
    rows = [(g, f"{g}-{i:03d}", rng.choice(texts)) for g in range(12) for i in range(20)] + [(None, "x", texts[0]), (None, "y", texts[0])]
    small = spark.createDataFrame(rows, "g int, id string, line string")
    large = small.withColumn("g", F.when(F.col("g") < 6, 0).otherwise(F.col("g")))
    for frame in (small, large):
        found = prompts.similar_rules(frame, "id", "g", "line")
        keyed = frame.select("g", "id", prompts.rule_key(F.col("line")).alias("k")).where("k <> ''")
        x, y = (keyed.select("g", F.col("id").alias(i), F.col("k").alias(f"k{i}")) for i in "ab")
        want = {tuple(r) for r in x.join(y, "g").where("a < b").where(prompts.same_rule("ka", "kb")).select("g", "a", "b").collect()}
        assert want and {tuple(r) for r in found.collect()} == want
    assert "gram" not in prompts.similar_rules(small, "id", "g", "line")._jdf.queryExecution().analyzed().toString()


def test_a_ratio_is_only_left_out_below_the_limit():
    import difflib

    rng = random.Random(4)
    for _ in range(2000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        b = "".join(rng.choice("abc") if rng.random() < 0.1 else c for c in a)[: rng.randrange(1, 40)]
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert prompts._ratio(a, b) in (ratio, 0.0) and (prompts._ratio(a, b) >= prompts.RATIO) == (ratio >= prompts.RATIO)


def test_no_prompts_or_edits_are_broadcast(spark):
    own = spark.range(5).select(F.col("id").alias("prompt_id"), F.lit("# A\n- x\n").alias("prompt"))
    edits = own.select("prompt_id", F.lit(1).alias("ix"), F.lit("append_to_section").alias("op"), F.lit("S001").alias("target_id"), *[F.lit(t).alias(c) for c, t in (("old_text", ""), ("new_text", ""), ("text", "- y"))], F.array(F.lit("e")).alias("evidence_refs"))
    found = patches.patched(own, edits)
    assert {r.candidate for r in found.collect()} == {"# A\n- x\n- y\n"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(containment, "LIST", 3)
    left = [(k % 17, t) for k, t in enumerate(["Abc d", "bc", "x", "", None, "cd e", "abcde", "bc"] * 6)] + [(None, "bc"), (None, "abc")]
    right = [(str(k % 11), t) for k, t in enumerate(["ABC", "abcdef", "c", "zz", None, "bcd"] * 5)] + [(None, "abc")]
    a, b = spark.createDataFrame(left, "id int, ref string"), spark.createDataFrame(right, "name string, title string")
    found = containment.containing_pairs(a, b, "id", "ref", "name", "title")
    key = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    want = {(i, n) for i, r in left for n, t in right if key(r) and key(t) and (key(r) in key(t) or key(t) in key(r))}
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == ["id", "name"] and len(rows) == len(want) and set(rows) == want
    # the last steps are those that make the pairs
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Generate")] and "Join" not in plan[: plan.index("Generate")]

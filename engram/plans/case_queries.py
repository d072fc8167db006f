"""Queries over cases, comparison details and rule references, beside the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cases, detail, results, rules, sessions
from . import views as V
from .queries import PARSED_BODY, query

_TURNS = "(CASE WHEN coalesce(query, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(answer, '') <> '' THEN 1 ELSE 0 END)"


@query(f"""WITH RECURSIVE {V.ROWS}, n AS (SELECT file, row_ix, {_TURNS} AS t, row_number() OVER (PARTITION BY file ORDER BY row_ix) AS rn FROM rows_),
w AS (SELECT file, row_ix, rn, t AS buf, 0 AS g, t >= 4 AS done FROM n WHERE rn = 1 UNION ALL
SELECT n.file, n.row_ix, n.rn, CASE WHEN w.done THEN n.t ELSE w.buf + n.t END, CASE WHEN w.done THEN w.g + 1 ELSE w.g END, CASE WHEN w.done THEN n.t ELSE w.buf + n.t END >= 4 FROM w JOIN n ON n.file = w.file AND n.rn = w.rn + 1)
SELECT file, CAST(g AS BIGINT) AS group_ix, max(row_ix) AS row_ix, CAST(arg_max(buf, rn) AS BIGINT) AS n_turns, 'case_' || max(row_ix) AS case_id, 'unknown' AS model_name, max(row_ix) - arg_max(buf, rn) // 2 + 1 AS row_index_start
FROM w GROUP BY file, g HAVING arg_max(buf, rn) > 0""")
def q_sheet_cases(spark, d):
    rows = V.dialogue_rows(spark, d).select("file", "row_ix", "query", "answer", "reasoning")
    return cases.sheet_cases(rows, 2).select("file", "group_ix", "row_ix", "n_turns", "case_id", "model_name", "row_index_start")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'case_' || o_orderkey ELSE 'c' || o_orderkey END AS case_id, CASE WHEN o_orderkey % 4 = 0 THEN 'session_' || o_orderkey ELSE 's' END AS session_id,
CASE WHEN o_orderkey % 5 <> 0 THEN 'old' END AS old_memory, o_orderkey - 0 + 1 AS row_index_start, o_orderkey + 1 AS row_index_end FROM orders""")
def q_build_cases(spark, d):
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select("o_orderkey", k.alias("row_ix"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("case_id"), F.when(k % 4 == 0, "").otherwise("s").alias("session_id"), F.when(k % 5 == 0, "").otherwise("old").alias("old_memory"), F.lit(1).alias("n_turns"))
    return cases.build_cases(rows).select("o_orderkey", "case_id", "session_id", "old_memory", "row_index_start", "row_index_end")


@query("""SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'case_id is required' END, CASE WHEN o_orderkey % 5 = 0 THEN 'task_type is required' END, CASE WHEN o_orderkey % 7 = 0 THEN 'session_id is required' END) AS errors FROM orders""")
def q_case_errors(spark, d):
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select("o_orderkey", F.when(k % 3 != 0, "c").otherwise("").alias("case_id"), F.when(k % 5 != 0, "t").alias("task_type"), F.when(k % 7 != 0, "s").otherwise("").alias("session_id"))
    return rows.select("o_orderkey", F.array_join(cases.case_errors(), "; ").alias("errors"))


@query(f"WITH {V.RES} SELECT case_id, reviewer FROM res WHERE reviewer IN ('1', '4')")
def q_reviewer_filter(spark, d):
    return cases.of_reviewers(V.results(spark, d), "1， 4,").select("case_id", "reviewer")


@query("SELECT count(DISTINCT o_orderpriority) AS n, 'several (' || count(DISTINCT o_orderpriority) || ')' AS summary FROM orders")
def q_value_summary(spark, d):
    return cases.value_summary(V.table(spark, d, "orders"), "o_orderpriority")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def q_case_limit(spark, d):
    return cases.first_cases(V.table(spark, d, "orders").select("o_orderkey"), 25, "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders")
def q_source_order(spark, d):
    return cases.in_source_order(V.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "position")


@query("SELECT l_orderkey, min(l_linenumber) AS first_ix, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def q_ordered_groups(spark, d):
    g = cases.ordered_groups(V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_linenumber")
    return g.select("l_orderkey", "first_ix", F.array_join(F.transform("rows", lambda r: r["l_partkey"].cast("string")), ",").alias("parts"))


@query("""SELECT o_custkey, arg_max(v, o_orderkey) FILTER (v IS NOT NULL) AS last_value, arg_min(w, o_orderkey) AS first_value FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'b' || o_orderkey END AS v,
CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'b' || o_orderkey ELSE 'c' END AS w FROM orders) GROUP BY o_custkey""")
def q_first_last_filled(spark, d):
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select("o_custkey", k.alias("ix"), F.when(k % 3 == 0, F.concat(F.lit("a"), k.cast("string"))).otherwise(" ").alias("x"), F.when(k % 2 == 0, F.concat(F.lit("b"), k.cast("string"))).alias("y"), F.lit("c").alias("z"))
    return rows.groupBy("o_custkey").agg(cases.last_filled(("x", "y")).alias("last_value"), F.min_by(cases.first_filled("x", "y", "z"), "ix").alias("first_value"))


@query(f"WITH {V.ROWS} SELECT row_start, CASE WHEN row_end % 4 <> 0 THEN 'given ' || row_end END AS old_document FROM state_")
def q_explicit_memory(spark, d):
    rows = V.dialogue_rows(spark, d).withColumn("old_memory", F.when(F.col("row_ix") % 4 != 0, F.concat(F.lit("given "), F.col("row_ix").cast("string"))).otherwise(" "))
    return cases.explicit_memory(sessions.generate_cases(rows, 2), rows).select("row_start", "old_document")


@query(f"""WITH {V.ROWS} SELECT CASE WHEN status <> '' THEN 'upstream_status_' || status ELSE 'chunk_last_row_has_no_document' END AS skip_reason, count(*) AS n FROM state_ WHERE n_turns = 0 OR case_state = 'skip' GROUP BY 1""")
def q_missed_reasons(spark, d):
    return cases.missed_reasons(sessions.generate_cases(V.dialogue_rows(spark, d), 2))


@query("SELECT event_id, [user_id % 3, event_id % 3][1] || CASE WHEN user_id % 3 <> event_id % 3 THEN ',' || event_id % 3 ELSE '' END AS distinct_values FROM events")
def q_distinct_in_order(spark, d):
    a = F.array(F.col("user_id") % 3, F.col("event_id") % 3, F.col("user_id") % 3)
    return V.table(spark, d, "events").select("event_id", F.array_join(cases.distinct_in_order(a), ",").alias("distinct_values"))


@query(rf"""SELECT doc_id, digest FROM (WITH d AS (SELECT doc_id, chr(10) || '## Output:' || chr(13) || chr(10) || chr(10) || '--- USER.md ---' || chr(10) || coalesce(text, '') || '  ' || chr(10) || chr(10) AS x FROM documents),
p AS (SELECT doc_id, '' AS method, 0 AS confidence, 0 AS warned, CASE doc_id % 3 WHEN 0 THEN '```markdown' || chr(10) || x || chr(10) || '```' || chr(10) WHEN 1 THEN x ELSE substr(x, 40) END AS body FROM d), {PARSED_BODY})""")
def q_without_wrappers(spark, d):
    k, x = F.col("doc_id") % 3, F.concat(F.lit("\n## Output:\r\n\n--- USER.md ---\n"), F.coalesce("text", F.lit("")), F.lit("  \n\n"))
    text = F.when(k == 0, F.concat(F.lit("```markdown\n"), x, F.lit("\n```\n"))).when(k == 1, x).otherwise(F.substr(x, F.lit(40)))
    return V.table(spark, d, "documents").select("doc_id", F.sha2(cases.without_wrappers(text, "USER.md"), 256).alias("digest"))


@query("""WITH r AS (SELECT user_id, CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 WHEN 2 THEN 0.65 WHEN 3 THEN 0.05 + 0.2 * ((event_id % 10) / 10) WHEN 4 THEN 0.25 + 0.2 * ((event_id % 10) / 10) ELSE 0.0 END AS p FROM events)
SELECT user_id, round(sum(p) / 100000, 8) AS progress FROM r GROUP BY user_id""")
def q_loop_progress(spark, d):
    e = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("finished", "gate", "draft", "extraction", "evaluation", "none")]), (e % 6 + 1).cast("int"))
    rounds = V.table(spark, d, "events").select("user_id", stage.alias("stage"), (e % 10).alias("done"), F.lit(10).alias("total"), F.lit(100_000).alias("planned"))
    return cases.loop_progress(rounds, "user_id", "planned").select("user_id", F.round("progress", 8).alias("progress"))


@query("""SELECT coalesce(u.p_partkey, b.p_partkey) AS p_partkey, coalesce(u.v, b.v) AS v, CASE WHEN u.v IS NOT NULL THEN 'user' ELSE 'bundled' END AS origin FROM (SELECT p_partkey, p_name AS v FROM part WHERE p_partkey % 2 = 0) b
FULL JOIN (SELECT p_partkey, p_brand AS v FROM part WHERE p_partkey % 3 = 0) u ON u.p_partkey = b.p_partkey""")
def q_prompt_catalog(spark, d):
    p = V.table(spark, d, "part")
    return cases.overriding_union(p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("v")), p.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("v")), "p_partkey")


@query("""SELECT user_id, event_type, CAST(place AS INT) AS place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY i, event_type) AS place FROM (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY ALL)) WHERE place <= 2""")
def q_bounded_distinct(spark, d):
    return cases.bounded_distinct(V.table(spark, d, "events"), "user_id", "event_type", "event_id", 2).select("user_id", "event_type", "place")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'rule ' || event_id ELSE 'only ' || event_id END AS excerpt FROM events")
def q_prompt_excerpt(spark, d):
    e = F.col("event_id").cast("string")
    m = F.when(F.col("event_id") % 3 == 0, "no marks").when(F.col("event_id") % 3 == 1, F.concat(F.lit("x\n## Rules (given)\nintro\n\nrule "), e, F.lit("\n## List\nend"))).otherwise(F.concat(F.lit("## Rules (given)\nonly "), e, F.lit("\n## List")))
    return V.table(spark, d, "events").select("event_id", cases.excerpt(m, "## Rules (given)", "## List").alias("excerpt"))


@query("SELECT event_id, event_id % 4 <> 1 AS present FROM events")
def q_has_candidate(spark, d):
    m = F.element_at(F.array(F.lit("no marks"), F.lit("## New doc\n  abc"), F.lit("## Reasoning\nlong enough\n## New doc\n"), F.lit("## New doc\nabc ## New doc\nlong enough")), (F.col("event_id") % 4 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", cases.has_candidate(m, ("## New doc", "## Candidate"), "## Reasoning").alias("present"))


# Comparison in detail -----------------------------------------------------------------------------

def _four(spark, d):
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select(
        k.cast("string").alias("source_key"), k.alias("ix"), F.when(k % 4 == 0, "same").otherwise(F.concat(F.lit("out "), (k % 9).cast("string"))).alias("output"),
        F.when(k % 9 == 1, "out 1").otherwise("").alias("old_memory"), F.when(k % 10 == 0, "failed").otherwise("success").alias("call_status"), F.when(k % 6 == 0, "empty").otherwise("structured").alias("parse_status"),
    )
    other = o.withColumn("output", F.when(F.col("ix") % 4 == 0, "same ").when(F.col("ix") % 9 == 1, "other").otherwise("new")).withColumn("old_memory", F.when(F.col("ix") % 9 == 1, "other").otherwise(""))
    twice = o.where("ix % 50 = 3")
    return {"case_a": o.where("ix % 5 <> 0").unionByName(twice), "missed_a": o.where("ix % 5 = 0 AND ix % 7 <> 0"), "case_b": other.where("ix % 3 <> 0"), "missed_b": other.where("ix % 3 = 0 AND ix % 8 <> 0")}


_FOUR = """p AS (SELECT o_orderkey AS ix, CAST(o_orderkey AS VARCHAR) AS source_key, o_orderkey % 5 <> 0 OR o_orderkey % 50 = 3 AS ca, o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AS ma, o_orderkey % 3 <> 0 AS cb, o_orderkey % 3 = 0 AND o_orderkey % 8 <> 0 AS mb,
o_orderkey % 50 = 3 AND o_orderkey % 5 <> 0 AS duplicate FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0 OR o_orderkey % 3 <> 0 OR o_orderkey % 8 <> 0),
k AS (SELECT *, CASE WHEN ca THEN 'ready' WHEN NOT ma THEN 'missing' WHEN ix % 10 = 0 THEN 'infrastructure' WHEN ix % 6 = 0 THEN 'quality' ELSE 'unknown' END AS ka,
CASE WHEN cb THEN 'ready' WHEN NOT mb THEN 'missing' WHEN ix % 10 = 0 THEN 'infrastructure' WHEN ix % 6 = 0 THEN 'quality' ELSE 'unknown' END AS kb FROM p)"""


@query(f"WITH {_FOUR} SELECT source_key, duplicate, ca AS has_case_a, ma AS has_missed_a, cb AS has_case_b, mb AS has_missed_b FROM k")
def q_pair_four(spark, d):
    return detail.pair_four(_four(spark, d)).select("source_key", "duplicate", *[F.col(r).isNotNull().alias(f"has_{r}") for r in detail.ROLES])


@query(f"""WITH {_FOUR} SELECT source_key, CASE WHEN ca AND cb AND ix % 4 = 0 THEN 'identical_output' WHEN ca AND cb AND ix % 9 = 1 THEN 'historical_baseline_difference' WHEN ca AND cb THEN NULL WHEN ka = 'infrastructure' OR kb = 'infrastructure' THEN 'runtime_failure'
WHEN ka = 'ready' AND kb = 'quality' OR kb = 'ready' AND ka = 'quality' THEN NULL WHEN ka = 'quality' AND kb = 'quality' THEN 'both_missed' ELSE 'source_mismatch' END AS kind FROM k WHERE NOT duplicate""")
def q_pair_verdict(spark, d):
    return detail.pair_four(_four(spark, d)).where("NOT duplicate").select("source_key", detail.pair_verdict()["kind"].alias("kind"))


@query(f"WITH {_FOUR} SELECT CASE WHEN ix % 9 = 1 THEN 'different' ELSE 'both_empty' END AS relation, count(*) AS n FROM k WHERE ca AND cb GROUP BY 1")
def q_history_relation(spark, d):
    p = detail.pair_four(_four(spark, d)).where("case_a IS NOT NULL AND case_b IS NOT NULL")
    return p.groupBy(detail.history_relation().alias("relation")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'undecided: duplicate keys' WHEN o_orderkey % 7 = 0 THEN 'take B' WHEN o_orderkey % 5 = 0 THEN 'undecided: runs incomplete' WHEN o_orderkey % 4 = 0 THEN 'keep A: scores fell' WHEN o_orderkey % 3 = 0 THEN 'keep A: coverage fell' ELSE 'keep A: no proof' END AS verdict,
CASE WHEN o_orderkey % 11 = 0 THEN 'undecided' WHEN o_orderkey % 4 = 0 THEN 'take A' WHEN o_orderkey % 7 = 0 THEN 'take B' WHEN o_orderkey % 3 = 0 THEN 'take B' ELSE 'undecided' END AS preference FROM orders""")
def q_recommendation(spark, d):
    k = F.col("o_orderkey")
    r = V.table(spark, d, "orders").select(
        "o_orderkey", (k % 11 == 0).cast("int").alias("duplicates"), (k % 7 == 0).alias("accepted"), (k % 5 != 0).alias("complete_a"), F.lit(True).alias("complete_b"), F.when(k % 4 == 0, -0.2).otherwise(0.0).alias("mean_delta"), F.lit(0.05).alias("tolerance"),
        F.when(k % 3 == 0, 0.1).otherwise(0.0).alias("coverage_drop"), (k % 11 == 0).cast("int").alias("failures"), F.lit(9).alias("decided"), F.when(k % 4 == 0, -0.5).when(k % 7 == 0, 0.5).otherwise(0.0).alias("preference"),
        F.when(k % 4 == 0, -0.8).when(k % 7 == 0, 0.2).otherwise(-0.1).alias("lower"), F.when(k % 4 == 0, -0.1).when(k % 7 == 0, 0.8).otherwise(0.1).alias("upper"), F.when(k % 3 == 0, 0.6).alias("prompt_delta"),
    )
    return r.select("o_orderkey", detail.recommendation().alias("verdict"), detail.preference_recommendation().alias("preference"))


def _sides(spark, d):
    k = F.col("l_orderkey")
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select(
        (k % 7).cast("string").alias("reviewer"), F.concat((k % 100).cast("string"), F.lit(".0")).alias("session_id"), k.cast("string").alias("chunk_id"), F.col("l_linenumber").alias("ix"), F.col("p").cast("string").alias("query"), F.lit("a").alias("answer"),
        F.when(F.col("p") % 2 == 0, F.concat(F.lit("d"), F.col("p").cast("string"))).otherwise(" ").alias("document"), F.lit(None).cast("string").alias("raw_output"),
    ).withColumn("session_id", C.canonical_id(F.col("session_id")))
    return rows.where("ix % 3 <> 0"), rows.where("ix <> 5").withColumn("query", F.when(F.col("ix") % 4 == 0, "moved").otherwise(F.col("query")))


_SIDES = """l AS (SELECT l_orderkey, l_linenumber AS ix, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ix) AS n, CAST(p AS VARCHAR) AS q FROM l WHERE ix % 3 <> 0), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ix) AS n, CASE WHEN ix % 4 = 0 THEN 'moved' ELSE CAST(p AS VARCHAR) END AS q FROM l WHERE ix <> 5),
j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k, coalesce(a.n, b.n) AS n, coalesce(a.q, b.q) AS query, coalesce(a.q = b.q, false) AS same FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.n = b.n),
da AS (SELECT l_orderkey AS k, arg_max('d' || p, ix) AS o FROM a WHERE p % 2 = 0 GROUP BY 1), db AS (SELECT l_orderkey AS k, arg_max('d' || p, ix) AS o FROM b WHERE p % 2 = 0 GROUP BY 1),
ch AS (SELECT k, string_agg(query, chr(10) || chr(10) ORDER BY n) AS query, bool_and(same) AS consistent, max(n) AS rows FROM j GROUP BY k)"""


@query(f"WITH {_SIDES} SELECT CAST(ch.k AS VARCHAR) AS chunk_id, query, consistent, CAST(rows AS INT) AS rows, coalesce(da.o, '') AS output_a, coalesce(db.o, '') AS output_b FROM ch LEFT JOIN da USING (k) LEFT JOIN db USING (k)")
def q_chunk_side_by_side(spark, d):
    return detail.side_by_side(*_sides(spark, d))[1].select("chunk_id", "query", "consistent", "rows", "output_a", "output_b")


@query(f"WITH {_SIDES} SELECT CAST(j.k AS VARCHAR) AS chunk_id, CAST(j.n AS INT) AS n, j.query, j.n = ch.rows AS boundary, CASE WHEN j.n = ch.rows THEN coalesce(da.o, '') ELSE '' END AS output_a FROM j JOIN ch USING (k) LEFT JOIN da USING (k)")
def q_row_side_by_side(spark, d):
    return detail.side_by_side(*_sides(spark, d))[0].select("chunk_id", "n", "query", "boundary", "output_a")


@query("""WITH c AS (SELECT o_orderkey AS k, CAST(o_custkey % 7 AS VARCHAR) AS reviewer FROM orders), x AS (SELECT o_orderkey AS k, 'v' || (o_orderkey % 3) AS verdict FROM orders WHERE o_orderkey % 2 = 0)
SELECT CAST(c.k AS VARCHAR) AS chunk_id, coalesce(x.verdict, '') AS verdict FROM c LEFT JOIN x USING (k)""")
def q_with_comparison(spark, d):
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select(k.cast("string").alias("chunk_id"), (F.col("o_custkey") % 7).cast("string").alias("reviewer"), (k % 9).cast("string").alias("session_id"), k.alias("ix"))
    said = o.where("ix % 2 = 0").withColumns({"chunk_index": (F.col("ix") - 1).cast("string"), "chunk_id": F.when(F.col("ix") % 4 == 0, "").otherwise(F.concat(F.col("chunk_id"), F.lit(".0"))), "verdict": F.concat(F.lit("v"), (F.col("ix") % 3).cast("string")), "delta_milli": F.lit(1), "score_a": F.lit(1), "score_b": F.lit(2), "reason": F.lit("r")})
    first = said.withColumn("verdict", F.lit("earlier")).withColumn("ix", F.col("ix") - 1)
    return detail.with_comparison(o.drop("ix"), said.unionByName(first)).select("chunk_id", "verdict")


@query(f"WITH {V.RES} SELECT 'k' || (ix % 1000000) AS case_id, score_milli FROM res WHERE ix % 3 <> 0 AND ix % 50 <> 1")
def q_rekeyed_for_gate(spark, d):
    r = V.results(spark, d)
    own = r.where("ix % 3 <> 0").select("case_id", "ix", F.concat(F.lit("k"), (F.col("ix") % 1000000).cast("string")).alias("source_key"))
    return detail.rekeyed_for_gate(r, own, own.where("ix % 50 = 1")).select("case_id", "score_milli")


@query("""SELECT count(*) FILTER (event_id % 5 > 1) AS ready_cases, count(*) FILTER (event_id % 5 = 0) AS quality_failures, count(*) FILTER (event_id % 5 = 1) AS infrastructure_failures, 0 AS unknown_chunks,
count(*) FILTER (event_id % 5 > 1) / count(*) FILTER (event_id % 5 <> 1) AS extraction_coverage, count(*) FILTER (event_id % 5 <> 1) / count(*) AS infrastructure_success_rate FROM events""")
def q_direct_quality(spark, d):
    e = V.table(spark, d, "events").withColumn("m", F.col("event_id") % 5)
    missed = e.where("m < 2").select(F.when(F.col("m") == 1, "failed").otherwise("success").alias("call_status"), F.when(F.col("m") == 0, "empty").alias("parse_status"))
    return detail.direct_quality(e.where("m > 1"), missed, V.results(spark, d))


@query(f"""WITH {V.RES_A}, {V.RES_B} SELECT case_id, CASE WHEN NOT c.ok AND NOT b.ok THEN 'both failed' WHEN NOT c.ok THEN 'current failed' WHEN NOT b.ok THEN 'baseline failed' ELSE 'configuration differs' END AS label FROM res_b c JOIN res_a b USING (case_id) WHERE NOT c.ok OR NOT b.ok OR c.ix % 5 = 2""")
def q_excluded_pairs(spark, d):
    b = V.results(spark, d, "b").withColumn("prompt_version", F.when(F.col("ix") % 5 == 2, "other").otherwise(F.col("prompt_version")))
    return detail.excluded_pairs(detail.paired_runs(b, V.results(spark, d, "a")), ("model_name", "prompt_version")).select("case_id", "label")


# Rule references and judge output -----------------------------------------------------------------

_PROMPT = "# Prompt\nR1 keep  names\nR2 drop dates / times\nR3 merge"


def _judged(spark, d):
    k = F.col("o_orderkey")
    ref = F.element_at(F.array(F.lit("- R1  keep names."), F.lit("R2 drop dates、R3 merge"), F.lit("R9 invented"), F.lit("see 「R3 merge」 there")), (k % 4 + 1).cast("int"))
    r = V.results(spark, d).withColumn("o_orderkey", F.col("ix"))
    return r.withColumns({
        "all_refs": F.when(k % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(ref)), "comment": F.when(k % 13 == 0, "breaks R7").otherwise("as R1 says"),
        "prompt_hash": F.when(k % 5 == 0, F.sha1(F.lit(_PROMPT))).when(k % 5 == 1, "unknown hash").otherwise(""), "prompt_version": F.when(k % 5 == 4, "").otherwise("v1"),
    })


def _reported(spark, d):
    prompts = spark.createDataFrame([("a.md", "v1", _PROMPT), ("b.md", "v2", "other")], "name string, version string, text string")
    return rules.reference_report(rules.resolved_prompts(_judged(spark, d), prompts))


_STATUS = """CASE WHEN ix % 11 = 0 THEN 'runtime_failure' WHEN ix % 5 = 4 THEN 'not_applicable' WHEN (ix % 6 <> 5 AND ix % 4 = 2) OR ix % 13 = 0 THEN 'invalid' WHEN ix % 6 = 5 THEN 'missing' WHEN ix % 5 = 1 THEN 'hash_mismatch' ELSE 'ok' END"""


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey % 4 <> 2 END AS there FROM orders")
def q_rule_ref_exists(spark, d):
    return _judged(spark, d).select("o_orderkey", rules.reference_exists(F.try_element_at("all_refs", F.lit(1)), F.lit(_PROMPT)).alias("there")).withColumn("there", F.when(F.col("o_orderkey") % 6 != 5, F.col("there")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE 'a.md' END AS prompt_source, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 = 1 THEN false END AS hash_match FROM orders")
def q_prompt_resolve(spark, d):
    return _reported(spark, d).select("o_orderkey", "prompt_source", "hash_match")


@query(f"WITH {V.RES} SELECT case_id, {_STATUS} AS rule_status FROM res")
def q_rule_ref_report(spark, d):
    return _reported(spark, d).select("case_id", "rule_status")


@query(f"WITH {V.RES}, s AS (SELECT {_STATUS} AS s FROM res) SELECT count(*) AS total, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'invalid') AS invalid, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'hash_mismatch') AS hash_mismatch, count(*) FILTER (s IN ('runtime_failure', 'not_applicable')) AS not_checked FROM s")
def q_rule_ref_summary(spark, d):
    return rules.report_summary(_reported(spark, d))


@query(f"WITH {V.RES} SELECT case_id, CASE WHEN ix % 2 = 0 THEN {_STATUS} ELSE '' END AS rule_status FROM res")
def q_rule_status_join(spark, d):
    return rules.with_rule_status(V.results(spark, d), _reported(spark, d).where("ix % 2 = 0"), ["case_id"]).select("case_id", "rule_status")


@query("SELECT event_id FROM events WHERE event_id % 10 = 3")
def q_evidence_by_refs(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("evidence_id"))
    return rules.evidence_of(e, e.where("event_id % 10 = 3"), "event_id", 5).select("event_id")


@query(r"""WITH l AS (SELECT event_id, ['R' || event_id % 4 || ' a', 'x' || event_id % 3, 'x' || event_id % 5, 'R' || event_id % 3 || ' b and R' || user_id % 3, 'x' || event_id % 3] AS refs FROM events)
SELECT event_id, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i AND len(list_filter(regexp_extract_all(x, '\bR\d+\b'), lambda r: r NOT IN ('R1', 'R2'))) = 0), ',') AS refs FROM l""")
def q_merged_refs(spark, d):
    e, t = F.col("event_id"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    own, nested = F.array(t("R", e % 4, " a"), t("x", e % 3)), F.array(F.array(t("x", e % 5), t("R", e % 3, " b and R", F.col("user_id") % 3)), F.array(t("x", e % 3)))
    return V.table(spark, d, "events").select("event_id", F.array_join(rules.merged_references(own, nested, F.array(F.lit("R1"), F.lit("R2"))), ",").alias("refs"))


@query("""SELECT event_id, (event_id % 50) / 10 AS total, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (event_id % 5) * 1.0 END AS coverage, CASE WHEN event_id % 3 = 0 THEN 'wrong_fact,over_memory' WHEN event_id % 3 = 1 THEN 'over_memory' ELSE '' END AS tags, event_id % 3 = 1 AS fatal FROM events""")
def q_judge_aliases(spark, d):
    e, t, c = F.col("event_id"), ((F.col("event_id") % 50) / 10).cast("string"), (F.col("event_id") % 5).cast("string")
    raw = (
        F.when(e % 3 == 0, F.concat(F.lit('```json\n{"score_total": '), t, F.lit(', "scores": {"coverage": '), c, F.lit('}, "error_tags": ["wrong_fact", "over_memory"], "fatal_error": false}\n```')))
        .when(e % 3 == 1, F.concat(F.lit('Here: {"评估结果": {"总分": '), t, F.lit(', "维度分": {"完整性": '), c, F.lit('}, "tags": "over_memory", "fatal": "yes"}}')))
        .otherwise(F.concat(F.lit('{"score": "'), t, F.lit('", "errors": "无"}')))
    )
    f = rules.judge_fields(raw)
    return V.table(spark, d, "events").select("event_id", f["score_total"].alias("total"), F.try_element_at(f["dims"], F.lit("coverage")).alias("coverage"), F.array_join(f["error_tags"], ",").alias("tags"), f["fatal"].alias("fatal"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'coverage|high|r1;r2||' ELSE 'format|low|r3|e1|' END AS signature FROM events")
def q_diagnostic_signature(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, '[{"dimension": "coverage ", "severity": "high", "rule_refs": ["R2", "R1"], "reason": "x"}, 5]').otherwise('{"维度": "format", "严重程度": "low", "规则引用": "R3", "事实证据": [" E1"]}')
    return V.table(spark, d, "events").select("event_id", F.array_join(rules.diagnostic_signatures(rules.diagnostics_of(raw)), "#").alias("signature"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AS failed FROM orders")
def q_legacy_status(spark, d):
    k = F.col("o_orderkey")
    r = V.table(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, "Judge 调用失败: x").otherwise("fine").alias("comment"), (k % 3 == 0).alias("fatal"), F.when(k % 5 == 0, F.create_map(F.lit("format"), F.lit(1))).alias("dims"), F.lit(0).alias("score_milli"))
    return r.select("o_orderkey", rules.legacy_failed().alias("failed"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'TIE' WHEN 3 THEN 'POLICY_DIFFERENCE' ELSE 'INSUFFICIENT' END AS winner, CASE event_id % 5 WHEN 0 THEN 'common_quality' WHEN 1 THEN 'common_quality' WHEN 2 THEN 'equivalent' WHEN 3 THEN 'policy_difference' ELSE 'insufficient' END AS basis FROM events""")
def q_pairwise_winner(spark, d):
    e = F.col("event_id")
    w = F.element_at(F.array(F.lit("candidate-1"), F.lit("候选2"), F.lit("持平"), F.lit("1"), F.lit("what")), (e % 5 + 1).cast("int"))
    s = rules.pairwise_winner(w, e % 5 == 1, F.lit(""), F.when(e % 5 == 3, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")))
    return V.table(spark, d, "events").select("event_id", s["winner"].alias("winner"), s["basis"].alias("basis"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round((least(5, greatest(1, event_id % 9)) + 2.5) / 2, 3) END AS overall FROM events")
def q_prompt_quality(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, '{"clarity": "?"}').otherwise(F.concat(F.lit('{"clarity": '), (F.col("event_id") % 9).cast("string"), F.lit(', "consistency": "2.5", "model_guidance": "none"}')))
    return V.table(spark, d, "events").select("event_id", rules.prompt_quality(raw).alias("overall"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no_eval_results' WHEN o_orderkey % 5 = 0 THEN 'eval_chain_failed' WHEN o_orderkey % 3 = 0 THEN 'no_change_needed' WHEN o_orderkey % 4 = 0 THEN 'advisor_failed' WHEN o_orderkey % 2 = 0 THEN 'no_safe_patch' ELSE 'no_candidate_unknown' END AS reason FROM orders""")
def q_no_candidate_reason(spark, d):
    k = F.col("o_orderkey")
    r = V.table(spark, d, "orders").select("o_orderkey", F.when(k % 7 == 0, 0).otherwise(10).alias("total"), F.when(k % 5 == 0, F.when(k % 2 == 0, 10).otherwise(5)).otherwise(1).alias("failed"), F.when((k % 3 == 0) | (k % 5 == 0), 0).otherwise(2).alias("issues"), F.when(k % 4 == 0, "e").otherwise("").alias("error"), F.lit(None).cast("boolean").alias("can_suggest"), F.when(k % 2 == 0, "no_valid_incremental_patch").otherwise("").alias("source"))
    return r.select("o_orderkey", rules.no_candidate_reason().alias("reason"))


@query("SELECT event_type AS evidence_mode, count(*) AS n FROM events GROUP BY 1")
def q_evidence_modes(spark, d):
    return rules.evidence_modes(V.table(spark, d, "events").withColumnRenamed("event_type", "evidence_mode"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 ORDER BY event_id LIMIT 30")
def q_review_evidence(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "4").otherwise(" ").alias("human_score"), F.lit("").alias("human_comment"))
    return rules.reviewed_evidence(e, 30, "event_id").select("event_id")


@query("SELECT event_id, '## Old document' || chr(10) || '(empty)' || chr(10) || chr(10) || '## Dialogue' || chr(10) || event_type || chr(10) || chr(10) || '## New document' || chr(10) || event_id AS message FROM events")
def q_judge_message(spark, d):
    return V.table(spark, d, "events").select("event_id", rules.judge_message(F.lit(" "), F.col("event_type"), F.col("event_id").cast("string")).alias("message"))


# Operators that had no query ----------------------------------------------------------------------

@query(f"WITH {V.RES_A}, {V.RES_B} SELECT count(*) AS n FROM res_a a JOIN res_b b USING (case_id) WHERE a.ok AND b.ok AND a.output = b.output AND (a.score_milli <> b.score_milli OR list_sort(a.error_tags) <> list_sort(b.error_tags) OR {' OR '.join(f'a.{x} <> b.{x}' for x in V.DIMENSIONS)})")
def q_judges_disagree(spark, d):
    from .queries import _sources

    both = _sources(spark, d).where("a IS NOT NULL AND b IS NOT NULL AND a.ok AND b.ok AND verdict = 'same output'")
    from ..operators import compare

    return both.where(compare.judges_disagree()).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(chr(12288) || coalesce(text, '') || chr(9) || chr(10), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS digest FROM documents""")
def q_squeeze(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.sha2(C.squeeze(F.concat(F.lit("　"), F.coalesce("text", F.lit("")), F.lit("\t\n"))), 256).alias("digest"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'x1.0' ELSE '-7' END AS id FROM events")
def q_canonical_id(spark, d):
    e = F.col("event_id").cast("string")
    x = F.element_at(F.array(F.lit(" NaN"), F.concat(e, F.lit(".0")), F.lit("x1.0"), F.lit("-7.00 ")), (F.col("event_id") % 4 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", C.canonical_id(x).alias("id"))


@query("SELECT event_id, 'user_md|' || CASE WHEN event_id % 2 = 0 THEN 'unknown_reviewer' ELSE CAST(user_id AS VARCHAR) END || '|unknown_session|' || event_id % 5 || '||9' AS source_key FROM events")
def q_source_key(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", C.source_key(F.lit("user_md"), F.when(F.col("event_id") % 2 == 1, F.col("user_id").cast("string")), F.lit(" "), F.col("event_id") % 5, F.lit(None), F.lit(9)).alias("source_key"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey % 7) FILTER (l_linenumber % 3 <> 0) AS a, list(DISTINCT l_suppkey % 7) FILTER (l_linenumber % 4 <> 1) AS b FROM lineitem GROUP BY 1),
n AS (SELECT l_orderkey, coalesce(len(a), 0) AS n, coalesce(len(b), 0) AS m, coalesce(len(list_intersect(a, b)), 0) AS shared FROM s)
SELECT l_orderkey, CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END ELSE shared / n END AS p, CASE WHEN m = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END ELSE shared / m END AS r, CASE WHEN n + m = 0 THEN 1.0 ELSE 2.0 * shared / (n + m) END AS f1 FROM n""")
def q_precision_recall(spark, d):
    sets = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 7)).alias("a"), F.collect_list(F.when(F.col("l_linenumber") % 4 != 1, F.col("l_suppkey") % 7)).alias("b"))
    p, r, f1 = C.precision_recall_f1(F.col("a"), F.col("b"))
    return sets.select("l_orderkey", p.alias("p"), r.alias("r"), f1.alias("f1"))


@query("SELECT event_id, '{\"n\": ' || event_id || '}' AS body, 'said ' || event_id AS content, 'ab' || event_id AS streamed FROM events")
def q_model_answers(spark, d):
    from ..operators import texts

    e = F.col("event_id").cast("string")
    body = F.concat(F.lit('```json\n{"n": '), e, F.lit("}\n```"))
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"choices": [{"message": {"content": "said '), e, F.lit('"}}]}'))).otherwise(F.concat(F.lit('{"choices": [{"text": ""}], "answer": "said '), e, F.lit('"}')))
    lines = F.concat(F.lit('data: {"choices": [{"delta": {"content": "ab"}}]}\n\ndata: {"choices": [{"delta": {}}]}\ndata: {"choices": [{"delta": {"content": "'), e, F.lit('"}}]}\ndata: [DONE]\n'))
    return V.table(spark, d, "events").select("event_id", texts.json_body(body).alias("body"), texts.message_content(said).alias("content"), texts.stream_content(lines).alias("streamed"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 21.0 WHEN event_id % 3 = 1 THEN 8.0 ELSE 12.0 END AS wait, 'a_b.c-' || event_id AS name, '# h ' || event_id || ',# k' AS heads FROM events")
def q_small_columns(spark, d):
    e = F.col("event_id")
    wait = C.backoff_seconds(F.lit(3), e % 3 != 1, F.when(e % 3 == 0, 0.05).otherwise(0.5), F.lit(12.0))
    text = F.concat(F.lit(" # h "), e.cast("string"), F.lit("\nx\n# k\n# k"))
    return V.table(spark, d, "events").select("event_id", wait.alias("wait"), C.safe_name(F.concat(F.lit(" a/ b.c-"), e.cast("string"))).alias("name"), F.array_join(C.headings(text), ",").alias("heads"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS old, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
v AS (SELECT doc_id, old, replace(array_to_string(list_concat(list_slice(ls, 2, len(ls)), ['# New', ls[1], '# New']), chr(10)), ' the ', ' a ') AS new FROM d),
s AS (SELECT doc_id, old, new, CASE WHEN old LIKE '%' || chr(10) OR old = '' THEN list_slice(string_split(old, chr(10)), 1, len(string_split(old, chr(10))) - 1) ELSE string_split(old, chr(10)) END AS a, string_split(new, chr(10)) AS b FROM v),
la AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM s), lb AS (SELECT doc_id, unnest(b) AS line, generate_subscripts(b, 1) AS j FROM s),
m AS MATERIALIZED (SELECT doc_id, i, j FROM la JOIN lb USING (doc_id, line)),
r AS (SELECT doc_id, CAST(1 AS BIGINT) AS alo, CAST(len(a) + 1 AS BIGINT) AS ahi, CAST(1 AS BIGINT) AS blo, CAST(len(b) + 1 AS BIGINT) AS bhi, CAST(0 AS BIGINT) AS k FROM s
UNION ALL SELECT doc_id, x.alo, x.ahi, x.blo, x.bhi, x.k FROM (
SELECT doc_id, unnest([{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'k': CAST(0 AS BIGINT)}, {'alo': i + n, 'ahi': ahi, 'blo': j + n, 'bhi': bhi, 'k': CAST(0 AS BIGINT)}, {'alo': i, 'ahi': i, 'blo': j, 'bhi': j, 'k': n}]) AS x FROM (
SELECT doc_id, alo, ahi, blo, bhi, min(i) AS i, min(j) AS j, count(*) AS n FROM (
SELECT r.doc_id, alo, ahi, blo, bhi, i, j, i - row_number() OVER (PARTITION BY r.doc_id, alo, blo, i - j ORDER BY i) AS g FROM r JOIN m ON m.doc_id = r.doc_id AND i >= alo AND i < ahi AND j >= blo AND j < bhi WHERE k = 0) GROUP BY doc_id, alo, ahi, blo, bhi, i - j, g
QUALIFY row_number() OVER (PARTITION BY doc_id, alo, blo ORDER BY count(*) DESC, min(i), min(j)) = 1))),
t AS (SELECT doc_id, sum(k) AS same FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(b) - same AS INT) AS added, CAST(len(a) - same AS INT) AS removed, CASE WHEN old = '' THEN 1.0 ELSE (length(new) - length(old)) / length(old) END AS growth, sha256(old) AS old_hash FROM s JOIN t USING (doc_id)""")
def q_prompt_diff(spark, d):
    from ..operators import diffs

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    new = F.replace(F.array_join(F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit("# New"), lines[0], F.lit("# New"))), "\n"), F.lit(" the "), F.lit(" a "))
    rows = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old"), new.alias("new"))
    return diffs.line_diff(rows, "old", "new", frequent=True).select("doc_id", "diff.added", "diff.removed", "diff.growth", "diff.old_hash")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'interrupted' WHEN event_id % 3 = 1 THEN 'running' ELSE 'done' END AS status FROM events")
def q_stale_tasks(spark, d):
    from ..streaming import events as streams

    e = F.col("event_id")
    rows = V.table(spark, d, "events").select("event_id", F.when(e % 3 == 2, "done").otherwise("running").alias("status"), F.when(e % 3 == 1, 990).otherwise(10).cast("timestamp").alias("heartbeat_at"))
    return streams.stale_tasks(rows, F.lit(1000).cast("timestamp")).select("event_id", "status")


_KEYS = r"""e AS (SELECT p_partkey AS evidence_id, CASE p_partkey % 3 WHEN 0 THEN '《' || upper(p_name) || '》 ' || p_type WHEN 1 THEN substr(p_name, 3, 9) ELSE CAST(p_size AS VARCHAR) || p_brand END AS ref FROM part),
x AS (SELECT evidence_id, regexp_replace(lower(ref), '[^\p{L}\p{N}]', '', 'g') AS r FROM e), y AS (SELECT p_partkey AS section_id, regexp_replace(lower(p_name || CASE WHEN p_partkey % 4 = 0 THEN p_size || p_brand ELSE '' END), '[^\p{L}\p{N}]', '', 'g') AS t FROM part)"""


def _referring(spark, d):
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    ref = F.when(k % 3 == 0, F.concat(F.lit("《"), F.upper("p_name"), F.lit("》 "), "p_type")).when(k % 3 == 1, F.substring("p_name", 3, 9)).otherwise(F.concat(F.col("p_size").cast("string"), "p_brand"))
    title = F.concat("p_name", F.when(k % 4 == 0, F.concat(F.col("p_size").cast("string"), "p_brand")).otherwise(""))
    return p.select(k.alias("evidence_id"), ref.alias("ref")), p.select(k.alias("section_id"), title.alias("title"))


@query(f"WITH {_KEYS} SELECT evidence_id, section_id FROM x JOIN y ON r <> '' AND t <> '' AND (contains(r, t) OR contains(t, r))")
def q_sections_for_evidence(spark, d):
    from ..operators import evidence

    return evidence.sections_for_evidence(*_referring(spark, d))


@query(f"""WITH {_KEYS}, f AS (SELECT evidence_id, section_id FROM x JOIN y ON r <> '' AND t <> '' AND (contains(r, t) OR contains(t, r))), o AS (SELECT *, row_number() OVER (ORDER BY evidence_id DESC, section_id) AS n FROM f)
SELECT 'L' || lpad(CAST(n AS VARCHAR), 3, '0') AS intent_id, section_id, evidence_id FROM o WHERE n <= 50""")
def q_local_intents(spark, d):
    from ..operators import evidence

    found, sections = _referring(spark, d)
    found = found.withColumns({"ix": -F.col("evidence_id"), "ref_ix": F.lit(0), "comment": F.lit("c")})
    return evidence.local_intents(found, sections.withColumn("place", F.col("section_id")), 50).drop("issue")


_REFS = r"""q AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_type, '# Rules' || chr(10) || '- keep  ' || p_name || chr(10) || '- R1 ' || p_type AS prompt FROM part),
c AS (SELECT p_partkey, prompt, CASE p_partkey % 9 WHEN 0 THEN '- keep ' || a || ' ' || b || '。' WHEN 1 THEN b || ' / ' || a WHEN 2 THEN 'see 【' || a || '】 and 「' || p_type || '」' WHEN 3 THEN 'as ''' || b || ''' says' WHEN 4 THEN 'see 《nowhere》' WHEN 5 THEN a || '、absent' WHEN 6 THEN '“' || a || '”' WHEN 7 THEN ' ' ELSE a || '/' || p_type || '/' END AS ref FROM q)"""


def _refs(spark, d):
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    a, b, t = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type")
    forms = [
        F.concat(F.lit("- keep "), a, F.lit(" "), b, F.lit("。")), F.concat(b, F.lit(" / "), a), F.concat(F.lit("see 【"), a, F.lit("】 and 「"), t, F.lit("」")), F.concat(F.lit("as '"), b, F.lit("' says")), F.lit("see 《nowhere》"),
        F.concat(a, F.lit("、absent")), F.concat(F.lit("“"), a, F.lit("”")), F.lit(" "), F.concat(a, F.lit("/"), t, F.lit("/")),
    ]
    return p.select("p_partkey", F.element_at(F.array(*forms), (k % 9 + 1).cast("int")).alias("ref"), F.concat(F.lit("# Rules\n- keep  "), "p_name", F.lit("\n- R1 "), "p_type").alias("prompt"))


@query(rf"""WITH {_REFS}, n AS (SELECT *, trim(regexp_replace(prompt, '\s+', ' ', 'g')) AS text, trim(trim(regexp_replace(ref, '\s+', ' ', 'g')), ' -:：,，.。；;“”"''`「」『』《》【】[]()（）') AS r FROM c),
w AS (SELECT *, list_filter(list_transform(regexp_split_to_array(r, '\s*(?:/|、|；|;|\n)\s*'), lambda x: trim(x, ' -:：,，.。；;“”"''`「」『』《》【】[]()（）')), lambda x: x <> '') AS parts,
list_filter(list_transform(regexp_extract_all(r, '[“"''「『《【]([^”"''」』》】]{{2,180}})[”"''」』》】]', 1), lambda x: trim(x, ' -:：,，.。；;“”"''`「」『』《》【】[]()（）')), lambda x: x <> '') AS quoted FROM n)
SELECT p_partkey, r <> '' AND (contains(text, r) OR (len(parts) > 1 AND len(list_filter(parts, lambda x: NOT contains(text, x))) = 0) OR (len(quoted) > 0 AND len(list_filter(quoted, lambda x: NOT contains(text, x))) = 0)) AS there FROM w""")
def q_quoted_refs(spark, d):
    return _refs(spark, d).select("p_partkey", rules.reference_exists(F.col("ref"), F.col("prompt")).alias("there"))


@query(rf"""WITH {_REFS}, n AS (SELECT *, trim(trim(ref), '"''“”‘’') AS r FROM c), w AS (SELECT *, list_transform(list_filter(string_split(r, '/'), lambda x: trim(x) <> ''), lambda x: trim(trim(x), '"''“”‘’')) AS parts FROM n)
SELECT p_partkey, contains(prompt, r) OR (len(parts) > 0 AND len(list_filter(parts, lambda x: NOT contains(prompt, x))) = 0) AS stands FROM w""")
def q_plain_refs(spark, d):
    return _refs(spark, d).select("p_partkey", rules.reference_stands(F.col("ref"), F.col("prompt")).alias("stands"))


@query(f"WITH {V.RES} SELECT case_id, 'fatal' AS mode FROM res WHERE ok AND fatal UNION ALL SELECT case_id, 'failed' FROM res WHERE NOT ok UNION ALL SELECT case_id, 'tagged' FROM res WHERE len(error_tags) > 0 UNION ALL SELECT case_id, 'diagnosed' FROM res WHERE n_diagnostics > 0 UNION ALL SELECT case_id, 'all' FROM res")
def q_filter_modes(spark, d):
    r, out = V.results(spark, d), None
    for mode in ("fatal", "failed", "tagged", "diagnosed", "all"):
        rows = results.matching(r, mode).select("case_id", F.lit(mode).alias("mode"))
        out = rows if out is None else out.unionByName(rows)
    return out

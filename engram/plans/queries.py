"""The queries: each operator over the test tables, beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical
from ..functions import columns as C
from ..operators import compare, documents, evidence, gate, prompts, results, sessions, stability, texts
from ..schemas import DIMENSIONS, WEIGHTS
from ..streaming import events as streams
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_STATS = """count(*) AS total, count(*) FILTER (ok) AS scored, count(*) FILTER (NOT ok) AS judge_failures,
  coalesce(sum(score_milli) FILTER (ok) / count(*) FILTER (ok) / 1000, 0.0) AS avg_score, count(*) FILTER (ok AND fatal) AS fatal_count,
  count(*) FILTER (ok AND fatal) / count(*) FILTER (ok) AS fatal_rate, count(*) FILTER (ok) / count(*) AS score_coverage, count(*) FILTER (ok) = count(*) AS run_complete"""


@query(f"WITH {V.RES} SELECT {_STATS} FROM res")
def q_result_stats(spark, d):
    return results.result_stats(V.results(spark, d))


@query(f'WITH {V.RES} SELECT model_name AS "group", {_STATS} FROM res GROUP BY model_name')
def q_stats_by_model(spark, d):
    return results.stats_by(V.results(spark, d), "model_name")


@query(f"WITH {V.RES} SELECT status, count(*) AS n FROM res GROUP BY status")
def q_status_hist(spark, d):
    return results.status_histogram(V.results(spark, d))


_UNPIVOT = " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS tenths FROM res WHERE ok" for x in DIMENSIONS)


@query(f"WITH {V.RES}, u AS ({_UNPIVOT}) SELECT dimension, sum(tenths) / count(*) / 10 AS mean, count(*) AS rows FROM u GROUP BY dimension")
def q_dim_mean_present(spark, d):
    return results.dimension_means(V.results(spark, d))


@query(f"WITH {V.RES}, u AS ({_UNPIVOT}), n AS (SELECT count(*) AS n FROM res WHERE ok) SELECT dimension, sum(CASE WHEN tenths > 9 THEN tenths ELSE 0 END) / max(n.n) / 10 AS mean FROM u, n GROUP BY dimension")
def q_dim_mean_zero_filled(spark, d):
    r = V.results(spark, d).withColumn("dims", F.map_filter("dims", lambda k, v: v > 9))
    return results.dimension_means_zero_filled(r)


@query(f"""WITH {V.RES}, t AS (SELECT ix, unnest(error_tags) AS tag FROM res WHERE ok), c AS (SELECT tag, count(*) AS n, min(ix) AS first_ix FROM t GROUP BY tag)
SELECT *, row_number() OVER (ORDER BY n DESC, first_ix, tag) AS position FROM c""")
def q_tag_histogram(spark, d):
    return results.tag_histogram(V.results(spark, d))


@query(f"""WITH {V.RES} SELECT count(*) AS total, count(*) FILTER (ok) AS scored, coalesce(sum(score_milli) FILTER (ok) / count(*) FILTER (ok) / 1000, 0.0) AS avg_score,
count(*) FILTER (ok AND fatal) AS fatal, count(*) FILTER (ok AND len(error_tags) > 0) AS tagged, CAST(sum(n_diagnostics) FILTER (ok) AS BIGINT) AS diagnostics FROM res""")
def q_side_summary(spark, d):
    return results.side_summary(V.results(spark, d))


@query(f"WITH {V.RES} SELECT case_id, score_milli FROM res WHERE ok AND score_milli < 2000")
def q_filter_low(spark, d):
    return results.matching(V.results(spark, d), "low", 2000).select("case_id", "score_milli")


_MESSAGES = "['API error: QPS limit','Connection idle timeout','request timed out','connection reset by peer','JSON decode failed','empty body','missing required key','status code 418','boom','schema validation: x']"
_MSG = f"m AS (SELECT event_id, lower({_MESSAGES}[event_id % 10 + 1]) AS t FROM events)"


@query(f"""WITH {_MSG} SELECT event_id, CASE WHEN regexp_matches(t, 'json decode|jsondecode|missing required|schema validation') THEN 'judge_parse_failed'
WHEN regexp_matches(t, 'api error|qps limit|rate limit|idle timeout|websocket|connection reset|timed out|timeout|http error|status code|429|50[234]') THEN 'judge_api_failed' ELSE 'judge_runtime_failed' END AS status FROM m""")
def q_failure_class3(spark, d):
    return V.failure_texts(spark, d).select("event_id", C.failure_status(F.col("message")).alias("status"))


@query(f"""WITH {_MSG} SELECT event_id, CASE WHEN regexp_matches(t, 'qps limit|rate limit|too many requests|429') THEN 'rate_limit' WHEN contains(t, 'idle timeout') THEN 'idle_timeout'
WHEN regexp_matches(t, 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(t, 'websocket|connection reset|connection aborted|going away') THEN 'connection'
WHEN regexp_matches(t, 'json|parse') THEN 'json_parse' WHEN regexp_matches(t, 'empty|no content') THEN 'empty_response' WHEN regexp_matches(t, 'required|missing field') THEN 'schema'
WHEN regexp_matches(t, 'api error|http|status code') THEN 'api_error' ELSE 'unknown' END AS kind FROM m""")
def q_failure_class9(spark, d):
    return V.failure_texts(spark, d).select("event_id", C.failure_kind(F.col("message")).alias("kind"))


@query("""SELECT l_orderkey, max(struct_pack(i := l_linenumber, v := l_partkey)).v AS l_partkey, max(struct_pack(i := l_linenumber, v := l_returnflag)).v AS l_returnflag, min(l_linenumber) AS position
FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag) = 1) GROUP BY l_orderkey""")
def q_last_write_wins(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_returnflag")).alias("v")).select("l_orderkey", "l_linenumber", "v.*")
    return results.last_writes(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_partkey", "l_returnflag", "position")


_DONE = "done AS (SELECT * FROM res WHERE ix % 3 = 0)"


@query(f"WITH {V.RES}, {_DONE} SELECT case_id FROM res WHERE case_id NOT IN (SELECT case_id FROM done)")
def q_resume_skip_all(spark, d):
    r = V.results(spark, d)
    return results.open_cases(r, r.where("ix % 3 = 0"), ["case_id"], "skip_all").select("case_id")


@query(f"WITH {V.RES}, {_DONE} SELECT case_id FROM res WHERE case_id NOT IN (SELECT case_id FROM done WHERE ok)")
def q_resume_skip_success(spark, d):
    r = V.results(spark, d)
    return results.open_cases(r, r.where("ix % 3 = 0"), ["case_id"], "skip_success").select("case_id")


@query(f"WITH {V.ROWS} SELECT file, row_ix, CAST(session_ix AS BIGINT) AS session_ix FROM sess")
def q_sessionize(spark, d):
    return sessions.sessions(V.dialogue_rows(spark, d)).select("file", "row_ix", "session_ix")


@query(f"WITH {V.ROWS} SELECT file, CAST(session_ix AS BIGINT) AS session_ix, CAST(chunk_in_session AS INT) AS chunk_in_session, row_start, row_end, rows FROM chunk_")
def q_chunk_boundaries(spark, d):
    r = sessions.chunks(sessions.sessions(V.dialogue_rows(spark, d)), 2)
    return sessions.assemble(r).select("file", "session_ix", "chunk_in_session", "row_start", "row_end", "rows")


@query(f"WITH {V.ROWS}, p AS (SELECT file, session_ix, count(*) AS n FROM sess GROUP BY ALL) SELECT file, CAST(sum((n + 1) // 2) AS BIGINT) AS chunks, count(*) AS sessions FROM p GROUP BY file")
def q_chunk_count(spark, d):
    return sessions.chunk_count(sessions.sessions(V.dialogue_rows(spark, d)), 2)


@query(f"WITH {V.ROWS} SELECT row_start, CAST(n_turns AS INT) AS n_turns, coalesce(dialogue, '') AS dialogue FROM chunk_")
def q_dialogue_assembly(spark, d):
    r = sessions.chunks(sessions.sessions(V.dialogue_rows(spark, d)), 2)
    return sessions.assemble(r).select("row_start", "n_turns", "dialogue")


@query(f"""WITH {V.ROWS} SELECT row_start, nullif(last_value(CASE WHEN case_state = 'ready' THEN document END IGNORE NULLS) OVER (PARTITION BY file, reviewer ORDER BY row_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS old_document FROM state_""")
def q_inherit_by_reviewer(spark, d):
    return sessions.generate_cases(V.dialogue_rows(spark, d), 2).select("row_start", "old_document")


_SEGMENT = "seg AS (SELECT *, sum(chg) OVER (PARTITION BY file ORDER BY row_start) AS segment FROM (SELECT *, CASE WHEN reviewer IS NOT DISTINCT FROM lag(reviewer) OVER (PARTITION BY file ORDER BY row_start) THEN 0 ELSE 1 END AS chg FROM state_))"


@query(f"""WITH {V.ROWS}, {_SEGMENT} SELECT row_start, last_value(CASE WHEN case_state = 'ready' AND document <> '' THEN document END IGNORE NULLS) OVER (PARTITION BY file, segment ORDER BY row_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_document FROM seg""")
def q_inherit_reset(spark, d):
    return sessions.generate_cases(V.dialogue_rows(spark, d), 2, memory="sequential").select("row_start", "old_document")


@query("""SELECT user_id AS reviewer, event_id, CAST(sum(chg) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment
FROM (SELECT user_id, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS chg FROM events)""")
def q_reviewer_runs(spark, d):
    r = V.event_rows(spark, d)
    return sessions.reviewer_runs(r, reviewer="event_type", file="reviewer", order="ix").select("reviewer", F.col("ix").alias("event_id"), "segment")


@query(f"""WITH {V.ROWS} SELECT CASE WHEN n_turns = 0 THEN 'skipped' WHEN case_state = 'skip' THEN 'missed' ELSE 'case' END AS kind, case_state AS case_status, count(*) AS n FROM state_ GROUP BY ALL""")
def q_cases_ready_missed(spark, d):
    return sessions.generate_cases(V.dialogue_rows(spark, d), 2).groupBy("kind", F.col("state.case").alias("case_status")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.RES}, m AS (SELECT count(*) FILTER (event_id % 4 = 1) AS quality, count(*) FILTER (event_id % 4 = 0) AS infrastructure, count(*) FILTER (event_id % 4 > 1) AS unknown_ FROM events),
r AS (SELECT count(*) AS total, count(*) FILTER (ok) AS scored, CAST(sum(score_milli) FILTER (ok) AS BIGINT) AS milli FROM res)
SELECT total, scored, total - scored AS judge_failures, milli / 1000 / scored AS conditional_avg_score, total AS ready_cases, quality AS quality_failures, infrastructure AS infrastructure_failures, unknown_ AS unknown_chunks,
total / (total + quality) AS extraction_coverage, (total + quality) / (total + quality + infrastructure) AS infrastructure_success_rate, milli / 1000 / (scored + quality) AS end_to_end_score, scored + quality AS end_to_end_denominator,
false AS run_complete, false AS replacement_eligible FROM r, m""")
def q_run_quality(spark, d):
    m = F.col("event_id") % 4
    missed = V.table(spark, d, "events").select(F.when(m == 0, "failed").when(m == 1, "success").otherwise("not_attempted").alias("call_status"), F.when(m == 1, "empty").otherwise("not_attempted").alias("parse_status"))
    return results.run_quality(V.results(spark, d), missed)


_AB = f"{V.RES_A}, {V.RES_B}, pr AS (SELECT a.case_id, a.reviewer, b.score_milli - a.score_milli AS delta_milli, b.score_milli + 50 < a.score_milli AS regressed, a.error_tags AS ta, b.error_tags AS tb FROM res_a a JOIN res_b b USING (case_id) WHERE a.ok AND b.ok)"
_NEW = "list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x) AND x IN ('privacy_sensitive', 'hallucination', 'wrong_fact')))"


def _deltas(spark, d):
    return gate.paired_deltas(V.results(spark, d, "a"), V.results(spark, d, "b"))


@query(f"WITH {_AB} SELECT count(*) AS cases, count(DISTINCT reviewer) AS clusters, sum(delta_milli) / count(*) / 1000 AS mean_delta, count(*) FILTER (regressed) / count(*) AS regression_rate, count(*) FILTER (len({_NEW}) > 0) AS critical_cases FROM pr")
def q_paired_delta(spark, d):
    return gate.gate_summary(_deltas(spark, d))


@query(f"WITH {_AB} SELECT case_id, delta_milli FROM pr WHERE regressed")
def q_regressions(spark, d):
    return _deltas(spark, d).where("regressed").select("case_id", "delta_milli")


@query(f"WITH {_AB} SELECT case_id, array_to_string({_NEW}, ',') AS new_critical FROM pr WHERE len({_NEW}) > 0")
def q_new_critical_tags(spark, d):
    return _deltas(spark, d).where("size(new_critical) > 0").select("case_id", F.array_join("new_critical", ",").alias("new_critical"))


@query(f"WITH {_AB} SELECT 'reviewer:' || reviewer AS cluster, sum(delta_milli) / count(*) / 1000 AS mean_delta, count(*) AS cases FROM pr GROUP BY reviewer")
def q_cluster_means(spark, d):
    return gate.cluster_means(_deltas(spark, d))


@query(f"""WITH {_AB}, s AS (SELECT count(*) AS cases, count(DISTINCT reviewer) AS clusters, sum(delta_milli) / count(*) / 1000 AS mean_delta, count(*) FILTER (regressed) / count(*) AS regression_rate, count(*) FILTER (len({_NEW}) > 0) AS critical_cases FROM pr),
t AS (SELECT concat_ws('; ', CASE WHEN mean_delta + 1e-12 < 0.03 THEN 'gain too small' END, CASE WHEN cases < 8 OR clusters < 2 THEN 'too few cases or clusters' END, CASE WHEN regression_rate > 0.1 THEN 'too many regressions' END, CASE WHEN critical_cases > 0 THEN 'new critical errors' END) AS reasons FROM s)
SELECT reasons, reasons = '' AS accepted FROM t""")
def q_gate_decision(spark, d):
    return gate.gate_decision(gate.gate_summary(_deltas(spark, d))).select(F.array_join("reasons", "; ").alias("reasons"), "accepted")


@query(f"""WITH {_AB}, c AS (SELECT 'reviewer:' || reviewer AS cluster, sum(delta_milli) / count(*) / 1000 AS mean_delta FROM pr GROUP BY reviewer), p AS (SELECT *, row_number() OVER (ORDER BY sha256(cluster), cluster) AS place, count(*) OVER () AS n FROM c),
m AS (SELECT s.i AS sample, sum(p.mean_delta) / max(p.n) AS mean FROM range(2000) s(i), p d JOIN p ON p.place = CAST('0x' || substr(sha256('validation|' || s.i || '|' || d.place), 1, 8) AS BIGINT) % d.n + 1 GROUP BY 1)
SELECT (SELECT round(avg(mean_delta), 6) FROM c) AS point, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper FROM m""")
def q_bootstrap_ci(spark, d):
    found = gate.bootstrap_interval(gate.cluster_means(_deltas(spark, d)), "validation")
    return found.select(*[F.round(c, 6).alias(c) for c in ("point", "lower", "upper")])


_SPLIT = "p AS (SELECT who, row_number() OVER (ORDER BY sha256('split|' || who)) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS who FROM customer)), q AS (SELECT who, CASE WHEN n <= total - 2 * CAST(round_even(total * 0.2, 0) AS INT) THEN 'train' WHEN n <= total - CAST(round_even(total * 0.2, 0) AS INT) THEN 'validation' ELSE 'test' END AS part FROM p)"


@query(f"WITH {_SPLIT} SELECT c_custkey, part FROM customer JOIN q ON who = CAST(c_nationkey AS VARCHAR)")
def q_holdout_split(spark, d):
    return gate.holdout_split(V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("reviewer"))).select("c_custkey", "part")


@query(f"WITH {_SPLIT} SELECT part, count(DISTINCT who) AS reviewers, count(*) AS rows FROM customer JOIN q ON who = CAST(c_nationkey AS VARCHAR) GROUP BY part")
def q_split_counts(spark, d):
    return gate.part_counts(gate.holdout_split(V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("reviewer"))))


def _pairs(spark, d):
    return stability.pair_runs(V.results(spark, d, "b"), V.results(spark, d, "a"), ["case_id"])


def _compared(spark, d):
    return stability.compare_pairs(_pairs(spark, d), DIMENSIONS)


_DIMS_MOVED = " + ".join(f"CAST(c.{x} <> b.{x} AS INT)" for x in DIMENSIONS)
_CB = f"""{V.RES_A}, {V.RES_B}, st AS (SELECT case_id, c.score_milli AS cs, b.score_milli AS bs, c.score_milli - b.score_milli AS delta, {_DIMS_MOVED} AS changed_dims,
list_filter(c.error_tags, lambda x: NOT list_contains(b.error_tags, x)) AS added, list_filter(b.error_tags, lambda x: NOT list_contains(c.error_tags, x)) AS removed,
c.n_diagnostics <> b.n_diagnostics AS chg_diag, len(list_intersect(c.error_tags, b.error_tags)) AS both_tags, c.error_tags AS ct, b.error_tags AS bt FROM res_b c JOIN res_a b USING (case_id) WHERE c.ok AND b.ok),
fl AS (SELECT *, abs(delta) > 10 AS chg_score, changed_dims > 0 AS chg_dim, len(added) + len(removed) > 0 AS chg_tags FROM st)"""


@query(f"""WITH {_CB}, n AS (SELECT (SELECT count(*) FROM res_b) AS current_keys, (SELECT count(*) FROM res_a) AS baseline_keys, (SELECT count(*) FROM res_b JOIN res_a USING (case_id)) AS matched,
(SELECT count(*) FROM res_b ANTI JOIN res_a USING (case_id)) AS current_only, (SELECT count(*) FROM res_a ANTI JOIN res_b USING (case_id)) AS baseline_only),
m AS (SELECT count(*) AS common, sum(cs) / count(*) / 1000 AS current_avg, sum(bs) / count(*) / 1000 AS baseline_avg, sum(abs(delta)) / count(*) / 1000 AS avg_abs_delta, max(abs(delta)) / 1000 AS max_abs_delta,
count(*) FILTER (abs(delta) <= 10) / count(*) AS score_exact_rate, count(*) FILTER (NOT chg_tags) / count(*) AS tag_exact_rate, count(*) FILTER (chg_score OR chg_dim OR chg_tags OR chg_diag) AS unstable,
count(*) FILTER (NOT (chg_score OR chg_dim OR chg_tags OR chg_diag)) AS stable FROM fl) SELECT n.*, m.*, matched - common AS failure_pairs FROM n, m""")
def q_stability_summary(spark, d):
    pairs = _pairs(spark, d)
    return stability.stability_summary(pairs, stability.compare_pairs(pairs, DIMENSIONS))


@query(f"""WITH {_CB} SELECT case_id, delta AS delta_milli, changed_dims, CASE WHEN len(ct) + len(bt) = 0 THEN 1.0 ELSE both_tags / (len(ct) + len(bt) - both_tags) END AS tag_jaccard,
100 * CAST(chg_score AS INT) + 80 * CAST(chg_dim AS INT) + 60 * CAST(chg_tags AS INT) + 40 * CAST(chg_diag AS INT) AS priority FROM fl""")
def q_stability_pairs(spark, d):
    return _compared(spark, d).select("case_id", "delta_milli", "changed_dims", "tag_jaccard", "priority")


@query(f"""WITH {_CB} SELECT case_id, 100 * CAST(chg_score AS INT) + 80 * CAST(chg_dim AS INT) + 60 * CAST(chg_tags AS INT) + 40 * CAST(chg_diag AS INT) AS priority FROM fl
ORDER BY priority DESC, abs(delta) DESC, CASE WHEN len(ct) + len(bt) = 0 THEN 1.0 ELSE both_tags / (len(ct) + len(bt) - both_tags) END, changed_dims DESC, case_id LIMIT 50""")
def q_most_unstable(spark, d):
    return stability.most_unstable(_compared(spark, d), ["case_id"], 50).select("case_id", "priority")


_GAPS = " UNION ALL ".join(f"SELECT '{x}' AS dimension, abs(c.{x} - b.{x}) AS gap FROM res_b c JOIN res_a b USING (case_id) WHERE c.ok AND b.ok" for x in DIMENSIONS)


@query(f"WITH {V.RES_A}, {V.RES_B}, g AS ({_GAPS}) SELECT dimension, sum(gap) / count(*) / 10 AS avg_abs_delta, max(gap) / 10 AS max_abs_delta, count(*) FILTER (gap * 100 <= 10) / count(*) AS exact_rate FROM g GROUP BY dimension")
def q_dim_drift(spark, d):
    return stability.dimension_drift(_compared(spark, d), DIMENSIONS)


@query(f"WITH {_CB}, t AS (SELECT unnest(added) AS tag, 1 AS p, 0 AS m FROM fl UNION ALL SELECT unnest(removed), 0, 1 FROM fl) SELECT tag, CAST(sum(p) AS BIGINT) AS added, CAST(sum(m) AS BIGINT) AS removed FROM t GROUP BY tag")
def q_tag_drift(spark, d):
    return stability.tag_drift(_compared(spark, d))


@query(f"""WITH {_CB}, k AS (SELECT 'score' AS kind FROM fl WHERE chg_score UNION ALL SELECT 'dimension' FROM fl WHERE chg_dim UNION ALL SELECT 'tags' FROM fl WHERE chg_tags UNION ALL SELECT 'diagnostics' FROM fl WHERE chg_diag)
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def q_instability_types(spark, d):
    return stability.instability_kinds(_compared(spark, d))


def _dist(name: str) -> str:
    return f"d_{name} AS (SELECT i AS bin, coalesce(n / total, 0.0) AS share FROM range(11) r(i) LEFT JOIN (SELECT CAST(round_even(score_milli / 500, 0) AS INT) AS bin, count(*) AS n, sum(count(*)) OVER () AS total FROM {name} WHERE ok GROUP BY 1) x ON x.bin = i)"


@query(f"WITH {V.RES}, {_dist('res')} SELECT CAST(bin AS INT) AS bin, CAST(share AS DOUBLE) AS share FROM d_res")
def q_score_distribution(spark, d):
    return stability.distribution(V.results(spark, d))


@query(f"""WITH {V.RES_A}, {V.RES_B}, {_dist('res_a')}, {_dist('res_b')}, j AS (SELECT CAST(c.share AS DOUBLE) AS p, CAST(b.share AS DOUBLE) AS q FROM d_res_b c JOIN d_res_a b USING (bin))
SELECT round(sum(CASE WHEN p > 0 THEN p * ln((p + 1e-9) / (q + 1e-9)) ELSE 0 END), 6) AS kl,
round((sum(CASE WHEN p > 0 THEN p * ln((p + 1e-9) / ((p + q) / 2 + 1e-9)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln((q + 1e-9) / ((p + q) / 2 + 1e-9)) ELSE 0 END)) / 2, 6) AS js FROM j""")
def q_kl_js(spark, d):
    return stability.divergences(stability.distribution(V.results(spark, d, "b")), stability.distribution(V.results(spark, d, "a")))


def _sources(spark, d):
    return compare.pair_by_source(*[V.results(spark, d, s).withColumnRenamed("case_id", "source_key") for s in "ab"], "source_key").withColumn("verdict", compare.verdict())


_V = f"""{V.RES_A}, {V.RES_B}, v AS (SELECT coalesce(a.case_id, b.case_id) AS source_key, CASE WHEN a.case_id IS NULL THEN 'B only' WHEN b.case_id IS NULL THEN 'A only' WHEN NOT a.ok OR NOT b.ok THEN 'not comparable'
WHEN a.output = b.output THEN 'same output' WHEN b.score_milli - a.score_milli > 50 THEN 'B better' WHEN b.score_milli - a.score_milli < -50 THEN 'A better' ELSE 'tie' END AS verdict, b.score_milli - a.score_milli AS delta
FROM res_a a FULL JOIN res_b b ON a.case_id = b.case_id)"""


@query(f"WITH {_V} SELECT source_key, verdict, delta AS delta_milli FROM v")
def q_ab_verdict(spark, d):
    return _sources(spark, d).select("source_key", "verdict", F.expr("b.score_milli - a.score_milli").alias("delta_milli"))


@query(f"WITH {_V} SELECT l AS verdict, count(source_key) AS n FROM (SELECT unnest(['A only','B only','not comparable','same output','B better','A better','tie']) AS l) LEFT JOIN v ON v.verdict = l GROUP BY l")
def q_ab_winner_counts(spark, d):
    return compare.winner_counts(_sources(spark, d))


_SUM = " UNION ALL ".join(f"SELECT '{x}' AS dimension, a.{x} AS av, CASE WHEN a.output = b.output THEN a.{x} ELSE b.{x} END AS bv FROM res_a a JOIN res_b b USING (case_id) WHERE a.ok AND b.ok" for x in DIMENSIONS)


@query(f"WITH {V.RES_A}, {V.RES_B}, s AS ({_SUM}) SELECT dimension, count(*) AS pairs, sum(av) / count(*) / 10 AS avg_a, sum(bv) / count(*) / 10 AS avg_b, sum(bv - av) / count(*) / 10 AS delta FROM s GROUP BY dimension")
def q_ab_dim_summary(spark, d):
    return compare.dimension_summary(_sources(spark, d), DIMENSIONS)


@query(f"""WITH {_V}, o AS (SELECT CASE verdict WHEN 'B better' THEN 1 WHEN 'A better' THEN -1 WHEN 'tie' THEN 0 WHEN 'same output' THEN 0 END AS x FROM v)
SELECT count(x) AS decided, count(*) FILTER (x = 1) / count(x) AS b_win_rate, count(*) FILTER (x = -1) / count(x) AS a_win_rate, count(*) FILTER (x = 0) / count(x) AS tie_rate, sum(x) / count(x) AS net_preference FROM o""")
def q_ab_pref_rates(spark, d):
    return compare.preference_rates(_sources(spark, d))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def q_duplicate_source_keys(spark, d):
    return compare.duplicate_keys([V.table(spark, d, "lineitem").select("l_orderkey"), V.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))], "l_orderkey")


@query(f"""WITH {V.RES_A}, {V.RES_B}, x AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY ix) AS position FROM res_a), y AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY ix) AS position FROM res_b)
SELECT model_name, position, x.case_id AS case_a, y.case_id AS case_b FROM x JOIN y USING (model_name, position)""")
def q_positional_zip(spark, d):
    z = compare.zip_by_position(V.results(spark, d, "a"), V.results(spark, d, "b"), "ix", "model_name")
    return z.select("model_name", "position", F.col("a.case_id").alias("case_a"), F.col("b.case_id").alias("case_b"))


@query(f"""WITH {V.RES}, c AS (SELECT ix, case_id, CASE WHEN ix % 2 = 0 THEN model_name ELSE 'other' END AS model_name FROM res WHERE ix % 3 <> 0)
SELECT res.case_id, CASE WHEN e.ix IS NOT NULL THEN 'exact' WHEN l.ix IS NOT NULL THEN 'loose' ELSE 'none' END AS match_level, coalesce(e.ix, l.ix) AS case_ix
FROM res LEFT JOIN c e ON e.case_id = res.case_id AND e.model_name = res.model_name LEFT JOIN c l ON l.case_id = res.case_id""")
def q_match_two_level(spark, d):
    r = V.results(spark, d).select("ix", "case_id", "model_name")
    cases = r.where("ix % 3 <> 0").select(F.col("ix").alias("case_ix"), "case_id", F.when(F.col("ix") % 2 == 0, F.col("model_name")).otherwise("other").alias("model_name"))
    m = compare.match_two_levels(r, cases, ["case_id", "model_name"], ["case_id"], "case_ix")
    return m.select("case_id", "match_level", F.coalesce("exact_case.case_ix", "loose_case.case_ix").alias("case_ix"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_linenumber % 3 <> 0),
b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_linenumber % 2 = 1), j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.n, b.n) AS n, a.l_partkey AS part_a, b.l_partkey AS part_b FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.n = b.n)
SELECT *, n = max(n) OVER (PARTITION BY l_orderkey) AS boundary FROM j""")
def q_chunk_diff_rows(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("o"), "l_linenumber")
    j = compare.chunk_rows(rows.where("l_linenumber % 3 <> 0"), rows.where("l_linenumber % 2 = 1"), ["l_orderkey"], "o")
    return j.select("l_orderkey", "n", F.col("a.l_partkey").alias("part_a"), F.col("b.l_partkey").alias("part_b"), "boundary")


@query(f"""WITH {V.RES}, t AS (SELECT case_id, ix, score_milli, CASE WHEN NOT ok THEN 0 ELSE 1 END AS urgency FROM res WHERE NOT ok OR fatal OR score_milli < 1500 OR len(error_tags) > 0 OR n_diagnostics > 0)
SELECT case_id, urgency, row_number() OVER (ORDER BY urgency, CASE WHEN urgency = 0 THEN -1 ELSE score_milli END, ix) AS position FROM t""")
def q_triage(spark, d):
    return evidence.triage(V.results(spark, d), 1500).select("case_id", "urgency", "position")


@query(f"""WITH {V.RES}, s AS (SELECT *, CAST(fatal AS INT) * 100 + CAST(round_even((5000 - score_milli) / 100, 0) AS INT) + len(error_tags) * 5 + n_diagnostics * 3 AS severity,
fatal OR len(error_tags) > 0 OR n_diagnostics > 0 OR score_milli < 4000 AS issue FROM res WHERE ok)
SELECT * FROM (SELECT case_id, 'issue' AS kind FROM s WHERE issue ORDER BY severity DESC, ix LIMIT 40) UNION ALL SELECT * FROM (SELECT case_id, 'positive' FROM s WHERE NOT issue ORDER BY score_milli DESC, ix LIMIT 10)""")
def q_evidence_topk(spark, d):
    return evidence.evidence_top(V.results(spark, d), 50, 10).select("case_id", "kind")


@query(f"""WITH {_V} SELECT source_key, verdict FROM v ORDER BY CASE verdict WHEN 'A better' THEN 0 WHEN 'B better' THEN 1 WHEN 'A only' THEN 2 WHEN 'B only' THEN 3 WHEN 'not comparable' THEN 4 ELSE 5 END, coalesce(abs(delta), 0) DESC, source_key LIMIT 30""")
def q_representative_evidence(spark, d):
    return evidence.representative(_sources(spark, d), 30).select("source_key", "verdict")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def q_recent_per_group(spark, d):
    return evidence.top_per_group(V.table(spark, d, "events"), "user_id", [F.desc("ts"), F.col("event_id")], 3).select("user_id", "event_id")


@query("""WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, unnest(string_split(replace(text, ' the ', ' a '), chr(10))) AS line FROM documents),
co AS (SELECT doc_id, line, count(*) AS was FROM o WHERE trim(line) <> '' GROUP BY ALL), cn AS (SELECT doc_id, line, count(*) AS now_ FROM n WHERE trim(line) <> '' GROUP BY ALL)
SELECT coalesce(co.doc_id, cn.doc_id) AS doc_id, CAST(sum(least(coalesce(was, 0), coalesce(now_, 0))) AS BIGINT) AS retained, CAST(sum(greatest(coalesce(now_, 0) - coalesce(was, 0), 0)) AS BIGINT) AS added,
CAST(sum(greatest(coalesce(was, 0) - coalesce(now_, 0), 0)) AS BIGINT) AS removed FROM co FULL JOIN cn ON co.doc_id = cn.doc_id AND co.line = cn.line GROUP BY 1""")
def q_line_bag_diff(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return compare.line_bag_diff(docs, docs.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" a "))), "doc_id", "text")


@query(r"""WITH t AS (SELECT page_id, '## ' || page_id || '.  "Rule   ' || split_part(url, '/', 3) || '".' AS x FROM pages)
SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '^((#{1,6}|[-*+]|[0-9]+[.)])\s*)+', ''), '^["''`.,;:!?]+|["''`.,;:!?]+$', '', 'g'), '\s+', ' ', 'g'))) AS ref FROM t""")
def q_ref_normalise(spark, d):
    x = F.concat(F.lit("## "), F.col("page_id").cast("string"), F.lit('.  "Rule   '), F.element_at(F.split("url", "/"), 3), F.lit('".'))
    return V.table(spark, d, "pages").select("page_id", texts.normalise_reference(x).alias("ref"))


@query(f"WITH {V.RES} SELECT case_id, CAST(score_milli AS BIGINT) AS score_milli FROM res")
def q_weighted_total(spark, d):
    return V.results(spark, d).select("case_id", C.weighted_total(F.col("dims"), WEIGHTS).alias("score_milli"))


_TURNS = """t AS (SELECT conv_id, '[' || string_agg('{"content":' || to_json(coalesce(text, '')) || ',"metadata":{"at":' || CAST(turn * 1e-5 AS DOUBLE) || ',"turn":' || turn || '},"role":' || to_json(role) || '}', ',' ORDER BY turn) || ']' AS dialogue, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, sha256('{"candidate_output":"","dialogue":' || dialogue || ',"instructions":"keep \\"it\\" short","old_memory":"- m' || conv_id % 7 || '\\n","reasoning":"","reference_output":"","session_id":' || CASE WHEN conv_id % 3 = 0 THEN 'null' ELSE '"s' || conv_id || '"' END || ',"task_type":"user_md","turn_range":[' || first || ',' || last || ']}') AS hash FROM t)"""


def _cases(spark, d):
    turns = V.table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"), F.struct("turn", (F.col("turn") * F.lit(1e-5)).alias("at")).alias("metadata")).alias("t"))
    cases = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return cases.select(
        "conv_id", F.lit("user_md").alias("task_type"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("session_id"),
        F.concat(F.lit("- m"), (F.col("conv_id") % 7).cast("string"), F.lit("\n")).alias("old_memory"), F.lit('keep "it" short').alias("instructions"), F.lit(None).cast("string").alias("candidate_output"),
        F.lit("").alias("reference_output"), F.lit(None).cast("string").alias("reasoning"), F.array(F.col("ts")[0]["turn"], F.element_at("ts", -1)["turn"]).alias("turn_range"), F.col("ts").alias("dialogue"),
    )


@query(f"WITH {_TURNS} SELECT conv_id, hash FROM h")
def q_case_hash(spark, d):
    cases = _cases(spark, d)
    return cases.select("conv_id", canonical.case_input_hash(cases).alias("hash"))


_CONFIG = """'{"dimensions":["a' || ix % 4 || '","b"],"judge_model":' || to_json(model_name) || ',"max_tokens":' || CASE WHEN ix % 5 = 0 THEN 'null' ELSE CAST(ix % 9 * 1000 AS VARCHAR) END || ',"mock":' || (ix % 2 = 0) || ',"temperature":' || CAST(ix % 11 / 10 AS DOUBLE) || ',"top_p":' || CAST(ix * 1e-7 AS DOUBLE) || ',"weights":{"' || CASE WHEN ix % 2 = 0 THEN 'x":1,"y":2' ELSE 'x":2,"y":1' END || '}}'"""


def _configs(spark, d):
    k, r = F.col("ix"), V.results(spark, d)
    return r.withColumn("config", F.struct(
        F.create_map(F.lit("y"), F.when(k % 2 == 0, 2).otherwise(1), F.lit("x"), F.when(k % 2 == 0, 1).otherwise(2)).alias("weights"), (k * F.lit(1e-7)).alias("top_p"), (k % 11 / 10).alias("temperature"), (k % 2 == 0).alias("mock"),
        F.when(k % 5 != 0, k % 9 * 1000).alias("max_tokens"), F.col("model_name").alias("judge_model"), F.array(F.concat(F.lit("a"), (k % 4).cast("string")), F.lit("b")).alias("dimensions"),
    ))


@query(f"WITH {V.RES} SELECT case_id, sha256({_CONFIG}) AS hash FROM res")
def q_config_hash(spark, d):
    rows = _configs(spark, d)
    return rows.select("case_id", canonical.config_hash(F.col("config"), rows.schema["config"].dataType).alias("hash"))


@query(f"""WITH {V.RES}, {_TURNS}, c AS (SELECT ix, sha256({_CONFIG}) AS config FROM res)
SELECT ix, sha256('{{"case_input_hash":"' || coalesce(h.hash, '') || '","scoring_config_hash":"' || config || '"}}') AS fingerprint, CASE WHEN ix % 6 = 0 THEN '' ELSE sha1('prompt ' || ix) END AS prompt FROM c LEFT JOIN h ON h.conv_id = c.ix""")
def q_evaluation_fingerprint(spark, d):
    rows, cases = _configs(spark, d), _cases(spark, d)
    hashes = cases.select(F.col("conv_id").alias("ix"), canonical.case_input_hash(cases).alias("hash"))
    config = canonical.config_hash(F.col("config"), rows.schema["config"].dataType)
    prompt = F.when(F.col("ix") % 6 != 0, F.concat(F.lit("prompt "), F.col("ix").cast("string")))
    return rows.select("ix", config.alias("config"), canonical.prompt_hash(prompt).alias("prompt")).join(hashes, "ix", "left").select("ix", canonical.evaluation_fingerprint(F.col("hash"), F.col("config")).alias("fingerprint"), "prompt")


@query(f"WITH {V.RES} SELECT case_id, substr(sha256(case_id), 2, 1) IN ('1','3','5','7','9','b','d','f') AS swap FROM res")
def q_stable_swap(spark, d):
    return V.results(spark, d).select("case_id", C.stable_swap(F.col("case_id")).alias("swap"))


@query(r"""SELECT event_id, array_to_string(list_distinct_ordered, ',') AS rules FROM (SELECT event_id, list_filter([r1, r2], lambda x, i: i = 1 OR r1 <> r2) AS list_distinct_ordered
FROM (SELECT event_id, 'R' || (event_id % 9) AS r1, 'R' || (event_id % 4) AS r2 FROM events))""")
def q_rule_ids(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit("see R"), (e % 9).cast("string"), F.lit(", XR77 and (R"), (e % 4).cast("string"), F.lit(")"))
    return V.table(spark, d, "events").select("event_id", F.array_join(C.rule_ids(text), ",").alias("rules"))


@query("SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS preview FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS t FROM documents)")
def q_preview(spark, d):
    return V.table(spark, d, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 110) || chr(10) || '...' || chr(10) || right(text, 90) ELSE text END AS short FROM documents")
def q_shorten(spark, d):
    return V.table(spark, d, "documents").select("doc_id", C.head_and_tail(F.col("text"), 200).alias("short"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_fields(spark, d):
    return V.table(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"))


@query(f"WITH {V.RES} SELECT case_id, CASE WHEN NOT ok THEN 'score_total is not a number' WHEN ix % 6 = 1 THEN 'coverage out of range' WHEN ix % 5 = 2 THEN 'comment is empty' END AS error FROM res")
def q_judge_validate(spark, d):
    r = V.results(spark, d)
    dims = {n: F.element_at("dims", F.lit(n)) / 10 for n in DIMENSIONS}
    dims["coverage"] = F.when(F.col("ix") % 6 == 1, 9.0).otherwise(dims["coverage"])
    total = F.when(C.eligible(), (F.col("score_milli") / F.lit(1000)).cast("decimal(10,3)").cast("string")).otherwise('"high"')
    raw = F.concat(F.lit('{"score_total": '), total, F.lit(', "scores": '), F.to_json(F.struct(*[v.alias(n) for n, v in dims.items()])), F.lit(', "comment": "'), F.when(F.col("ix") % 5 == 2, " ").otherwise("fine"), F.lit('", "fatal_error": false, "error_tags": '), F.to_json("error_tags"), F.lit("}"))
    return r.withColumn("raw", raw).select("case_id", evidence.judge_errors("raw", DIMENSIONS).alias("error"))


@query("""WITH w AS (SELECT event_type AS scope, event_id AS id, epoch_us(ts) AS us, least(10, CAST(event_id % 5 AS INT) + CAST(floor((1706745600 - epoch(ts)) / 90000) AS INT)) AS effective FROM events)
SELECT scope, id, effective FROM w QUALIFY row_number() OVER (PARTITION BY scope ORDER BY effective DESC, us, id) = 1""")
def q_rate_slot_pick(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("enqueued_at"), (F.col("event_id") % 5).cast("int").alias("priority"))
    return evidence.rate_slots(e, F.lit(1706745600), 30000.0)


_OUT = "CASE event_id % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'empty' WHEN 2 THEN 'unparsed' ELSE 'failed' END"


@query("SELECT user_id AS reviewer, event_id AS ix, last_value(CASE WHEN event_id % 4 = 0 THEN 'doc ' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holds FROM events")
def q_state_fold(spark, d):
    return streams.fold_documents(V.event_rows(spark, d), "reviewer", "ix").select("reviewer", "ix", "holds")


_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _stream(spark, d):
    return streams.event_stream(spark, d, "events.parquet", _EVENT)


@query("SELECT user_id AS reviewer, max(CASE WHEN event_id % 4 = 0 THEN event_id END) AS last_parsed, count(*) AS n FROM events GROUP BY user_id")
def q_state_fold_stream(spark, d):
    m = F.col("event_id") % 4
    rows = _stream(spark, d).select(F.col("user_id").alias("reviewer"), F.col("event_id").alias("ix"), F.when(m == 0, "parsed").otherwise("empty").alias("outcome"), F.col("event_id").cast("string").alias("document"))
    out = streams.run_to_end(streams.fold_stream(rows), "update")
    return out.groupBy("reviewer").agg(F.max_by("holds", "n").cast("long").alias("last_parsed"), F.max("n").alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_tumbling(spark, d):
    return streams.run_to_end(streams.tumbling(_stream(spark, d), "1 day"), "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""WITH s AS (SELECT time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * i) AS start FROM events, range(2) r(i)) SELECT strftime(start, '%Y-%m-%d %H') AS start, count(*) AS n FROM s GROUP BY 1""")
def q_stream_sliding(spark, d):
    return streams.run_to_end(streams.sliding(_stream(spark, d), "12 hours", "6 hours"), "complete").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '1 hour' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q_stream_session(spark, d):
    out = streams.run_to_end(streams.by_session(_stream(spark, d), "1 hour"), "complete")
    return out.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS day FROM events) GROUP BY ALL")
def q_stream_dedup(spark, d):
    rows = _stream(spark, d).withColumn("day", F.to_date("ts")).dropDuplicates(["event_type", "user_id", "day"]).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return streams.run_to_end(rows, "complete")


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'orders only', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'any', count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem)")
def q_set_ops(spark, d):
    o, x = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    sides = {"both": o.intersect(x), "orders only": o.subtract(x), "any": o.union(x).distinct()}
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n") for name, df in sides.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(f"""WITH {V.RES} SELECT case_id, model_name, prompt_version, CASE WHEN ok THEN CAST((score_milli + 5) // 1000 AS VARCHAR) || '.' || lpad(CAST((score_milli + 5) // 10 % 100 AS VARCHAR), 2, '0') ELSE '未评分' END AS score_display, status, fatal, array_to_string(list_sort(error_tags), '、') AS tags, {", ".join(f"CAST({x} AS INT) AS score_{x}" for x in DIMENSIONS)} FROM res""")
def q_export_flat(spark, d):
    return results.flat_export(V.results(spark, d), DIMENSIONS)


PARSED_BODY = r"""f AS (SELECT *, regexp_replace(body, '^\s+|\s+$', '', 'g') AS s FROM p),
u AS (SELECT *, CASE WHEN regexp_matches(s, '(?is)^```(?:markdown|md|text|json)?[ \t]*\r?\n?(.*?)\r?\n?```$') THEN regexp_extract(s, '(?is)^```(?:markdown|md|text|json)?[ \t]*\r?\n?(.*?)\r?\n?```$', 1) ELSE s END AS t FROM f),
n AS (SELECT *, list_transform(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS ls FROM u),
o AS (SELECT *, list_position(list_transform(ls, lambda x: x <> '' AND NOT regexp_full_match(regexp_replace(x, '^\s+', ''), '(?i)(?:#{1,6}\s*(?:Output|输出|USER\.md)\s*[:：]?|---+\s*USER\.md\s*---+|(?:\*{1,2}|_{1,2})?(?:Output|输出)(?:\*{1,2}|_{1,2})?\s*[:：]?)')), true) AS first FROM n)
SELECT doc_id, method, confidence, warned, CASE WHEN body IS NOT NULL THEN sha256(CASE WHEN first IS NULL OR first = 0 THEN '' ELSE regexp_replace(array_to_string(list_slice(ls, first, len(ls)), chr(10)), '\n+$', '') END) END AS digest FROM o"""


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 12 AS k, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents),
j AS (SELECT *, CASE WHEN k IN (8, 9) THEN string_split(CASE WHEN k = 9 THEN '- first' || chr(10) ELSE '' END || s, chr(10)) END AS ls FROM d),
m AS (SELECT *, CASE WHEN k = 0 THEN 'json:document' WHEN k = 1 THEN 'json:data.result.answer' WHEN k = 2 THEN 'json_document_type_mismatch' WHEN k IN (3, 4) THEN 'document_envelope_v1' WHEN k = 5 THEN 'output_heading' WHEN k = 6 THEN 'document_separator'
WHEN k = 7 THEN 'reasoning_only' WHEN k = 10 THEN 'document_heading' WHEN k = 11 THEN 'none' WHEN k = 8 AND s = '' THEN 'none' WHEN len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*(?:#{{1,6}}[ \t]+\S|第[一二三四五六七八九十]+分区|[一二三四五六七八九十]+、)'))) > 0 THEN 'structured_markdown_fallback'
WHEN len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*(?:[-*•]|\d+[.、])[ \t]+\S'))) > 0 THEN 'list_fallback' ELSE 'unrecognized' END AS method FROM j),
p AS (SELECT doc_id, method, CASE WHEN k = 4 THEN 0.9 WHEN k = 3 THEN 1.0 WHEN k < 2 THEN 0.98 WHEN k IN (5, 6, 10) THEN 0.97 WHEN method = 'structured_markdown_fallback' THEN 0.78 WHEN method = 'list_fallback' THEN 0.7 ELSE 0.0 END AS confidence,
CAST(CASE WHEN k IN (2, 4, 7) OR (k IN (8, 9) AND method <> 'none') THEN 1 ELSE 0 END AS INT) AS warned, CASE WHEN k IN (2, 7) OR method IN ('none', 'unrecognized') THEN NULL WHEN k = 9 THEN '- first' || chr(10) || s WHEN k = 8 THEN s WHEN k = 3 THEN x || chr(10) ELSE x END AS body FROM m),
{PARSED_BODY}""")
def q_doc_parse(spark, d):
    x, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 12
    raw = (
        F.when(k == 0, F.to_json(F.struct(x.alias("document")))).when(k == 1, F.to_json(F.struct(F.struct(F.struct(x.alias("answer")).alias("result")).alias("data"))))
        .when(k == 2, F.to_json(F.struct(F.lit("MEMORY.md").alias("document_type"), x.alias("document")))).when(k == 3, F.concat(F.lit("said\n<<<MEMORY_DOCUMENT_V1:USER.md>>>\n"), x, F.lit("\n<<<END_MEMORY_DOCUMENT_V1>>>\nafter")))
        .when(k == 4, F.concat(F.lit("<<<memory_document_v1:user.md>>> \n"), x)).when(k == 5, F.concat(F.lit("# USER.md\nold\n## Output:\n"), x)).when(k == 6, F.concat(F.lit("Output\nold\n --- USER.md ---\n"), x))
        .when(k == 7, F.concat(F.lit("Reasoning: so\n"), x)).when(k == 8, x).when(k == 9, F.concat(F.lit("- first\n"), x)).when(k == 10, F.concat(F.lit("**Output**\n# USER.md\n"), x)).otherwise(" \n")
    )
    rows = documents.parsed_documents(V.table(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw")
    return rows.select("doc_id", "parsed.method", "parsed.confidence", F.size("parsed.warnings").alias("warned"), F.sha2("parsed.document", 256).alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, string_split(replace('intro' || chr(10) || '# One' || chr(10) || text || chr(10) || '## Two' || chr(10) || '- last', chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l),
g AS (SELECT doc_id, sec, arg_min(line, n) AS first, CAST(length(string_agg(line, chr(10) ORDER BY n)) AS INT) AS length FROM s WHERE sec > 0 GROUP BY ALL)
SELECT doc_id, 'S' || lpad(CAST(sec AS VARCHAR), 3, '0') AS section_id, CAST(length(regexp_extract(first, '^(#+)', 1)) AS INT) AS level, trim(regexp_replace(first, '^#+\s+', '')) AS title, length FROM g""")
def q_sections(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("intro\n# One\n"), F.col("text"), F.lit("\n## Two\n- last")).alias("prompt"))
    return texts.sections(docs, "doc_id", "prompt").select("doc_id", "section_id", "level", "title", F.length("body").alias("length"))


@query()
def q_rule_similarity(spark, d):
    docs = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("g"), "text")
    docs = docs.unionByName(docs.select((F.col("id") + 100000).alias("id"), "g", F.concat("text", F.lit(" more")).alias("text")))
    return prompts.similar_rules(docs, "id", "g", "text")

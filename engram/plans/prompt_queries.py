"""Queries over edits of prompts, beside the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges, patches, prompts
from . import views as V
from .queries import query


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\n\s*\n') AS ps FROM documents)),
q AS (SELECT doc_id, n, regexp_replace(part, '^\s+|\s+$', '', 'g') AS part FROM p), a AS (SELECT doc_id, n, 1 AS k, part AS atom FROM q WHERE part <> '' AND length(part) <= 400
UNION ALL SELECT doc_id, n, k, atom FROM (SELECT doc_id, n, unnest(ls) AS atom, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, n, regexp_split_to_array(part, '\r?\n') AS ls FROM q WHERE length(part) > 400)) WHERE trim(atom) <> ''),
o AS (SELECT doc_id, atom, length(atom) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS rn FROM a),
w AS (SELECT doc_id, rn, atom, CAST(0 AS BIGINT) AS block, CAST(size AS BIGINT) AS held FROM o WHERE rn = 1 UNION ALL
SELECT o.doc_id, o.rn, o.atom, w.block + CASE WHEN o.size > 400 OR w.held > 400 OR w.held + o.size + 2 > 400 THEN 1 ELSE 0 END, CASE WHEN o.size > 400 OR w.held > 400 OR w.held + o.size + 2 > 400 THEN 0 ELSE w.held + 2 END + o.size FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
SELECT doc_id, block, sha256(string_agg(atom, chr(10) || chr(10) ORDER BY rn)) AS digest, length(string_agg(atom, chr(10) || chr(10) ORDER BY rn)) <= 400 AS editable FROM w GROUP BY ALL""")
def q_prompt_blocks(spark, d):
    found = prompts.blocks(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 400)
    return found.select("doc_id", "block", F.sha2("text", 256).alias("digest"), "editable")


@query("""WITH b AS (SELECT user_id, event_id AS block, (CASE WHEN event_type LIKE '%c%' THEN 1 ELSE 0 END) + (CASE WHEN event_type LIKE '%view%' THEN 1 ELSE 0 END) + (CASE WHEN CAST(event_id AS VARCHAR) LIKE '%7%' THEN 1 ELSE 0 END) AS score FROM events WHERE event_id % 3 <> 0)
SELECT user_id, block, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, block) AS place FROM b) WHERE place <= 2""")
def q_ranked_blocks(spark, d):
    e = V.table(spark, d, "events")
    found = e.select("user_id", F.col("event_id").alias("block"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("text"), (F.col("event_id") % 3 != 0).alias("editable"))
    terms = e.select("user_id").distinct().withColumn("terms", F.array(F.lit("C"), F.lit("view"), F.lit("7"), F.lit("7")))
    return prompts.ranked_blocks(found, terms, "user_id").select("user_id", "block", "place")


def _edits(spark, d):
    k = F.col("event_id")
    e = V.table(spark, d, "events")
    edits = e.select(
        (F.col("user_id") % 20).alias("prompt_id"), k.alias("ix"), F.element_at(F.array(F.lit("replace_within_section"), F.lit("remove"), F.lit("append_to_section"), F.lit("move")), (k % 4 + 1).cast("int")).alias("op"), F.concat(F.lit("S"), (k % 5).cast("string")).alias("section_id"),
        F.when(k % 4 < 2, F.concat(F.lit(" old "), (k % 11).cast("string"))).alias("old_text"), F.when(k % 8 == 0, "something new").when(k % 8 == 4, "something else").alias("new_text"),
        F.when(k % 12 == 2, "a\nb\nc\n\nd\ne").when(k % 4 == 2, F.concat(F.lit("rule "), (k % 9).cast("string"))).alias("text"), F.concat(F.lit("why "), (k % 2).cast("string")).alias("reason"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("ref-"), (k % 3).cast("string")))).alias("evidence_refs"),
    )
    body = F.lit("\n".join(f"old {i}" for i in range(10)))
    sections = e.select((F.col("user_id") % 20).alias("prompt_id")).distinct().withColumn("section_id", F.explode(F.array(*[F.lit(f"S{i}") for i in range(4)]))).withColumn("body", body)
    return prompts.checked_edits(edits, sections), sections.groupBy("prompt_id").agg(F.first("body").alias("prompt"))


_EDITS = """e AS (SELECT user_id % 20 AS prompt_id, event_id AS ix, 'S' || event_id % 5 AS section_id, CASE event_id % 4 WHEN 0 THEN 'replace' WHEN 1 THEN 'delete' ELSE 'append' END AS operation, CASE WHEN event_id % 4 < 2 THEN 'old ' || event_id % 11 ELSE '' END AS old_text, 'ref-' || event_id % 3 AS ref,
CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'something new' ELSE 'something else' END WHEN event_id % 4 = 1 THEN 'old ' || event_id % 11 ELSE 'rule ' || event_id % 9 END AS said,
CASE WHEN event_id % 5 = 4 THEN 'no such section' WHEN event_id % 7 = 0 THEN 'no evidence' WHEN event_id % 4 = 3 THEN 'unknown operation' WHEN event_id % 12 = 2 THEN 'too many lines' WHEN event_id % 4 < 2 AND event_id % 11 = 10 THEN 'old text not found' END AS problem FROM events)"""


@query(f"WITH {_EDITS} SELECT ix, problem FROM e")
def q_checked_edits(spark, d):
    return _edits(spark, d)[0].select("ix", "problem")


@query(f"""WITH {_EDITS}, v AS (SELECT *, CASE WHEN operation = 'replace' THEN said <> first_value(said) OVER (PARTITION BY prompt_id, section_id, operation, old_text ORDER BY ix) ELSE false END AS other FROM e WHERE problem IS NULL),
g AS (SELECT prompt_id, section_id, operation, old_text, min(ix) AS ix FROM v WHERE NOT other GROUP BY ALL),
r AS (SELECT prompt_id, section_id, operation, old_text, string_agg(ref, ',' ORDER BY spot) AS refs FROM (SELECT prompt_id, section_id, operation, old_text, ref, min(ix) AS spot FROM v WHERE NOT other GROUP BY ALL) GROUP BY ALL),
t AS (SELECT prompt_id, section_id, operation, old_text, string_agg(said, chr(10) ORDER BY spot) AS said FROM (SELECT prompt_id, section_id, operation, old_text, said, min(ix) AS spot FROM v WHERE NOT other GROUP BY ALL) GROUP BY ALL),
m AS (SELECT g.prompt_id, g.ix, t.said, r.refs, row_number() OVER (PARTITION BY g.prompt_id ORDER BY g.section_id, g.operation, g.ix) AS rank FROM g JOIN r USING (prompt_id, section_id, operation, old_text) JOIN t USING (prompt_id, section_id, operation, old_text))
SELECT prompt_id, ix, CASE WHEN rank <= 40 THEN 'applied' ELSE 'skipped' END AS status, CASE WHEN rank <= 40 THEN '' ELSE 'too many edits' END AS message, said AS final_text, refs FROM m
UNION ALL SELECT prompt_id, ix, 'conflict', 'another replacement came first', said, ref FROM v WHERE other""")
def q_merged_edits(spark, d):
    found = merges.merged_edits(*_edits(spark, d), most=40, total=1 << 20, append=1 << 20)
    return found.select("prompt_id", "ix", "status", "message", "final_text", F.array_join("refs", ",").alias("refs"))


@query("SELECT event_id AS ix, 'line ' || sha256('n' || event_id) AS kept, 2 AS dropped FROM events")
def q_pruned_inserts(spark, d):
    e = V.table(spark, d, "events")
    line = lambda mark: F.concat(F.lit("line "), F.sha2(F.concat(F.lit(mark), F.col("event_id").cast("string")), 256))
    rows = e.select(F.col("event_id").alias("prompt_id"), F.col("event_id").alias("ix"), F.concat(F.lit("# Title\n- "), line("o")).alias("prompt"), F.concat_ws("\n", F.concat(F.lit("1. "), line("o")), line("n"), F.lit(" "), F.concat(F.lit("* "), line("n"))).alias("text"))
    return merges.pruned_inserts(rows).select("ix", "kept", "dropped")


@query("""SELECT prompt_id, section_id, ix, refs FROM (SELECT event_id % 30 AS prompt_id, 'S' || user_id % 3 AS section_id, min(event_id) AS ix, CASE WHEN event_id % 4 = 0 THEN 'a' ELSE 'a,b' END AS refs FROM events WHERE user_id % 3 < 2 AND event_id % 4 <> 3 GROUP BY 1, 2, event_type, 4)""")
def q_patch_intents(spark, d):
    e = V.table(spark, d, "events")
    k = F.col("event_id")
    rows = e.select((k % 30).alias("prompt_id"), F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("section_id"), k.alias("ix"), F.when(k % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("issue"), F.lit(None).cast("string").alias("direction"),
                    F.when(k % 4 == 3, F.array(F.lit("z"))).when(k % 4 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("a"))).alias("evidence_refs"))
    sections = e.select((k % 30).alias("prompt_id")).distinct().withColumn("section_id", F.explode(F.array(F.lit("S0"), F.lit("S1"))))
    allowed = e.limit(1).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("ref"))
    found = prompts.intents(rows, sections, allowed)
    return found.select("prompt_id", "section_id", "ix", F.array_join("refs", ",").alias("refs"))


@query("""SELECT prompt_id, section_id, n AS intents, CAST(r AS INT) AS references, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY r DESC, section_id) AS INT) AS place
FROM (SELECT user_id AS prompt_id, event_type AS section_id, count(*) AS n, count(DISTINCT event_id % 3) AS r FROM events GROUP BY ALL)""")
def q_patch_plan(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("prompt_id"), F.col("event_type").alias("section_id"), F.array((F.col("event_id") % 3).cast("string")).alias("refs"))
    return prompts.patch_plan(e)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'short' ELSE '必须 a' || chr(10) || '- ite...' END AS view FROM events")
def q_contract_view(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, "short").otherwise(F.concat(F.lit("必须 a\r\nplain "), F.col("event_id").cast("string"), F.lit("\n- item")))
    return V.table(spark, d, "events").select("event_id", prompts.contract_view(text, 10).alias("view"))


@query(r"""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS n, CASE doc_id % 3 WHEN 0 THEN 120 WHEN 1 THEN 60 ELSE 40 END AS w, string_split(coalesce(text, ''), '. ') AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(list_slice(ls, 1, n), lambda x: substr(trim(regexp_replace(x, '[\s\x0B\x{85}\x{A0}\x{3000}]+', ' ', 'g')), 1, w)), '|') AS items FROM s""")
def q_compacted_evidence(spark, d):
    items = F.split(F.coalesce("text", F.lit("")), r"\. ")
    return V.table(spark, d, "documents").select("doc_id", F.array_join(prompts.compacted(items, F.col("doc_id") % 3, 4, 120), "|").alias("items"))


def _patches(spark, d):
    p = V.table(spark, d, "part")
    k = F.col("p_partkey")
    own = p.select(k.alias("prompt_id"), F.concat(F.lit("# Rules\n- "), "p_name", F.lit("\n- "), "p_type", F.lit("\n\n## Notes\n"), "p_brand", F.lit("\n")).alias("prompt"))
    edit = lambda ix, op, at, old="", new="", text="", refs=F.array(F.lit("e")): F.struct(F.lit(ix).alias("ix"), F.lit(op).alias("op"), F.lit(at).alias("target_id"), *[(F.lit(x) if isinstance(x, str) else x).alias(c) for c, x in (("old_text", old), ("new_text", new), ("text", text))], refs.alias("evidence_refs"))
    name = F.concat(F.lit("- "), "p_name")
    edits = F.array(
        edit(1, "replace_within_section", "S001", F.col("p_type"), F.concat(F.lit("kind "), k.cast("string"))), edit(2, "append_to_section", "S001", text=F.concat(F.lit("## Rules\n+ -extra "), "p_brand")),
        edit(3, "append_to_section", "S002", text="plain", refs=F.when(k % 2 == 0, F.array(F.lit("e")))), edit(4, "delete_within_section", "S001", F.when(k % 3 == 0, F.concat(name, F.lit("\n- "), "p_type")).otherwise(name)),
        edit(5, "insert_before_section", "S002", text="before\n"), edit(6, "append_to_section", "S001", text="no item"), edit(7, "insert_after_section", "S002", text="x" * 900), edit(8, "delete_within_section", "S002", "nowhere"), edit(9, "rewrite", "S001"), edit(10, "insert_after_section", "S003", text="x"),
    )
    return own, p.select(k.alias("prompt_id"), F.explode(edits).alias("e")).select("prompt_id", "e.*")


_NL = "chr(10)"


@query(f"""SELECT p_partkey AS prompt_id, '# Rules' || {_NL} || CASE WHEN p_partkey % 3 = 0 THEN '- ' || p_name ELSE '' END || {_NL} || '- kind ' || p_partkey || {_NL} || '- extra ' || p_brand || {_NL} || {_NL} || 'before' || {_NL} || '## Notes' || {_NL} || p_brand || CASE WHEN p_partkey % 2 = 0 THEN {_NL} || 'plain' ELSE '' END || {_NL} AS candidate,
CAST(length(p_type) + length('kind ' || p_partkey) + length('- extra ' || p_brand) + 1 + CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE length(p_name) + 2 END + 7 AS INT) AS change_chars,
',,' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'no evidence' END || ',' || CASE WHEN p_partkey % 3 = 0 THEN 'overlaps' ELSE '' END || ',,no list item,over budget,old text not found,unknown operation,no such section' AS said FROM part""")
def q_patch_apply(spark, d):
    found = patches.patched(*_patches(spark, d))
    return found.select("prompt_id", "candidate", "change_chars", F.array_join(F.transform("edits", lambda x: x["message"]), ",").alias("said"))


@query(r"""WITH d AS (SELECT doc_id, string_split('intro' || chr(10) || '# One' || chr(10) || text || chr(10) || '## Two ' || chr(10) || '- last', chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS m FROM d), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec, length(line) + CASE WHEN n = m THEN 0 ELSE 1 END AS size FROM l),
g AS (SELECT doc_id, sec, arg_min(line, n) AS first, CAST(sum(size) AS INT) AS size FROM s GROUP BY ALL)
SELECT doc_id, 'S' || lpad(CAST(sec AS VARCHAR), 3, '0') AS section_id, CAST(length(regexp_extract(first, '^(#+)', 1)) AS INT) AS level, regexp_replace(first, '\s+$', '') AS title, CAST(before AS INT) AS "begin", CAST(before + size AS INT) AS "end" FROM (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY sec) - size AS before FROM g) WHERE sec > 0""")
def q_section_spans(spark, d):
    rows = V.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("intro\n# One\n"), F.col("text"), F.lit("\n## Two \n- last")).alias("prompt"))
    return patches.section_spans(rows, "doc_id", "prompt").drop("body")

"""Rule references: whether they stand in the prompt that a result was made with, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import eligible, rule_ids, squeeze, trim_u
from ..schemas import DIMENSIONS
from .texts import json_body

# Characters that are stripped from both ends of a reference, and those that part it.
EDGE = " \t\r\n-:：,，.。；;“”\"'`「」『』《》【】[]()（）"
PARTS = r"\s*(?:/|、|；|;|\n)\s*"


def clean_reference(ref: Column) -> Column:
    return F.btrim(squeeze(F.coalesce(ref, F.lit(""))), F.lit(EDGE))


# Fixed value: a quoted part of a reference, from two characters on.
QUOTED = r"[“\"'「『《【]([^”\"'」』》】]{2,180})[”\"'」』》】]"


def reference_exists(ref: Column, prompt: Column, squeezed: bool = False) -> Column:
    """F22, as rule reports read it: the reference, or all its parts, or all its quoted parts stand in the prompt.

    White space is squeezed in both; ``squeezed`` says that the prompt's is already.
    """
    whole = clean_reference(ref)
    text = F.coalesce(prompt, F.lit("")) if squeezed else squeeze(F.coalesce(prompt, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, PARTS), clean_reference), lambda p: p != "")
    quoted = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(QUOTED), 1), clean_reference), lambda p: p != "")
    there = lambda p: F.contains(text, p)
    return (whole != "") & (there(whole) | ((F.size(parts) > 1) & F.forall(parts, there)) | ((F.size(quoted) > 0) & F.forall(quoted, there)))


def reference_stands(ref: Column, prompt: Column) -> Column:
    """F22, as judges' results are checked: the reference without quotes around it, or all its parts between slashes, stand in the prompt as they are."""
    bare = lambda c: F.btrim(trim_u(c), F.lit("\"'“”‘’"))
    text = F.coalesce(prompt, F.lit(""))
    whole = bare(F.coalesce(ref, F.lit("")))
    parts = F.transform(F.filter(F.split(whole, "/"), lambda p: trim_u(p) != ""), bare)
    return F.contains(text, whole) | ((F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(text, p)))


def resolved_prompts(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds prompt_text, prompt_source and hash_match: the prompt of the result's hash, else that of its version.

    ``prompts`` has name, version, text; of equal hashes or versions the first name counts.
    """
    own = prompts.withColumn("hash", F.sha1("text")).withColumn("squeezed", squeeze(F.coalesce("text", F.lit(""))))
    by_hash = own.groupBy(F.col("hash").alias("__hash")).agg(F.min_by(F.struct("name", "text", "squeezed"), "name").alias("__h"))
    keys = own.select("name", "text", "squeezed", "hash", F.explode(F.array_distinct(F.array("name", "version"))).alias("prompt_version"))
    by_version = keys.groupBy("prompt_version").agg(F.min_by(F.struct("name", "text", "squeezed", "hash"), "name").alias("__v"))
    has_hash = F.coalesce(F.col("prompt_hash"), F.lit("")) != ""
    # rows without a hash find no partner, so each has a key of its own and none is hot
    asked = results.withColumn("__asked", F.when(has_hash, F.col("prompt_hash")).otherwise(F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))))
    joined = asked.join(by_hash, F.col("__asked") == F.col("__hash"), "left").drop("__asked", "__hash").join(by_version, "prompt_version", "left")
    found = has_hash & F.col("__h").isNotNull()
    match = F.when(found, F.lit(True)).when(F.col("__v").isNotNull() & has_hash, F.col("__v.hash") == F.col("prompt_hash"))
    return joined.withColumns({
        "prompt_text": F.when(found, F.col("__h.text")).otherwise(F.col("__v.text")), "prompt_squeezed": F.when(found, F.col("__h.squeezed")).otherwise(F.col("__v.squeezed")), "prompt_source": F.coalesce(F.when(found, F.col("__h.name")).otherwise(F.col("__v.name")), F.lit("")),
        "hash_match": match,
    }).drop("__h", "__v")


def reference_report(results: DataFrame) -> DataFrame:
    """adds rule_status, invalid_refs and invalid_rule_ids to results with prompt_text and hash_match.

    ``all_refs`` holds the result's references and those of its diagnostics.
    """
    refs = F.coalesce(F.col("all_refs"), F.array())
    invalid = F.array_distinct(F.filter(refs, lambda r: ~reference_exists(r, F.col("prompt_squeezed"), squeezed=True)))
    unknown = F.array_sort(F.array_except(rule_ids(F.col("comment")), rule_ids(F.col("prompt_text"))))
    named = (F.coalesce(F.col("prompt_hash"), F.lit("")) != "") | (F.coalesce(F.col("prompt_version"), F.lit("")) != "")
    empty = F.coalesce(F.col("prompt_text"), F.lit("")) == ""
    status = (
        F.when(~eligible(), "runtime_failure").when(empty & named, "no_prompt_found").when(empty, "not_applicable").when((F.size("invalid_refs") > 0) | (F.size("invalid_rule_ids") > 0), "invalid")
        .when(F.size(refs) == 0, "missing").when(F.col("hash_match") == False, "hash_mismatch").otherwise("ok")  # noqa: E712
    )
    out = results.withColumn("invalid_refs", F.when(empty, F.array().cast("array<string>")).otherwise(invalid)).withColumn("invalid_rule_ids", F.when(empty, F.array().cast("array<string>")).otherwise(unknown))
    return out.withColumn("rule_status", status)


def report_summary(report: DataFrame) -> DataFrame:
    """One row of counts."""
    of = lambda *s: F.count(F.when(F.col("rule_status").isin(*s), 1))
    return report.agg(
        F.count("*").alias("total"), *[of(s).alias(s) for s in ("ok", "invalid", "missing", "hash_mismatch")], of("runtime_failure", "no_prompt_found", "not_applicable").alias("not_checked")
    )


def with_rule_status(results: DataFrame, report: DataFrame, keys: list[str]) -> DataFrame:
    """Results with the rule status of the same key, blank where there is none."""
    return results.join(report.select(*keys, "rule_status"), keys, "left").fillna("", ["rule_status"])


def evidence_of(evidence: DataFrame, refs: DataFrame, order: str, limit: int) -> DataFrame:
    """The evidence that is referred to; if none is, the first ``limit`` rows."""
    chosen = evidence.join(refs.select("evidence_id").distinct(), "evidence_id", "left_semi")
    if chosen.limit(1).count():
        return chosen
    return evidence.orderBy(order).limit(limit)


def merged_references(own: Column, nested: Column, ids: Column) -> Column:
    """F8: the result's references, then those of its diagnostics, without repeats and without those that cite unknown rule numbers."""
    refs = F.array_distinct(F.concat(F.coalesce(own, F.array()), F.flatten(F.coalesce(nested, F.array()))))
    return F.filter(refs, lambda r: (F.size(rule_ids(r)) == 0) | F.forall(rule_ids(r), lambda i: F.array_contains(ids, i)))


# Judge output -------------------------------------------------------------------------------------

# Names under which judges give what the data model calls otherwise.
NESTED = ("result", "evaluation", "judge_result", "评估结果", "评分结果")
NAMES = {
    "score_total": ("score_total", "total_score", "score", "overall_score", "总分", "综合得分"),
    "comment": ("comment", "reason", "rationale", "explanation", "备注", "理由", "评语"),
    "error_tags": ("error_tags", "errors", "tags", "errorTags", "错误标签"),
    "fatal_error": ("fatal_error", "fatal", "is_fatal", "fatalError", "严重错误"),
    "diagnostics": ("diagnostics", "diagnoses", "issues", "扣分点", "诊断", "问题诊断"),
    "rule_refs": ("rule_refs", "rule_references", "rules", "规则引用", "规则依据"),
    "evidence_refs": ("evidence_refs", "evidence_references", "evidence", "证据引用", "事实证据"),
}
SCORE_NAMES = ("scores", "dimension_scores", "score_detail", "score_details", "维度分", "维度评分")
DIMENSION_NAMES = {
    "correctness": ("correctness", "正确性", "事实正确性"), "coverage": ("coverage", "完整性", "覆盖度"), "update_logic": ("update_logic", "update", "更新合理性", "更新逻辑"),
    "memory_boundary": ("memory_boundary", "boundary", "记忆边界", "边界"), "conciseness": ("conciseness", "简洁性", "凝练性"), "format": ("format", "格式", "格式合规"),
}
NO_TAGS = ("", "无", "none", "None", "[]")
TRUE_TEXTS = ("true", "1", "yes", "是")


def _member(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$['{name}']")


def _first(json: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_member(json, n) for n in names])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _inside(json: Column, names: tuple[str, ...]) -> Column:
    """The first member of these names that is an object, else the object itself."""
    return F.coalesce(*[_let(_member(json, n), lambda v: F.when(v.startswith("{"), v)) for n in names], json)


def _tag_list(tags: Column) -> Column:
    listed = F.from_json(tags, "array<string>")
    parted = F.filter(F.split(F.trim(tags), r"[,，、\s]+"), lambda t: t != "")
    return F.when(tags.isNull() | F.trim(tags).isin(*NO_TAGS), F.array().cast("array<string>")).when(tags.startswith("["), listed).otherwise(parted)


def judge_fields(raw: Column) -> dict[str, Column]:
    """the fields of a judge's answer, under whichever names it gives them: score_total, dims (map), comment, error_tags, fatal.

    The answer's body, its scores and its tags are each found once for all that is read from them.
    """
    numbers = lambda scores: F.map_from_arrays(F.array(*[F.lit(d) for d in DIMENSIONS]), F.array(*[_first(scores, DIMENSION_NAMES[d]).try_cast("double") for d in DIMENSIONS]))
    fields = {
        "score_total": lambda body: _first(body, NAMES["score_total"]).try_cast("double"),
        "dims": lambda body: F.map_filter(_let(_inside(body, SCORE_NAMES), numbers), lambda k, v: v.isNotNull()),
        "comment": lambda body: _first(body, NAMES["comment"]),
        "error_tags": lambda body: _let(_first(body, NAMES["error_tags"]), _tag_list),
        "fatal": lambda body: F.coalesce(F.lower(F.trim(_first(body, NAMES["fatal_error"]))).isin(*TRUE_TEXTS), F.lit(False)),
    }
    return {name: _let(_let(json_body(raw), lambda text: _inside(text, NESTED)), of) for name, of in fields.items()}


DIAGNOSTIC = {"dimension": ("dimension", "维度"), "severity": ("severity", "严重程度"), "reason": ("reason", "rationale", "理由", "原因")}
DIAGNOSTIC_REFS = {
    "rule_refs": ("rule_refs", "rule_references", "规则引用", "规则依据"), "evidence_refs": ("evidence_refs", "evidence_references", "证据引用", "事实证据"),
    "output_refs": ("output_refs", "output_references", "输出引用", "候选输出引用"),
}


def _texts(json: Column) -> Column:
    """A JSON value as a list of trimmed, non-blank texts."""
    listed = F.when(json.startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def diagnostics_of(json: Column) -> Column:
    """a judge's diagnostics (an object or a list of them) as an array of structs."""
    listed = F.when(F.trim(json).startswith("{"), F.array(json)).when(F.trim(json).startswith("["), F.from_json(json, "array<string>")).otherwise(F.array().cast("array<string>"))
    objects = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x).startswith("{"))
    return F.transform(objects, lambda x: F.struct(
        *[F.trim(F.coalesce(_first(x, names), F.lit(""))).alias(n) for n, names in DIAGNOSTIC.items()],
        *[_texts(_first(x, names)).alias(n) for n, names in DIAGNOSTIC_REFS.items()],
    ))


def diagnostic_signatures(diagnostics: Column) -> Column:
    """dimension, severity and sorted references of each diagnostic, in one text; reasons don't count."""
    refs = lambda d, c: F.array_join(F.array_sort(F.array_distinct(F.transform(d[c], lambda r: F.lower(squeeze(r))))), ";")
    return F.transform(diagnostics, lambda d: F.concat_ws("|", squeeze(d["dimension"]), squeeze(d["severity"]), *[refs(d, c) for c in DIAGNOSTIC_REFS]))


# Comments of failed judge calls.
FAILED_COMMENTS = ("judge 调用失败", "json 解析失败")


def legacy_failed() -> Column:
    """Whether an old result without status fields comes from a failed call: by its comment, or fatal without any score."""
    comment = F.lower(F.coalesce(F.col("comment"), F.lit("")))
    marked = F.contains(comment, F.lit(FAILED_COMMENTS[0])) | F.contains(comment, F.lit(FAILED_COMMENTS[1]))
    return marked | (F.coalesce(F.col("fatal"), F.lit(False)) & (F.coalesce(F.size("dims"), F.lit(0)) <= 0) & (F.coalesce(F.col("score_milli"), F.lit(0)) == 0))


# Winners and their other names.
WINNERS = {"1": "CANDIDATE_1", "2": "CANDIDATE_2", "候选1": "CANDIDATE_1", "候选2": "CANDIDATE_2", "CANDIDATE1": "CANDIDATE_1", "CANDIDATE2": "CANDIDATE_2", "持平": "TIE", "策略差异": "POLICY_DIFFERENCE", "POLICYDIFFERENCE": "POLICY_DIFFERENCE", "历史基线差异": "HISTORICAL_DIFFERENCE", "HISTORICALDIFFERENCE": "HISTORICAL_DIFFERENCE", "证据不足": "INSUFFICIENT"}
BASES = {"common_quality": None, "policy_difference": "POLICY_DIFFERENCE", "historical_baseline_difference": "HISTORICAL_DIFFERENCE", "equivalent": "TIE", "insufficient": "INSUFFICIENT"}


def pairwise_winner(winner: Column, swapped: Column, basis: Column, policies: Column) -> Column:
    """struct (winner: A, B or a reason for neither, basis) of a pairwise judge's answer, candidates put back in place."""
    raw = F.replace(F.upper(F.trim(F.coalesce(winner, F.lit("INSUFFICIENT")))), F.lit("-"), F.lit("_"))
    names = F.create_map(*[F.lit(x) for pair in WINNERS.items() for x in pair])
    named = F.coalesce(F.element_at(names, raw), raw)
    side = F.when(named == "CANDIDATE_1", F.when(swapped, "B").otherwise("A")).when(named == "CANDIDATE_2", F.when(swapped, "A").otherwise("B"))
    side = side.when(named.isin("TIE", "POLICY_DIFFERENCE", "HISTORICAL_DIFFERENCE", "INSUFFICIENT"), named).otherwise("INSUFFICIENT")
    said = F.lower(F.trim(F.coalesce(basis, F.lit(""))))
    implied = F.lit("common_quality")
    for name, result in BASES.items():
        if result:
            implied = F.when(side == result, name).otherwise(implied)
    found = F.when((said == "") & (F.size(policies) > 0), "policy_difference").when(said.isin(*BASES), said).otherwise(implied)
    final = F.when(found == "policy_difference", "POLICY_DIFFERENCE").when(found == "historical_baseline_difference", "HISTORICAL_DIFFERENCE").otherwise(side)
    return F.struct(final.alias("winner"), found.alias("basis"))


# What a prompt's quality is judged by.
QUALITIES = ("clarity", "consistency", "executability", "boundary_definition", "output_contract", "model_guidance", "context_efficiency")


def prompt_quality(json: Column) -> Column:
    """Mean of the qualities that are numbers, each held to 1 .. 5, with three digits; null without any."""
    known = F.array_compact(F.array(*[F.get_json_object(json, f"$.{q}").try_cast("double") for q in QUALITIES]))
    held = F.transform(known, lambda v: F.greatest(F.lit(1.0), F.least(F.lit(5.0), v)))
    return F.when(F.size(held) > 0, F.round(F.aggregate(held, F.lit(0.0), lambda n, v: n + v) / F.size(held), 3))


def no_candidate_reason() -> Column:
    """A27, of a row of counts: why a round gave no new prompt."""
    valid = F.col("total") - F.col("failed")
    return (
        F.when(F.col("total") == 0, "no_eval_results").when((valid <= 0) | ((F.col("failed") * 2 >= F.col("total")) & (F.col("issues") == 0)), "eval_chain_failed").when(F.col("issues") == 0, "no_change_needed")
        .when((F.col("error") != "") | (F.col("can_suggest") == False), "advisor_failed").when(F.col("source") == "no_valid_incremental_patch", "no_safe_patch").otherwise("no_candidate_unknown")  # noqa: E712
    )


def evidence_modes(evidence: DataFrame) -> DataFrame:
    """How the evidence is made up."""
    return evidence.groupBy("evidence_mode").agg(F.count("*").alias("n"))


def reviewed_evidence(rows: DataFrame, limit: int = 30, order: str = "ix") -> DataFrame:
    """The first rows in order that a human said anything about."""
    said = F.lit(False)
    for c in ("human_score", "human_comment", "human_error_tags"):
        if c in rows.columns:
            said = said | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return rows.where(said).orderBy(order).limit(limit)


def judge_message(old: Column, dialogue: Column, new: Column) -> Column:
    """the message that asks for a judgement; empty parts are said to be."""
    part = lambda title, c: F.concat(F.lit(f"## {title}\n"), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(empty)")))
    return F.concat_ws("\n\n", part("Old document", old), part("Dialogue", dialogue), part("New document", new))

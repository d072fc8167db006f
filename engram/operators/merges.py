"""Edits of prompts from several answers: merged, freed of what the prompt already says, and kept within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import squeeze, trim_u
from .diffs import aligned, lines_of
from .prompts import LEAST, rule_key, similar_rules

# How much a patch may hold.
MOST_EDITS, TOTAL_CHARS, APPEND_CHARS = 5, 900, 360


def _ordered_refs() -> Column:
    """References of a group's edits in their order, without repeats."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ix", "evidence_refs"))), lambda x: x["evidence_refs"])))


def grouped_edits(edits: DataFrame) -> DataFrame:
    """checked edits with one row per target: status 'merged' (with the references and reasons of all that say the same) or 'conflict'.

    Replacements and deletions of one old text are one target; of different replacements the first stays and the others are conflicts.
    Additions to one section are one target, their texts joined, equal ones once.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = edits.where("problem IS NULL").withColumns({"old_text": blank("old_text"), "new_text": blank("new_text"), "reason": blank("reason"), "text": F.when(blank("text") != "", blank("text")).otherwise(blank("new_text"))})
    adds = F.col("operation") == "append"
    target = ["prompt_id", "section_id", "operation", "old_text"]
    rows = rows.withColumn("old_text", F.when(adds, "").otherwise(F.col("old_text")))
    first = rows.groupBy(*target).agg(F.min_by("new_text", "ix").alias("__first"))
    rows = rows.join(first, target).withColumn("__other", (F.col("operation") == "replace") & (F.col("new_text") != F.col("__first")))
    said = "aggregate(array_sort(collect_list(struct(ix, reason))), '', (s, x) -> if(x.reason = '' OR contains(s, x.reason), s, if(s = '', x.reason, concat(s, '；', x.reason))))"
    texts = "aggregate(array_sort(collect_list(struct(ix, trim(text) AS text, lower(regexp_replace(text, '(?U)\\\\s+', '')) AS k))), named_struct('k', CAST(array() AS ARRAY<STRING>), 't', CAST(array() AS ARRAY<STRING>)), (s, x) -> if(array_contains(s.k, x.k), s, named_struct('k', concat(s.k, array(x.k)), 't', concat(s.t, array(x.text)))), s -> array_join(s.t, '\\n'))"
    merged = rows.where("NOT __other").groupBy(*target).agg(F.min("ix").alias("ix"), F.min_by("new_text", "ix").alias("new_text"), F.expr(texts).alias("text"), _ordered_refs().alias("refs"), F.expr(said).alias("reason"), F.lit("merged").alias("status"))
    others = rows.where("__other").select(*target, "ix", "new_text", "text", F.col("evidence_refs").alias("refs"), "reason", F.lit("conflict").alias("status"))
    return merged.unionByName(others)


def _judged_lines(edits: DataFrame) -> DataFrame:
    """prompt_id, rank, n, line, role: ``n`` lines that an edit puts in, ``k`` lines of a replacement that stand in the old text or change it, ``o`` lines of the old text."""
    trimmed = lambda c: F.transform(lines_of(F.col(c)), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    ops = F.when(F.col("operation") == "replace", aligned(lines_of(F.col("old_text")), lines_of(F.col("new_text")))["ops"])
    rows = edits.withColumn("__ops", ops)
    inserted = lambda n: F.exists("__ops", lambda o: (o["tag"] == "insert") & (o["b0"] <= n) & (n < o["b1"]))
    whole = lambda c, role: F.transform(trimmed(c), lambda x, i: F.struct(i.alias("n"), x.alias("line"), role(i).alias("role")))
    lines = (
        F.when(F.col("operation") == "append", F.filter(whole("text", lambda i: F.lit("n")), lambda s: trim_u(s["line"]) != ""))
        .when(F.col("operation") == "replace", F.concat(whole("new_text", lambda i: F.when(inserted(i), "n").otherwise("k")), whole("old_text", lambda i: F.lit("o"))))
    )
    return rows.select("prompt_id", "rank", F.explode(lines).alias("l")).select("prompt_id", "rank", "l.n", "l.line", "l.role")


def with_repeats(edits: DataFrame, prompts: DataFrame) -> DataFrame:
    """The edits (prompt_id, rank, operation, old_text, new_text, text) with ``ls``, their lines, and what each of them repeats.

    Pairs of like lines come from one join over all prompts (F30, exact); a line's ``hard`` says that it is like a line of the prompt or of
    the text that it replaces, ``soft`` lists the like lines that other edits put in, to be looked at in order.
    """
    units = prompts.select("prompt_id", F.explode(F.transform(lines_of(F.col("prompt")), squeeze)).alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    units = units.withColumn("k", rule_key(F.col("line"))).where(F.length("k") >= LEAST).select("prompt_id", "k").distinct().select("prompt_id", F.concat(F.lit("u:"), "k").alias("id"), "k")
    lines = _judged_lines(edits).withColumn("k", rule_key(F.col("line")))
    silent = (F.length("k") < LEAST) | ((F.col("role") != "n") & trim_u(F.col("line")).startswith("#"))
    lines = lines.withColumn("id", F.when(~silent, F.format_string("%08d%s%06d", "rank", "role", "n")))
    named = units.unionByName(lines.where("id IS NOT NULL").select("prompt_id", "id", "k"))
    pairs = similar_rules(named, "id", "prompt_id", "k", keyed="k")
    both = pairs.select(F.col("g").alias("prompt_id"), F.col("a").alias("id"), F.col("b").alias("like")).unionByName(pairs.select(F.col("g").alias("prompt_id"), F.col("b").alias("id"), F.col("a").alias("like")))
    both = both.where("NOT startswith(id, 'u:') AND substring(id, 9, 1) = 'n'")
    own_old = (F.substring("like", 9, 1) == "o") & (F.substring("like", 1, 8) == F.substring("id", 1, 8))
    hard = F.col("like").startswith("u:") | own_old
    found = both.groupBy("prompt_id", "id").agg(F.max(hard).alias("hard"), F.array_compact(F.collect_list(F.when(~F.col("like").startswith("u:") & (F.substring("like", 9, 1) != "o"), F.col("like")))).alias("soft"))
    lines = lines.where("role <> 'o'").join(found, ["prompt_id", "id"], "left")
    one = F.struct("n", "line", "id", "role", F.coalesce("hard", F.lit(False)).alias("hard"), F.coalesce("soft", F.array().cast("array<string>")).alias("soft"), (F.col("k") != "").alias("keyed"))
    packed = lines.groupBy("prompt_id", "rank").agg(F.array_sort(F.collect_list(one)).alias("ls"))
    return edits.join(packed, ["prompt_id", "rank"], "left").withColumn("ls", F.coalesce("ls", F.array().cast(packed.schema["ls"].dataType)))


_LINE = "STRUCT<n: INT, line: STRING, id: STRING, keyed: BOOLEAN>"


def _fold(most: int, total: int, append: int) -> str:
    """SQL: a prompt's edits one after the other: lines that repeat others go, then the budgets decide."""
    none = f"CAST(array() AS ARRAY<{_LINE}>)"
    line = "named_struct('n', l.n, 'line', l.line, 'id', l.id, 'keyed', l.keyed)"
    repeats = "l.hard OR exists(l.soft, p -> array_contains(s.known, p) OR exists(t.kept, q -> q.id = p))"
    pruned = f"aggregate(if(e.operation = 'replace', reverse(filter(e.ls, l -> l.role = 'n')), filter(e.ls, l -> l.role = 'n')), named_struct('kept', {none}, 'gone', CAST(array() AS ARRAY<INT>)), (t, l) -> if({repeats}, named_struct('kept', t.kept, 'gone', concat(t.gone, array(l.n))), named_struct('kept', concat(t.kept, array({line})), 'gone', t.gone)))"
    fits = f"t.size + length(l.line) + if(size(t.kept) > 0, 1, 0) <= {append} - s.appended"
    fitting = f"if(e.operation = 'append', aggregate(i.kept, named_struct('size', 0, 'kept', {none}), (t, l) -> if({fits}, named_struct('size', t.size + length(l.line) + if(size(t.kept) > 0, 1, 0), 'kept', concat(t.kept, array(l))), t), t -> t.kept), i.kept)"
    stripped = "regexp_replace({}, '(?U)^\\\\s+|\\\\s+\\\\z', '')"
    text = f"CASE e.operation WHEN 'append' THEN {stripped.format("array_join(transform(f, l -> l.line), '\\n')")} WHEN 'replace' THEN {stripped.format("array_join(transform(filter(e.ls, l -> NOT array_contains(i.gone, l.n)), l -> l.line), '\\n')")} ELSE e.old_text END"
    problem = f"CASE WHEN e.operation = 'append' AND size(i.kept) = 0 THEN 'nothing new' WHEN e.operation = 'replace' AND x = e.old_text THEN 'nothing new' WHEN e.operation = 'append' AND size(f) = 0 THEN 'over budget of additions' WHEN s.n >= {most} THEN 'too many edits' WHEN s.total + length(x) > {total} THEN 'over budget' END"
    taken = "if(e.operation = 'replace' AND NOT exists(f, l -> l.keyed), transform(filter(e.ls, l -> l.id IS NOT NULL), l -> l.id), transform(filter(f, l -> l.id IS NOT NULL), l -> l.id))"
    dropped = "transform(filter(e.ls, l -> l.role = 'n' AND NOT exists(f, q -> q.n = l.n)), l -> trim(l.line))"
    after = f"named_struct('n', s.n + if(p IS NULL, 1, 0), 'total', s.total + if(p IS NULL, length(x), 0), 'appended', s.appended + if(p IS NULL AND e.operation = 'append', length(x), 0), 'known', if(p IS NULL, concat(s.known, {taken}), s.known), 'out', concat(s.out, array(named_struct('rank', e.rank, 'problem', p, 'text', x, 'dropped', {dropped}))))"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    step = let("i", pruned, let("f", fitting, let("x", text, let("p", problem, after))))
    start = "named_struct('n', 0, 'total', 0, 'appended', 0, 'known', CAST(array() AS ARRAY<STRING>), 'out', CAST(array() AS ARRAY<STRUCT<rank: INT, problem: STRING, text: STRING, dropped: ARRAY<STRING>>>))"
    return f"aggregate(es, {start}, (s, e) -> {step}, s -> s.out)"


def merged_edits(edits: DataFrame, prompts: DataFrame, most: int = MOST_EDITS, total: int = TOTAL_CHARS, append: int = APPEND_CHARS) -> DataFrame:
    """prompt_id, section_id, operation, old_text, ix, status (applied, skipped, conflict), message, final_text, dropped (lines that say nothing new), refs, reason.

    Merged edits (see :func:`grouped_edits`) in the order of section and operation; lines that are like a rule of the prompt or of an edit
    before them go (M18); then at most ``most`` edits of at most ``total`` characters stay, of which ``append`` may be additions (by whole lines).
    ``prompts`` has prompt_id and prompt.
    """
    grouped = grouped_edits(edits)
    order = Window.partitionBy("prompt_id").orderBy("section_id", "operation", "ix")
    rows = grouped.where("status = 'merged'").withColumn("rank", F.row_number().over(order))
    ready = with_repeats(rows, prompts)
    packed = ready.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("rank", "operation", "old_text", "ls"))).alias("es"))
    done = packed.select("prompt_id", F.explode(F.expr(_fold(most, total, append))).alias("d")).select("prompt_id", "d.*")
    columns = ("prompt_id", "section_id", "operation", "old_text", "ix")
    out = rows.join(done.withColumnRenamed("text", "final_text"), ["prompt_id", "rank"]).select(*columns, F.when(F.col("problem").isNull(), "applied").otherwise("skipped").alias("status"), F.coalesce("problem", F.lit("")).alias("message"), "final_text", "dropped", "refs", "reason")
    other = grouped.where("status = 'conflict'").select(*columns, "status", F.lit("another replacement came first").alias("message"), F.col("new_text").alias("final_text"), F.array().cast("array<string>").alias("dropped"), "refs", "reason")
    return out.unionByName(other)


def pruned_inserts(edits: DataFrame) -> DataFrame:
    """Adds kept (the text's lines that say nothing that the prompt, or a line kept before, already says) and dropped.

    ``edits`` has prompt_id, its prompt, text and order ``ix``; lines are judged one after the other through all edits of a prompt.
    """
    prompts = edits.groupBy("prompt_id").agg(F.min_by("prompt", "ix").alias("prompt"))
    rows = edits.withColumn("rank", F.row_number().over(Window.partitionBy("prompt_id").orderBy("ix")))
    rows = rows.select("prompt_id", "ix", "rank", F.lit("append").alias("operation"), F.lit("").alias("old_text"), F.lit("").alias("new_text"), "text")
    packed = with_repeats(rows, prompts).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("rank", "operation", "old_text", "ls"))).alias("es"))
    endless = 1 << 30
    done = packed.select("prompt_id", F.explode(F.expr(_fold(endless, endless, endless))).alias("d")).select("prompt_id", "d.rank", "d.text", "d.dropped")
    return rows.drop("text").join(done, ["prompt_id", "rank"]).select("prompt_id", "ix", F.col("text").alias("kept"), F.size("dropped").cast("long").alias("dropped"))

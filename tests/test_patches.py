"""Patches and merges of edits against one-at-a-time versions in plain Python, over random edits."""

import random
import re

from pyspark.sql import functions as F

from engram.operators import merges, patches, prompts

ITEM = re.compile(r"^\s*(?:[-*+]\s+|\d+[.)、]\s+)")
HEAD = re.compile(r"^#{1,6}\s+\S")


def spans(text):
    lines, at, starts = text.splitlines(keepends=True), 0, []
    for line in lines:
        if HEAD.match(line):
            starts.append(at)
        at += len(line)
    ends = [*starts[1:], len(text)]
    return {f"S{i:03d}": (a, b) for i, (a, b) in enumerate(zip(starts, ends, strict=False), 1)}


def cleaned(text, strip_heads):
    out = []
    for line in text.splitlines():
        x = line.strip()
        if x.startswith("+") and not x.startswith("+++"):
            x = x[1:].lstrip()
        x = re.sub(r"^([-*])(?=\S)", r"\1 ", re.sub(r"^\+\s+", "- ", x))
        if x.strip() and not (strip_heads and HEAD.match(x.strip())):
            out.append(x.strip())
    return out


def patch(prompt, edits, ratio, least):
    where, used, taken, said = spans(prompt), 0, [], []
    for e in edits:
        at = where.get(e["target_id"])
        old, new, text = e["old_text"].strip(), e["new_text"].strip(), (e["text"].strip() or e["new_text"].strip())
        op, problem, begin, end, put = e["op"], "", 0, 0, ""
        within = op in ("replace_within_section", "delete_within_section")
        if op not in patches.OPERATIONS:
            problem = "unknown operation"
        elif at is None:
            problem = "no such section"
        elif not e["evidence_refs"]:
            problem = "no evidence"
        elif within and not old:
            problem = "no old text"
        elif op == "replace_within_section" and not new:
            problem = "no new text"
        elif not within and not text:
            problem = "no text"
        elif within:
            found = prompt[at[0] : at[1]].find(old)
            begin = at[0] + found
            end, put = begin + len(old), new if op == "replace_within_section" else ""
            problem = "old text not found" if found < 0 else ""
        else:
            body = prompt[at[0] : at[1]]
            lines = cleaned(text, op == "append_to_section")
            begin = end = at[0] if op == "insert_before_section" else at[1] if op == "insert_after_section" else at[0] + len(body.rstrip())
            rest = [x for x in body.splitlines() if x.strip() and not HEAD.match(x.strip())]
            items = [x for x in rest if ITEM.match(x)]
            if not lines:
                problem = "nothing to insert"
            elif op == "append_to_section" and items and len(items) >= max(1, len(rest) // 2) and any(not ITEM.match(x) for x in lines):
                problem = "no list item"
            else:
                indents = [re.match(r"\s*", x)[0] for x in body.splitlines() if ITEM.match(x)]
                indent = min(set(indents), key=lambda i: (-indents.count(i), len(i), indents.index(i))) if indents and op == "append_to_section" else ""
                put = "\n".join(indent + x for x in lines)
                put = ("\n" if begin and prompt[begin - 1] != "\n" else "") + put + ("\n" if begin < len(prompt) and prompt[begin] != "\n" else "")
        change = end - begin + len(put)
        if not problem and any(begin < t[1] and t[0] < end for t in taken):
            problem = "overlaps"
        if not problem and used + change > max(least, int(len(prompt) * ratio)):
            problem = "over budget"
        if not problem:
            used += change
            taken.append((begin, end, e["ix"], put))
        said.append(problem)
    out, at = "", 0
    for begin, end, _, put in sorted(taken):
        out, at = out + prompt[at:begin] + put, end
    return out + prompt[at:], used, said


def test_patches_equal_one_at_a_time(spark):
    rng = random.Random(11)
    texts, rows, want = [], [], {}
    for p in range(200):
        lines = []
        for s in range(rng.randrange(1, 5)):
            lines.append(f"{'#' * rng.randrange(1, 4)} Title {s}")
            lines += [rng.choice(["- item {}", "  - deep {}", "plain words {}", "", "2. number {}", "  - deep {}"]).format(rng.randrange(5)) for _ in range(rng.randrange(6))]
        prompt = "\n".join((["intro"] if rng.random() < 0.5 else []) + lines) + rng.choice(["", "\n", "\n\n"])
        edits = []
        for ix in range(rng.randrange(9)):
            a = rng.randrange(len(prompt))
            old = rng.choice([prompt[a : a + rng.randrange(1, 14)], "item 1", "item", "Title", "words", "", "absent"])
            text = rng.choice(["- new rule", "+ - marked", "-tight\n\n+++ three", "# Head\nplain", "", "  ", "* **bold**", "# only head", "x" * 40])
            edits.append({"ix": ix, "op": rng.choice([*patches.OPERATIONS, "rewrite"]), "target_id": rng.choice(["S001", "S002", "S003", " S001 ", "S009"]).strip(), "old_text": old, "new_text": rng.choice(["", "fresh", "two\nlines"]), "text": text, "evidence_refs": rng.choice([["e"], ["e", "f"], []])})
        texts.append((p, prompt))
        rows += [(p, *e.values()) for e in edits]
        want[p] = patch(prompt, edits, 0.25, 90)
    table = spark.createDataFrame(texts, "prompt_id int, prompt string")
    edits = spark.createDataFrame(rows, "prompt_id int, ix long, op string, target_id string, old_text string, new_text string, text string, evidence_refs array<string>")
    got = {r.prompt_id: (r.candidate, r.change_chars, [e.message for e in r.edits]) for r in patches.patched(table, edits, 0.25, 90).collect()}
    assert got == want
    assert {m for _, _, said in want.values() for m in said} >= {"", "overlaps", "over budget", "no list item", "old text not found", "nothing to insert"}


def test_sections_without_headings(spark):
    texts = [(1, "one\n\ntwo\nmore\n\n\nlast"), (2, "alone\nhere"), (3, ""), (4, None), (5, "a\n\n\n\nb\n")]
    got = {}
    for r in patches.section_spans(spark.createDataFrame(texts, "id int, t string"), "id", "t").orderBy("id", "section_id").collect():
        got.setdefault(r.id, []).append((r.section_id, r.title, r.level, r.begin, r.end, r.body))
    assert got[2] == [("S001", "全文", 0, 0, 10, "alone\nhere")] and set(got) == {1, 2, 5}
    assert [x[5] for x in got[1]] == ["one\n", "two\nmore\n", "\nlast"] and got[1][1][1] == "段落 2: two"
    assert all(texts[i - 1][1][b:e] == body for i, rows in got.items() for _, _, _, b, e, body in rows)


def same(a, b):
    from tests.test_operators import same_rule

    return len(a) >= 8 and bool(b) and same_rule(a, b)


def test_pruning_and_budgets_equal_one_at_a_time(spark):
    import difflib

    rng = random.Random(2)
    pool = ["- 必须记录用户明确说出的长期偏好和习惯", "- 不记录一次性的临时安排与当天行程", "1. keep every stable preference that the user states", "- merge duplicate entries into a single line", "- short", "* 必须记录用户明确说出的长期偏好与习惯", "keep each stable preference that the user states", "- 不记录一次性的临时安排以及当天行程"]
    word = lambda: "- rule " + "".join(rng.choice("qwertyuiopasdfgh") for _ in range(rng.randrange(4, 30)))
    key_rows = {}
    prompts_, edits = [], []
    for p in range(60):
        base = [rng.choice([*pool, word()]) for _ in range(5)]
        prompts_.append((p, "# Title\n" + "\n".join(base)))
        for ix in range(rng.randrange(1, 9)):
            op = rng.choice(["append", "replace", "delete"])
            old = "\n".join(base[: rng.randrange(1, 3)])
            new = [*old.split("\n"), *[rng.choice([*pool, word()]) for _ in range(rng.randrange(3))]]
            rng.shuffle(new)
            text = "\n".join(rng.choice([*pool, word(), word(), ""]) for _ in range(rng.randrange(1, 5)))
            edits.append((p, ix, f"S{ix:03d}", op, old if op != "append" else "", "\n".join(new) if op == "replace" else "", text if op == "append" else "", "", ["e"], None))
    lines = {x for e in edits for c in (4, 5, 6) for x in e[c].splitlines()} | {x for _, t in prompts_ for x in t.splitlines()}
    for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", prompts.rule_key(F.col("t")).alias("k")).collect():
        key_rows[r.t] = r.k
    key = lambda x: key_rows.get(x, "")
    table = spark.createDataFrame(edits, "prompt_id int, ix long, section_id string, operation string, old_text string, new_text string, text string, reason string, evidence_refs array<string>, problem string")
    most, total, append = 4, 260, 90
    got = {(r.prompt_id, r.ix): (r.status, r.message, r.final_text, sorted(r.dropped)) for r in merges.merged_edits(table, spark.createDataFrame(prompts_, "prompt_id int, prompt string"), most, total, append).collect()}
    units = lambda text: [key(x) for x in dict.fromkeys(y.strip() for y in text.splitlines()) if x and not x.startswith("#") and len(key(x)) >= 8]
    for p, prompt in prompts_:
        known, n, size, added = units(prompt), 0, 0, 0
        for _, ix, _, op, old, new, text, *_ in [e for e in edits if e[0] == p]:
            kept, gone, inside, message = [], [], [], ""
            if op == "append":
                for x in [y.rstrip() for y in text.splitlines() if y.strip()]:
                    if any(same(key(x), k) for k in known + inside):
                        gone.append(x.strip())
                    else:
                        kept.append(x)
                        inside.append(key(x))
                message = "" if kept else "nothing new"
                fits, length = [], 0
                for x in kept:
                    more = len(x) + (1 if fits else 0)
                    if length + more <= append - added:
                        fits.append(x)
                        length += more
                    else:
                        gone.append(x.strip())
                final, inside = "\n".join(fits).strip(), [key(x) for x in fits]
                message = message or ("" if fits else "over budget of additions")
            elif op == "replace":
                a, b = old.splitlines(), new.splitlines()
                put = {j for t, _, _, x, y in difflib.SequenceMatcher(None, a, b).get_opcodes() if t == "insert" for j in range(x, y)}
                lost = set()
                for j in sorted(put, reverse=True):
                    if any(same(key(b[j]), k) for k in known + units(old) + inside):
                        lost.add(j)
                        gone.append(b[j].strip())
                    else:
                        inside.append(key(b[j]))
                final = "\n".join(x for j, x in enumerate(b) if j not in lost).strip()
                message = "nothing new" if final == old.strip() else ""
                inside = inside or units(new)
            else:
                final = old
            if not message and n >= most:
                message = "too many edits"
            if not message and size + len(final) > total:
                message = "over budget"
            if not message:
                n, size, added, known = n + 1, size + len(final), added + (len(final) if op == "append" else 0), known + [k for k in inside if len(k) >= 8]
            assert got[(p, ix)] == ("skipped" if message else "applied", message, final, sorted(gone)), (p, ix, op)


def test_conflicts_and_references(spark):
    edits = [
        (1, 1, "replace_within_section", "S1", "old", "new", "", "because", ["r1"]), (1, 2, "replace_within_section", "S1", "old ", "other", "", "", ["r2"]), (1, 3, "replace_within_section", "S1", "old", "new", "", "so", ["r2", "r1"]), (1, 4, "remove", "S1", "absent", "", "", "", ["r1"]),
        (1, 5, "append_to_section", "S1", "", "", "speaks of row_7", "", ["r1"]), (1, 6, "append_to_section", "S1", "", "cites r1 there", "", "", ["r1"]), (1, 7, "append_to_section", "S1", "", "fine", "", "", ["gone"]), (1, 8, "append_to_section", "S1", "", "Fine rule", "", "", ["r2"]), (1, 9, "append_to_section", "S1", None, None, "fine  rule", None, ["r1", "gone"]),
    ]
    table = spark.createDataFrame(edits, "prompt_id int, ix long, op string, section_id string, old_text string, new_text string, text string, reason string, evidence_refs array<string>")
    sections = spark.createDataFrame([(1, "S1", "an old text")], "prompt_id int, section_id string, body string")
    checked = prompts.checked_edits(table, sections, spark.createDataFrame([("r1",), ("r2",)], "ref string"))
    assert {r.ix: r.problem for r in checked.collect()} == {1: None, 2: None, 3: None, 4: "old text not found", 5: "speaks of one case", 6: "speaks of one case", 7: "no evidence", 8: None, 9: None}
    got = {r.ix: (r.status, r.final_text, r.refs, r.reason) for r in merges.merged_edits(checked, spark.createDataFrame([(1, "an old text")], "prompt_id int, prompt string")).collect()}
    assert got == {1: ("applied", "new", ["r1", "r2"], "because；so"), 2: ("conflict", "other", ["r2"], ""), 8: ("applied", "Fine rule", ["r2", "r1"], "")}


def test_edits_and_sides_are_shuffled_once(spark):
    from engram.operators import detail

    prompts = spark.createDataFrame([(1, "# A\n- a\n")], "prompt_id int, prompt string")
    edits = spark.createDataFrame([(1, 1, "append_to_section", "S001", None, None, "- b", ["e"])], "prompt_id int, ix int, op string, target_id string, old_text string, new_text string, text string, evidence_refs array<string>")
    placed = patches.placed_edits(prompts, edits)
    assert [(r.problem, r.begin, r.end, r.replacement) for r in placed.collect()] == [(None, 7, 7, "\n- b")]
    text = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "target_id" not in "".join(x for x in text.split("\n") if "Join" in x)  # edits meet all sections of their prompt at once
    side = lambda rows: spark.createDataFrame(rows, "reviewer string, session_id string, chunk_id string, ix int, query string, answer string, document string, raw_output string")
    a = side([("r", "s", "c", 2, "q2", "a", None, "o2"), ("r", "s", "c", 1, "q1", "a", "o1", None), ("r", "s", "d", 1, "x", "y", None, None)])
    b = side([("r", "s", "c", 5, "q1", "a", " ", None), ("r", "s", "e", 1, None, "z", "last", None)])
    rows, chunks = detail.side_by_side(a, b)
    assert "Join" not in chunks._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.chunk_id, r.query, r.answer, r.consistent, r.rows, r.output_a, r.output_b) for r in chunks.collect()) == [("c", "q1\n\nq2", "a\n\na", False, 2, "o2", ""), ("d", "x", "y", False, 1, "", ""), ("e", "", "z", False, 1, "", "last")]
    assert sorted((r.chunk_id, r.n, r.query, r.output_a, r.output_b, r.consistent, r.boundary) for r in rows.collect() if r.chunk_id == "c") == [("c", 1, "q1", "", "", None, False), ("c", 2, "q2", "o2", "", False, True)]


def test_white_space_at_the_ends_is_that_of_unicode(spark):
    from engram.functions.columns import trim_u

    every = spark.createDataFrame([(chr(i) + "a " + chr(i) + chr(i),) for i in range(1, 0x3100)] + [("",), (" \u3000 ",), (None,)], "t string")
    assert every.where(~trim_u(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0

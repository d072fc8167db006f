"""Operator 11 against plain Python, with chunks and blocks so small that terms, languages and sources are split."""

import re
from collections import Counter, defaultdict

import pytest

from engram.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, chunk int"


def brute(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    held = Counter((lang, w) for lang, _, words in docs for w in set(words))
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted((w for (x, w), n in held.items() if x == lang and n >= min_docs), key=lambda w: w.encode())
        counts = defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                counts[source].update(w for w in words if w in set(kept))
                counts[None].update(w for w in words if w in set(kept))
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in counts.items()}
        sources = [s for s in counts if s is not None]
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((p[s][w] - p[None][w]) ** 2 // p[None][w], w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top}
    return out


ROWS = [
    (1, "Eins zwei drei, zwei; éa ÉA", "de", "a"), (2, "eins zwei vier éa", "de", "b"), (3, "EINS eins zwei\x00drei 7 drei", "de", "a"), (4, "drei zwei ça", "de", None),
    (5, None, "de", "only"), (6, "", None, None), (7, "one two", None, "a"), (8, "one two", "", "a"), (9, "one ünder " + "two " * 20_000, "", "b"), (9, "one ünder", "", "b"),
    (10, "x" * 70_000, "xx", "a"), (None, "x" * 70_000, "xx", "b"), (11, "x" * 70_000 + " rare", "xx", "b"), (12, "solo", "zz", "z"), (13, "12 ... 34", "zz", "y"),
]


@pytest.mark.parametrize(("chunk_rows", "block"), [(1 << 17, 64), (3, 1), (2, 2)])
def test_equals_plain_python(spark, chunk_rows, block):
    more = [(100 + i, " ".join(f"t{chr(97 + (i * k) % 23)}" for k in range(1, 30)), "mm", f"s{i % 5}") for i in range(40)]
    rows = ROWS + more
    docs = spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], SCHEMA)
    got = [tuple(r) for r in divergence.source_divergence(docs, chunk_rows=chunk_rows, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_top_and_ties(spark):
    rows = [(i, "aa bb cc dd ee " + ("ff gg hh ii " if i % 2 else ""), "en", "odd" if i % 2 else "even") for i in range(12)]
    docs = spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA)
    got = {tuple(r) for r in divergence.source_divergence(docs, top=3).collect()}
    assert got == brute(rows, top=3)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "odd" and r[2] == "term"] == ["ff", "gg", "hh"]


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact():
    import numpy as np

    big = np.array([0, 1, 10**15 - 7, 4 * 10**15], dtype=np.int64)
    total = int(big.sum())
    assert divergence.shares(big, total, 4).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 4) for c in big]

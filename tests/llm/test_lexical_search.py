"""Operator 13 against plain Python over every document and item, with one shard and with many small shards and blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from engram.llm import lexical_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, ids int, shard string, leaf int, item string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    known = [(i, Counter(terms(t))) for i, t in docs]
    known = [(i, c) for i, c in known if c]
    n_docs, n_terms = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(w for _, c in known for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in known:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 20, "cluster": 4, "sample": 64, "most_items": 7, "most_terms": 200}])
def test_equals_plain_python(spark, sizes):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs += [(docs[3][0], docs[3][1]), (None, docs[4][1]), (None, docs[4][1]), (9001, None), (9002, ""), (9003, "... !"), (9004, "the " * 60_000 + items[0][1])]
    docs += [(10_000 - i, items[1][1]) for i in range(70)]  # ties beyond the last place
    items += [(items[0][0], items[0][1]), (None, items[2][1]), (777, None), (778, "--"), (779, "wordthatnobodyhas")]
    got = lexical_search.rank_documents(
        spark.createDataFrame([(*d, 0, 0, "s", 0, "i") for d in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"), **sizes
    ).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0, 0, "", 0, "")], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.rank_documents(docs.limit(0), items).collect() == [] == lexical_search.rank_documents(docs, items.limit(0)).collect()
    assert [tuple(r) for r in lexical_search.rank_documents(docs, items).collect()] == brute([(1, "a b")], [(1, "a b")])


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(1)
    kinds = rng.permutation(np.repeat(np.arange(4), 32))
    rows = [np.sort(rng.choice(50, 12, replace=False)) + 50 * k for k in kinds]
    ids, first = np.concatenate(rows).astype(np.int32), np.arange(129) * 12
    order = lexical_search.bisected_order(ids, first, 200, 32)
    assert sorted(order.tolist()) == list(range(128))
    assert all(len(set(kinds[order[at : at + 32]])) == 1 for at in range(0, 128, 32))

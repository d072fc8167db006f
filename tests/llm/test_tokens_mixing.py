"""Operators 3 and 1: counts equal the library's; the mix meets its targets and repeats."""

import json
import math
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from engram.llm import mixing, token_counts

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = ["", None, " ", "a  b  c  d", "<|endoftext|> x <|endoftext|>", "tab\t\tand\r\nlines \n\n", "\u0085 x\x1c y", "café 中文 \U0001f600 don't  I'll"]
    docs = docs.unionByName(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = dict(zip(texts, library_counts(list(texts.values())), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH).collect()}
    assert got == {i: (len(texts[i].encode()), n, n > 512) for i, n in want.items()}


@pytest.mark.parametrize(("chunk", "overlap"), [(500, 60), (300, 5)])
def test_spliced_chunks_are_whole_counts(spark, chunk, overlap):
    rows = [(1, "some words, and more: " * 200), (2, "unbroken" * 400), (3, "unbroken" * 400), (3, "unbroken" * 400), (4, "x \n\n  y z " * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, PATH, chunk=chunk, overlap=overlap).collect())
    assert got == Counter(zip((i for i, _ in rows), library_counts([t for _, t in rows]), strict=True))


def test_targets_are_shared_by_weight_below_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100, 3), ("b", 1000, 3), ("c", 50, 1), (None, 0, 2)], "source string, source_size long, rows long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a is capped at 300; b and c (2 : 1) share the other 850, c is capped at 150; b takes what is left
    assert got == {"a": 300.0, "b": 700.0, "c": 150.0, None: 0.0}


def test_sources_meet_their_targets_and_shards_hold_every_draw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = mixing.taken_words(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
    rows = first.collect()
    assert sorted(rows) == sorted(mixing.taken_words(docs.repartition(5)).select(first.columns).collect()) and len(rows) == docs.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in rows)
    mixed = mixing.mix_sources(docs)
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("mix_words").alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.mix_sources(docs, shards=4).select("mix_shard").distinct().count() == 4


def test_leaves_hold_every_draw_once_and_shards_are_even(spark):
    quotas = [(1, 5003), (2, 11), (3, 0), (4, 800), (600, 77), (1200, 4000)]
    leaves = mixing.split_quotas(spark.createDataFrame(quotas, "sid int, quota long"), 16, "s").collect()
    by_source, by_shard = Counter(), Counter()
    for r in sorted(leaves, key=lambda r: (r.sid, r.shard)):
        assert r.start == by_source[r.sid] and r.n >= 0
        by_source[r.sid] += r.n
        by_shard[r.shard] += r.n
    assert by_source == Counter({s: q for s, q in quotas if q})
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 1


@pytest.mark.parametrize(("good", "pool", "need"), [(3, 10, 4), (40, 100, 50), (5, 5, 2), (1, 1000, 500), (7, 12, 12)])
def test_counts_are_hypergeometric(spark, good, pool, need):
    n = 4000
    drawn = spark.range(n).select(F.expr(mixing.hypergeometric(f"{good}L", f"{pool}L", f"{need}L", f"(id + 0.5D) / {n}")).alias("x"))
    got = {r.x: r["count"] / n for r in drawn.groupBy("x").count().collect()}
    want = {x: math.comb(good, x) * math.comb(pool - good, need - x) / math.comb(pool, need) for x in range(max(0, need + good - pool), min(good, need) + 1)}
    assert all(abs(got.get(x, 0) - p) <= 2 / n for x, p in want.items()) and set(got) <= set(want)


def test_rows_that_share_an_id_or_have_none_take_their_own_words(spark):
    rows = [(i // 3 if i % 4 else None, " ".join(["w"] * (i % 7 + 1)), "ab"[i % 2]) for i in range(2000)]
    rows += [(5, "same text here", "a")] * 40 + [(None, "no id at all", "b")] * 40 + [(None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.taken_words(docs).collect()
    mixed = mixing.mix_sources(docs).groupBy("source").agg(F.sum("mix_words").alias("n")).collect()
    words = Counter()
    for r in taken:
        assert 0 <= r.taken <= 3 * r.size
        words[r.source] += r.taken
    assert {r.source: r.n for r in mixed} == words
    assert all(abs(words[r.source] - r.target) <= 1 for r in taken)


def test_fixed_vocabulary_is_a_parameter():
    assert json.load(open(PATH))["model"]["type"] == "BPE"

"""Operators 2, 5 and 9 against brute force on every document of the smallest tables and on planted cases."""

import hashlib
import re
from collections import defaultdict

import pytest

from engram.llm import exact_dedup, near_dedup, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    base = " ".join(f"w{i}" for i in range(300))
    edited = base.replace("w150 ", "x150 ")
    planted = [(10_001, base, "a"), (10_002, edited, "a"), (10_003, base + " ", None), (10_004, None, "a"), (10_005, "", "b"), (10_006, "Just four Words here", "b")]
    planted += [(10_007, "just FOUR words here", "b"), (10_008, " ".join(["again"] * 70), "b"), (10_009, f"new start {' '.join(f'w{i}' for i in range(60, 120))} new end", "c")]
    return found + planted


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_are_the_true_components(spark, rows, percent):
    sets = {i: shingles(t) for i, t, _ in rows}
    ids = sorted(i for i in sets if sets[i])
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), percent=percent).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_repeated_windows_are_removed(spark, rows):
    first, texts = {}, {}
    for i, t, _ in sorted(rows):
        texts[i] = words = WORD.findall(t or "")
        for at in range(len(words) - 19):
            first.setdefault(tuple(words[at : at + 20]), (i, at))
    want = {}
    for i, words in texts.items():
        gone = [False] * len(words)
        for at in range(len(words) - 19):
            if first[tuple(words[at : at + 20])] != (i, at):
                gone[at : at + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_spans(frame(spark, rows)).collect()}
    assert got == want
    assert got[10_009][1] == 60 and got[10_008][1] > 0


def test_copies_and_what_stays(spark, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {}
    for text, members in groups.items():
        best = min(members)[1]
        for _, i in members:
            want[i] = (best, len(members), i == best, hashlib.sha256(text.encode()).hexdigest())
    docs = frame(spark, rows)
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.copies(docs).collect()} == want
    assert sorted(r.doc_id for r in exact_dedup.without_copies(docs).collect()) == sorted(i for i, w in want.items() if w[2])


def test_near_duplicates_leave_one_of_a_group(spark, rows):
    left = {r.doc_id for r in near_dedup.without_near_duplicates(frame(spark, rows), percent=80).collect()}
    assert 10_001 in left and not {10_002, 10_003, 10_007} & left and {10_004, 10_005, 10_006} <= left


def test_likelihood_estimate_is_near_the_true_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for shared in (1000, 1600, 1900):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - shared : 4000 - shared])
        values = near_dedup.sketch([a, b]).astype(int)
        above, below = np.array([(values[0] > values[1]).sum()]), np.array([(values[0] < values[1]).sum()])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(above, below, np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.15


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, passage, "a"), (1, "x y " + passage, "a"), (1 << 62, "z " + passage, "a"), ((1 << 63) - 1, "only this", "a"), (None, passage + " end", "b"), (None, passage + " end", "b"), (7, passage, "c")]
    got = [tuple(r) for r in substring_dedup.repeated_spans(frame(spark, rows)).collect()]
    words = lambda t: len(t.split())
    assert sorted((str(i), n) for i, n, _, _ in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    gone = {str((i, n)): r for i, n, r, _ in got}
    assert sorted([gone["(1, 40)"], gone["(1, 42)"]]) == [0, 40] and gone[str((1 << 62, 41))] == 40 and gone["(None, 41)"] == 40 and gone["(7, 40)"] == 40 and gone[str(((1 << 63) - 1, 2))] == 0

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, ""), (1, b, ""), (2, a + " x", ""), (3, b + " x", ""), (None, b + " x y", ""), (None, "quite alone here with nobody else", ""), (9, None, "")]
    got = sorted([(str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()], key=str)
    assert got == sorted([("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 1, False), ("None", 1, False), ("None", None, True), ("9", 9, True)], key=str)
    kept = near_dedup.without_near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("1", b), ("None", rows[5][1]), ("9", None)])


def test_a_full_filter_changes_no_result(spark, rows, monkeypatch):
    from engram.llm import sparktools

    docs = frame(spark, rows)
    read = lambda: (sorted(map(str, exact_dedup.copies(docs).collect())), sorted(map(str, exact_dedup.without_copies(docs).collect())), sorted(map(str, near_dedup.near_duplicates(docs).collect())))
    want = read()
    monkeypatch.setattr(sparktools, "BROADCAST_BUCKETS", 1)
    monkeypatch.setattr(sparktools, "BUCKET_IDS", 4)
    assert read() == want


def test_a_common_line_does_not_compare_all_that_have_it(spark, monkeypatch):
    line = " ".join(f"common{i}" for i in range(20))
    rows = [(i, f"{line}\n{' '.join(f'own{i}x{k}' for k in range(15))}", "a") for i in range(300)]
    rows += [(1000 + i, f"{t} more", "a") for i, t, _ in rows[:10]]
    met, confirm = spark.sparkContext.accumulator(0), near_dedup._confirm

    def counted(percent):
        run = confirm(percent)

        def seen(batches):
            for batch in batches:
                met.add(batch.num_rows)
                yield batch

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i % 1000 for i, _, _ in rows}
    # all in 20 blocks, each with each, before clusters were divided by what few of their sets have
    assert 20 <= met.value < 200


@pytest.mark.parametrize("percent", [50, 85])
def test_divided_clusters_lose_no_link(spark, rows, percent, monkeypatch):
    base = [f"w{i}" for i in range(70)]
    more = [(20_000 + 10 * n + k, " ".join(base[:n] + [f"v{n}k{k}"] * (k % 3) + base[n:]), "a") for n in range(0, 70, 3) for k in range(3)]
    read = lambda: sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows + more), percent=percent).collect())
    want = read()
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 3)
    assert read() == want


def test_copies_in_a_block_meet_few_others(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base, rng.integers(0, 1 << 62, 2).astype(np.uint64)))) for _ in range(400)]
    values, ids, met, estimate = near_dedup.sketch(sets), np.arange(400) + 7, [], near_dedup.estimate
    monkeypatch.setattr(near_dedup, "estimate", lambda above, *more: met.append(len(above)) or estimate(above, *more))
    for side in (np.zeros(400, int), np.arange(400) % 2):
        met.clear()
        links = near_dedup._links_of_block(ids, side, sets, values, 85)
        up = {i: i for i in ids.tolist()}
        for a, b in links:
            up = {i: up[a] if u == up[b] else u for i, u in up.items()} if up[a] != up[b] else up
        assert len(links) == 399 and len(set(up.values())) == 1
        # all pairs, 79,800 and 40,000, before rows that are joined were left out
        assert sum(met) < 10_000

"""Operator 12 against all pairs: the smallest tables, planted copies, a large group of near copies in several components, small blocks."""

import random
import re

import numpy as np
import pytest

from engram.llm import set_join

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row long, n long, key string, label int, cluster string"


def grams(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, percent=90):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            best[top(i)] = min(best.get(top(i), key), key)
    return sorted(((key, len(s), best.get(top(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(n, words, changes, seed, first):
    """Copies of one text with several changed words each: some link to it, some to each other, some to none."""
    rng = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(words)]
    found = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(words)] = f"c{rng.randrange(400)}"
        found.append((first + k, " ".join(own)))
    return found


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found += near_copies(150, 120, 9, 1, 20_000) + near_copies(60, 400, 25, 2, 21_000)
    passage = " ".join(f"p{i}" for i in range(80))
    found += [(22_000 + k, f"{passage} {' '.join(f'q{k}w{i}' for i in range(30))}") for k in range(60)]  # share much, link with nothing
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"d{i}" for i in range(100))
    found += [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (None, a + " x y"), (None, "alone and nameless here"), (4, a), (4, a)]
    found += [(5, None), (6, ""), (7, " \n"), (8, "Two words"), (9, "two WORDS"), (10, "w " * 9), (11, "w " * 50_000), (12, " ".join(f"l{i}" for i in range(30_000)))]
    return found


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_all_pairs(spark, rows, monkeypatch, small):
    if small:
        monkeypatch.setattr(set_join, "BLOCK_DOCS", 8)
        monkeypatch.setattr(set_join, "HELD", 1000)
    docs = spark.createDataFrame([(*r, 1, 2, "k", 0, "c") for r in rows], SCHEMA)
    got = set_join.joined_sets(docs, frequent=50 if small else set_join.FREQUENT)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert set_join.joined_sets(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("percent", [70, 90])
def test_block_finds_every_link(percent):
    rng = np.random.default_rng(percent)
    base = np.arange(200, dtype=np.uint64)
    sets = []
    for k in range(120):
        lost = rng.choice(200, rng.integers(0, 40), replace=False)
        sets.append(np.sort(np.concatenate((np.delete(base, lost), 1000 + rng.choice(60, rng.integers(0, 20), replace=False).astype(np.uint64)))))
    for side in (np.zeros(120, dtype=int), np.arange(120) % 2):
        join = set_join.SkipJoin(sets, list(range(120)), side, percent)
        found = join.links()
        up = list(range(120))

        def top(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        linked = set()
        for i in range(120):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and (not side.any() or side[i] != side[j]):
                    linked |= {(i, j), (j, i)}
                    up[max(top(i), top(j))] = min(top(i), top(j))
        assert set(found) <= linked
        assert [join.forest.top(i) for i in range(120)] == [min(j for j in range(120) if top(j) == top(i)) for i in range(120)]


def test_signatures_rule_out_no_link(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for full in (set_join.FULL, 3):
        monkeypatch.setattr(set_join, "FULL", full)
        sets = [rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) for _ in range(20)]
        pairs = [(s, np.concatenate((s[lost:], rng.integers(0, 1 << 63, new, dtype=np.uint64)))) for s in sets for lost, new in ((0, 0), (20, 20), (40, 0), (0, 40), (200, 200))]
        sign = lambda s: np.bincount((s >> np.uint64(64 - set_join.SIGNATURE)).astype(np.int64), minlength=1 << set_join.SIGNATURE).clip(max=full).astype(np.uint16).tobytes()
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs))), pa.array([0] * len(pairs)), pa.array([sign(a) for a, _ in pairs]), pa.array([sign(b) for _, b in pairs])], names=["id", "head", "signature", "head_signature"])
        left = {i for out in set_join._can_link(90)(iter([batch])) for i in out.column("id").to_pylist()}
        linked = {i for i, (a, b) in enumerate(pairs) if 100 * (both := len(np.intersect1d(a, b))) >= 90 * (len(a) + len(b) - both)}
        assert linked and linked <= left and (full == 3 or not left & set(range(4, len(pairs), 5)))

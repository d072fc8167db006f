"""The pipeline's rows are what its stages keep, each judged on its own input."""

import corpus_pipeline
from engram.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(docs.columns)] == docs.columns
    left = {r.doc_id: r.text for r in out.select("doc_id", "text").distinct().collect()}
    texts = ["".join((t or "").split()) for t in left.values()]
    assert left and len(set(texts)) == len(texts)
    scorer = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score_documents(docs, scorer).where("kept").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert set(left) <= good
    assert decontaminate.contaminated(docs.where(docs.doc_id.isin(list(left))), bench).count() == 0
    assert len(left) > 0.5 * len(good)


def test_run_against_brute_force(spark):
    """What run() gives, held against the input without any of the library's code: near copies by all pairs, items as runs of words."""
    words = lambda t: [w for w in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()]
    out = corpus_pipeline.run(spark, SF).select("doc_id", "text", "source", "mix_words").collect()
    left = {r.doc_id: (r.text, r.source) for r in out}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, (t, _) in left.items() if (w := words(t))}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            assert 100 * both < 80 * (len(sets[i]) + len(sets[j]) - both), (i, j)
    items = [f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: f" {' '.join(words(t))} " for i, (t, _) in left.items()}
    assert not [(i, item) for i, t in texts.items() for item in items if item in t]
    assert all(0 < r.mix_words <= len(words(r.text)) for r in out)

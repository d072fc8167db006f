"""Nulls, empty texts, ties, repeated rows, empty tables and columns with clashing names, for every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from engram.llm import decontaminate, exact_dedup, html_extract, lm_scoring, mixing, near_dedup, quality, substring_dedup, token_counts, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, cluster string, size string, h string, row string, bucket int, bits int, mix_shard string, MIX_WORDS int, id int"
LONG = "one two three four five six seven eight nine ten " * 12
ROWS = [(1, LONG, "en", "a"), (1, LONG, "en", "a"), (2, LONG, None, None), (3, None, None, "b"), (None, None, None, None), (4, "", "en", "b"), (5, "   \n", "en", "b"), (None, "word", "en", "a"), (6, "x" * 200_000, "en", "a"), (7, "ab cd " * 40_000, "en", "a")]

#: Ids that a stage keeps of ROWS.  The classifier's are not named: it is fitted on them; the mix takes no words of empty texts.
KEEPS = {"exact dedup": [1, 5, None, 6, 7], "near dedup": [1, 1, 3, None, 4, 5, None, 6, 7], "decontamination": [r[0] for r in ROWS]}

DOC_OPERATORS = {
    "mix": mixing.taken_words,
    "copies": exact_dedup.copies,
    "tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "near": near_dedup.near_duplicates,
    "lm": lm_scoring.score_texts,
    "spans": substring_dedup.repeated_spans,
    "quality": lambda d: quality.score_documents(d, quality.fit(d)),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, "c", "s", "h", "r", 1, 2, "m", 3, 4) for r in ROWS], SCHEMA)


@pytest.mark.parametrize("name", list(DOC_OPERATORS))
def test_one_row_for_each_row(spark, docs, name):
    got = DOC_OPERATORS[name](docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in ROWS)
    assert DOC_OPERATORS[name](docs.limit(0)).collect() == []


def test_pages_and_items(spark, docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).collect() == []
    assert decontaminate.keep_clean(docs, items).count() == len(ROWS) and decontaminate.keep_clean(docs, items).columns == docs.columns
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), items).collect() == []
    pages = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "http://a.b/c", "<p>x", 2)], "page_id long, url string, html string, rule int")
    assert url_filter.judge_urls(pages).count() == html_extract.extract_main_text(pages).count() == 3
    assert url_filter.judge_urls(pages.limit(0)).collect() == [] and html_extract.extract_main_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_keep_columns(spark, docs, stage):
    last = stage is corpus_pipeline.STAGES[-1]
    for rows in (docs, docs.limit(0)):
        out = stage[1](spark, rows, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and (last or len(out.columns) == len(docs.columns))
        names = [c.lower() for c in out.columns]
        assert len(set(names)) == len(names)
        ids = [r.doc_id for r in out.collect()]
        # what a stage keeps of these rows: one of the equal ones, nothing but documents that were given
        assert not ids if rows is not docs else {i for i in ids} <= {r[0] for r in ROWS}
        if rows is docs and stage[0] in KEEPS:
            assert sorted(ids, key=str) == sorted(KEEPS[stage[0]], key=str)

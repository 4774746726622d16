"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taxflow.llm import debruijn, decontaminate, kneser_ney, language_crf, line_dedup, mixing, ngram_join, quality_rules, style_tree, suffix_intervals

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["nid", "size", "key_", "rid", "words", "seed", "at", "n", "kept", "score", "component", "gram", "parts", "lines", "share", "rate", "item_id", "line", "n_words", "copy_no", "n_lines", "n_removed"]
PLAIN = "a plain sentence with quite a few words in it, so that there is something to read and to count here today"
ROWS = [
    (1, PLAIN, "en", "a", 9), (1, PLAIN, "en", "a", 9), (None, PLAIN, None, None, None), (2, None, "en", "a", None), (3, "", None, "a", 0),
    (4, " \n\t\n", "de", None, 4), (5, "same " * 40_000, "en", "b", 1), (6, "y" * 200_000, "de", "b", 1), (7, "l\n" * 50_000, "de", "b", 1), (8, PLAIN + "\n" + PLAIN, None, "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, None), (5, 0, 1), (6, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, PLAIN), (1, PLAIN), (None, PLAIN), (2, None), (3, ""), (4, "same same same"), (5, "same " * 60)], "item_id long, text string").withColumn("doc_id", F.lit(3))


ONE_FOR_EACH = {
    "1": lambda s, d: ngram_join.ngram_jaccard_groups(d, 4, "0.85"),
    "3": lambda s, d: quality_rules.quality_rules(d),
    "4": lambda s, d: language_crf.language_id(d),
    "6": lambda s, d: debruijn.substring_dedup(d),
    "8": lambda s, d: kneser_ney.quality_classifier(d, labels(s)),
    "9": lambda s, d: line_dedup.line_dedup(d),
    "10": lambda s, d: suffix_intervals.suffix_array_dedup(d),
}


@pytest.mark.parametrize("n", ONE_FOR_EACH)
def test_one_row_for_each(spark, docs, n):
    ids = sorted(str(r.doc_id) for r in ONE_FOR_EACH[n](spark, docs).select("doc_id").collect())
    assert ids == sorted(str(r[0]) for r in ROWS)
    assert ONE_FOR_EACH[n](spark, docs.limit(0)).count() == 0


def test_contamination(spark, docs):
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, benchmark(spark)).collect()}
    assert got == {(d, i) for d in (1, None, 8) for i in (1, None)} | {(5, 4), (5, 5)}


def test_mix(spark, docs):
    got = mixing.mix_sources(docs, size=2000).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS} and all(r.nid == 7 and r.copy_no > 0 for r in got)


def test_pages(spark):
    deep = "<div>" * 3000 + "deep text that stays" + "</div>" * 3000
    rows = [(1, "http://a.x/", None), (1, "http://a.x/", None), (None, None, "<p>some text</p>"), (2, "no url", deep), (3, "http://a.x/2", "<p>" + "w " * 300_000 + "</p>"), (4, "", "&#0;&bogus;&#x110000;<")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("host", "node", "text", "key_", "n")})
    got = style_tree.extract_main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == "" and by[None].text == "some text" and by[2].text == "deep text that stays" and by[3].n_chars == 599_999
    assert style_tree.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("i", range(5))
def test_stages(spark, i):
    stage = corpus_pipeline.STAGES[i][1]
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = stage(spark, docs, SF)
    assert out.columns[:5] == docs.columns and (i == 4 or out.columns == docs.columns)
    assert out.count() > 0 and stage(spark, docs.limit(0), SF).count() == 0

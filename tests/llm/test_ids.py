"""Ids beyond 2**53 beside nulls, and extra columns, through every operator."""

from __future__ import annotations

import pytest

from docquarry.llm import fingerprints, gif_store, html_extract, language_id, line_dedup, mixing, ngram_join, queries, sentencepiece_codec, substring_dedup, toxicity

IDS = [2**53 + 1, 2**53 + 3, -(2**60) - 1, None, None, 5]
TEXT = "the house stands near the old river and many people walk there every day in summer time"
COLUMNS = "doc_id long, text string, lang string, source string, score double, node string, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [TEXT, f"{TEXT} {TEXT} more", "other words", TEXT, None, ""]
    return spark.createDataFrame([(i, t, "en", "s", 0.5, "n", 1) for i, t in zip(IDS, texts)], COLUMNS).coalesce(1)


def none_toxic(docs):
    labels = docs.sparkSession.createDataFrame([(2**53 + 1, 1, 1), (2**53 + 3, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return toxicity.score(docs, toxicity.fit(docs, labels))


MODEL = sentencepiece_codec.PieceModel(["▁", "a", "e", "<unk>"], [-1.0, -2.0, -2.0, 0.0], [True, True, True, False], [], 3, "unigram")
RUNS = {
    "op1": lambda d: line_dedup.dedup_lines(d),
    "op2": none_toxic,
    "op3": queries.op3_of,
    "op3 stored": gif_store.store_texts,
    "op3 frames": lambda d: gif_store.frames_of(gif_store.store_texts(d)),
    "op4": fingerprints.with_next,
    "op4 alone": fingerprints.fingerprint,
    "op5": substring_dedup.dedup_substrings,
    "op6": ngram_join.join_classes,
    "op6 kept": lambda d: ngram_join.keep_one(d).unionByName(d.filter("doc_id in (5)").limit(0)),
    "op7": lambda d: mixing.realise(mixing.plan_mix(d)),
    "op9": lambda d: language_id.identify(d, language_id.fit(d)),
    "op10": lambda d: sentencepiece_codec.encode_digests(d, MODEL),
    "op10 whole": lambda d: sentencepiece_codec.encode_documents(d, MODEL),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_ids_stay(docs, name):
    found = [r.doc_id for r in RUNS[name](docs).select("doc_id").collect()]
    assert sorted(found, key=str) == sorted(IDS, key=str)


def test_page_ids_stay(spark):
    pages = spark.createDataFrame([(i, "u", "<p>Some words of a page.</p>", 1.0) for i in IDS], "page_id long, url string, html string, text double").coalesce(1)
    assert sorted((r.page_id for r in html_extract.extract(pages).collect()), key=str) == sorted(IDS, key=str)

"""Tables with columns named like those that operators add or use inside, and empty tables."""

import pytest

from geolith.llm import quality, sentencepiece_codec, sharding, simhash, warc

NAMES = ["id", "th", "host", "line", "n", "salt", "w", "x", "key", "span", "size", "shard", "slot", "fp", "root", "kept", "cleaned_text", "record_id", "block", "date"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, f"text {k} with some words of its own and {k} more", "s", *range(len(NAMES))) for k in range(5)], ["doc_id", "text", "source", *NAMES])


def test_quality(docs):
    assert [r.kept for r in quality.judged(docs).collect()] == [True] * 5
    out = quality.cleaned(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and [r.cleaned_text_1 for r in out.collect()] == [r.text for r in out.collect()]


def test_sharding(docs):
    assert sorted(r.doc_id for r in sharding.assigned(docs).collect()) == [0, 1, 2, 3, 4]


def test_simhash(docs):
    assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [0, 1, 2, 3, 4]


def test_warc(docs):
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    assert warc.query(pages).count() == 10


def test_encode_of_an_empty_table(docs):
    out = sentencepiece_codec.encode(docs.limit(0), sentencepiece_codec.load())
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0

"""Null ids, clashing names and odd tables through the operators and every stage of the pipeline."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelight.llm import exact_dedup, mixing, near_dedup, packing, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, key string, component_id long, keep_id string, kept string, draws int"
LONG = "the quick brown fox jumps over the lazy dog and runs away from there " * 400
TEXTS = [(None, "the cat sat on the mat and looked at the dog for a while", "en", "a"), (None, "the cat sat on the mat and looked at the dog for a while", "en", None), (1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "b"), (4, LONG + "end", "en", "b"),
         (5, "der Hund und die Katze gehen heute nicht in den Garten", "de", "a"), (5, "der Hund und die Katze gehen heute nicht in den Garten", "de", "a"), (5, "die Sonne scheint und wir haben keine Zeit mehr", "de", None), (6, "der Hund und die Katze gehen heute nicht in den Garten", "de", "c"),
         (7, " \n\t ", None, "c"), (8, "### 123", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*t, len(t[1] or ""), 9, "k", 1, "z", "q", 3) for t in TEXTS], SCHEMA).repartition(3)


def test_null_ids_are_packed_and_mixed(odd):
    pieces = packing.pack(odd, WORD_BPE)
    assert pieces.where("doc_id is null and offset >= 0").agg(F.sum("length")).first()[0] > 20
    assert pieces.select(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == len(TEXTS) and sum(r["doc_id"] is None and r["size"] == 14 for r in mixed) == 2
    assert all(sum(d["words"] for d in r["draws"]) <= 2 * r["size"] for r in mixed)


def test_null_ids_are_responses(spark):
    rows = spark.createDataFrame([(None, "http://a.example/", "same"), (None, "http://b.example/", "same"), (3, "http://c.example/", "same"), (2, "http://d.example/", "same")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(rows).collect())
    assert got == [(0, "response", None), (0, "response", None), (2, "revisit", 3), (3, "response", None)]


def test_clashing_names_are_left_behind(odd):
    assert exact_dedup.exact_dedup(odd).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes"]
    assert near_dedup.near_dedup(odd).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_stages_take_odd_rows(spark, odd):
    docs = odd
    texts = lambda df: sorted(repr((r["doc_id"], r["text"])) for r in df.collect())
    named = corpus_pipeline.language_id(spark, docs, "")
    assert texts(named) == sorted(repr(t[:2]) for t in TEXTS if t[0] not in (1, 2, 7, 8))
    exact = corpus_pipeline.exact_duplicates(spark, named, "")
    assert texts(exact) == sorted(repr(t[:2]) for t in TEXTS if t[0] not in (1, 2, 6, 7, 8))
    near = corpus_pipeline.near_duplicates(spark, exact, "")
    assert texts(near) == sorted(repr(t[:2]) for t in TEXTS if t[0] not in (1, 2, 4, 6, 7, 8))
    mixed = corpus_pipeline.source_mix(spark, near, "")
    assert {r["doc_id"] for r in mixed.collect()} <= {None, 3, 5} and mixed.columns == list(corpus_pipeline.COLUMNS) and all(len(r["text"]) == r["n_chars"] for r in mixed.collect())
    assert corpus_pipeline.packed(spark, mixed, "").agg(F.sum("length")).first()[0] > 1000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0
    every = corpus_pipeline.exact_duplicates(spark, odd, "")
    assert texts(every) == sorted(repr(t[:2]) for t in TEXTS if t[0] not in (2, 6))

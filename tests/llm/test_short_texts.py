"""Texts of a few words: compressed sizes tie, finer code lengths tell their language."""

from pyspark.sql import functions as F

import corpus_pipeline
from tracelight.llm import langid
from tracelight.llm.queries import learn_languages

SMALL = "/root/testdata/sf0.01"


def test_ties_are_settled_and_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = learn_languages(docs)
    coder, finer = langid.Coder(model), langid.ContextCoder(model)
    tied = []
    for r in docs.where(F.length("text") < 60).collect():
        sizes = sorted(coder.sizes(r["text"]).values())
        if any(c.isalpha() for c in r["text"]) and sizes[0] == sizes[1]:
            tied.append(r)
    assert len(tied) >= 4
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SMALL).select("doc_id").collect()}
    assert {r["doc_id"] for r in tied} <= kept
    judged = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert sum(judged[r["doc_id"]]["lang_pred"] == r["lang"] for r in tied) >= 0.8 * len(tied)
    for r in tied:
        bits = sorted(finer.bits(r["text"], lang) for lang in model.dictionaries)
        got = judged[r["doc_id"]]
        assert got["margin"] > 0 and 0.5 < got["score"] <= 1 and abs(got["margin"] - (bits[1] - bits[0]) / bits[1]) < 1e-9


def test_measured_narrow_margins_stay_rejected(spark):
    half = "straße über gehen haben werden nicht ", "être avoir faire pouvoir vouloir déjà "
    model = langid.LanguageModel({"aa": half[0].encode() * 30, "bb": half[1].encode() * 30})
    same = langid.LanguageModel({"aa": half[0].encode() * 30, "bb": half[0].encode() * 30})
    table = spark.createDataFrame([(1, "nicht"), (2, "déjà"), (3, "12 !!"), (4, None), (5, "".join(chr(0x4E00 + 37 * i % 5000) for i in range(400)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    assert [(got[i]["lang_pred"], got[i]["rejected"]) for i in (1, 2, 3, 4)] == [("aa", False), ("bb", False), ("und", True), ("und", True)]
    got = {r["doc_id"]: r for r in langid.identify(table, same).collect()}
    assert not got[1]["rejected"] and got[1]["margin"] == 0  # too short to measure
    assert got[5]["rejected"] and got[5]["margin"] == 0  # long enough to measure, and equal

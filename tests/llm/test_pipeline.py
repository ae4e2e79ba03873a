"""The pipeline's stages against their operators, and the registered SQL against the queries."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tracelight.llm import exact_dedup, langid, near_dedup
from tracelight.llm.queries import learn_languages

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs)
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_take_effect(stages):
    raw, lang, exact, near, mixed, packed = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_duplicates", "near_duplicates", "source_mix", "packing"]
    for table in stages[:5]:
        assert table.columns == list(corpus_pipeline.COLUMNS)
    judged = langid.identify(raw, learn_languages(raw))
    assert ids(lang) == ids(judged.where("not rejected")) and lang.count() >= 0.95 * raw.count()
    assert ids(exact) == ids(exact_dedup.exact_dedup(lang).where("kept"))
    assert ids(near) == ids(near_dedup.near_dedup(exact).where("kept"))
    assert set(ids(mixed)) <= set(ids(near))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed.collect()) == tokens


def test_run_gives_the_stages_rows(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    # where documents are cut depends on their neighbours; what is packed of each does not
    whole = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()))
    assert whole(got) == whole(stages[-1])


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op7_near_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = __spark_entry__.queries()[name](spark, SMALL)
    want = db.sql(__spark_entry__.oracle_sql()[name]).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names

"""Registered queries and the mix stage on the smallest tables against plain Python."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def documents():
    return duckdb.sql(f"select doc_id, text, source from '{SMALL}/documents.parquet'").fetchall()


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def source_words(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    return sizes


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(sizes.values())
    for _ in range(200):  # the common rate of words per weight, by bisection
        rate = (low + high) / 2
        if sum(min(2 * sizes[s], rate * weight[s]) for s in sizes) < 1.5 * sum(sizes.values()):
            low = rate
        else:
            high = rate
    return {s: min(2 * sizes[s], high * weight[s]) for s in sizes}


def near_targets(taken, want, sizes):
    """Less than a block short: a source's short last block may be among those drawn whole."""
    return all(-max(1, min(4096, sizes[s] // 512)) < taken[s] - want[s] <= 0.5 for s in want)


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL).collect()


def test_mix_stage_holds_each_sources_words(spark):
    got = corpus_pipeline.source_mix(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()
    sizes, taken = source_words(documents()), source_words([(r["doc_id"], r["text"], r["source"]) for r in got])
    assert taken.keys() == sizes.keys() and near_targets(taken, targets(sizes), sizes)


def test_op6_source_mix(spark):
    rows = documents()
    own, sizes, want, taken = {r[0]: r for r in rows}, source_words(rows), targets(source_words(rows)), {}
    for r in run(spark, "op6_source_mix"):
        _, text, source = own.pop(r["doc_id"])
        assert (r["size"], r["source_size"]) == (words(text), sizes[source]) and abs(r["target"] - want[source]) < 1e-3
        taken[source] = taken.get(source, 0) + r["taken"]
    assert not own and near_targets(taken, want, sizes)


def test_op2_packing(spark):
    lib, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in run(spark, "op2_packing"):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {d: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, _ in documents()}


def test_op10_token_counts(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run(spark, "op10_token_counts")}
    counts = {d: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in documents()}
    assert got == {d: (b, n, n > 512) for d, (b, n) in counts.items()}


def test_op8_media(spark):
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in run(spark, "op8_media")}
    raw = {d: (t or "").encode() for d, t, _ in documents()}
    padded = {d: x + b"\0" * (-len(x) % 64) if x else b"\0" * 64 for d, x in raw.items()}
    assert got == {d: (len(raw[d]), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for d, p in padded.items()}

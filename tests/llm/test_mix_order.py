"""The mix's shards and places decide where its rows are."""

import pytest
from pyspark.sql import functions as F

from tracelight.llm import mixing

SMALL = "/root/testdata/sf0.001"


def test_rows_lie_by_shard_and_place(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    carry = ("doc_id", "text", "lang", "source", "n_chars")
    mixed = mixing.mix(docs, carry=carry, shard_words=10_000)
    want, words = {}, {}
    for r in mixed.select("doc_id", "draws").collect():
        for d in r["draws"]:
            key = (d["shard"], r["doc_id"])
            words[key] = words.get(key, 0) + d["words"]
            want.setdefault(key, set()).add(d["place"])
    shards = {s for s, _ in want}
    assert len(shards) > 4
    got, order = {}, {}
    for r in mixing.drawn_rows(mixed).withColumn("shard", F.spark_partition_id()).collect():
        key = (r["shard"], r["doc_id"])
        got[key] = got.get(key, 0) + len(r["text"].encode().split())
        order.setdefault(r["shard"], []).append((r["doc_id"], r["source"]))
    assert got == words  # whole draws of each shard, apart from other shards'
    for shard, rows in order.items():
        low = -(1 << 63)
        for doc, _ in rows:  # some place of each row's document lets the order rise
            low = min(p for p in want[shard, doc] if p >= low)
    runs = sum(a[1] != b[1] for rows in order.values() for a, b in zip(rows, rows[1:]))
    assert runs > sum(len({s for _, s in rows}) for rows in order.values())  # sources alternate


def test_op6_shows_the_draws(spark):
    from tracelight.llm.queries import op6_source_mix

    rows = op6_source_mix(spark, SMALL).collect()
    assert all(sum(d["words"] for d in r["draws"]) == r["taken"] for r in rows)
    assert {"round", "shard", "place", "turn", "first_word", "words"} == set(next(r for r in rows if r["draws"])["draws"][0].asDict())


@pytest.mark.parametrize("blocks", [1, 2, 3, 5, 12, 13, 100, 512, 1009])
def test_every_seed_permutes_all_blocks(spark, blocks):
    order = lambda *key: [r[0] for r in spark.range(blocks).select("id", mixing.permuted(F.col("id"), F.lit(blocks).cast("long"), *map(F.lit, key)).alias("p")).orderBy("id").select("p").collect()]
    one, two, last = order("mix", "s", 0), order("other", "s", 0), order("mix", "s", 1)
    assert sorted(one) == sorted(two) == sorted(last) == list(range(blocks))
    if blocks > 12:
        assert one != two and one != last
        steps = {(b - a) % blocks for a, b in zip(one, one[1:])}
        assert len(steps) > blocks // 4  # no arithmetic progression


def draws(spark, **options):
    rows = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"), **options).collect()
    return {(r["doc_id"], d["round"], d["first_word"]): d for r in rows for d in r["draws"]}, {r["source"]: r["target"] for r in rows}, rows


def test_the_seed_decides_the_blocks_and_the_tree_the_shards(spark):
    one, targets, rows = draws(spark, shard_words=10_000)
    two, same_targets, others = draws(spark, shard_words=10_000, seed="other")
    assert targets == same_targets and one.keys() != two.keys()
    taken = lambda rows: {s: sum(d["words"] for r in rows if r["source"] == s for d in r["draws"]) for s in targets}
    assert all(abs(taken(rows)[s] - taken(others)[s]) <= 13 for s in targets)
    three, _, _ = draws(spark, shard_words=40_000)
    assert one.keys() == three.keys() and {d["shard"] for d in three.values()} < {d["shard"] for d in one.values()}
    assert [d["shard"] for d in one.values()] != [d["shard"] for d in three.values()]


def test_many_shards_are_joined_as_they_are_listed(spark, monkeypatch):
    one, _, _ = draws(spark, shard_words=500)
    monkeypatch.setattr(mixing, "LISTED_SHARDS", 0)
    two, _, _ = draws(spark, shard_words=500)
    assert one == two and len({d["shard"] for d in one.values()}) > 100

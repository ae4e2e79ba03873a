"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelight.llm import exact_dedup, langid, media, mixing, near_dedup, packing, quality, suffix_dedup, token_counts, warc
from tracelight.llm.bpe import ChunkIds, PrefixCounts
from tracelight.llm.graph import connected_components
from tracelight.llm.suffix_order import InducedSort

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, size int, key string, row int"
WORDS = "the of and tion er on that ing with was for reading écoute straße niño ###! a1b2 don't «quoi»".split()


def make_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fixture_rows():
    rng = random.Random(5)
    base = [make_text(rng, rng.randint(30, 120)) for _ in range(40)]
    texts = list(base)
    for t in base[:10]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [base[3]] * 6 + [base[4].replace(" ", " \t\n", 2), base[5].upper()]
    texts += [base[7][:80] + base[11] + base[7][-70:], None, "", "", "   ", "\n\t", "x", "One two three four", "12345", "###", make_text(rng, 6000)]
    texts += ["tail\0\0", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "İstanbul ΟΔΟΣ", "a" * 5000, "Zażółć gęślą jaźń 日本語のテキスト", "  lead  two   spaces \n\n x\n\n\ny  "]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s3", "ß", None)[i % 5], len(t or ""), 7, 1, "k", 0) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]  # repeated rows
    return rows


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_exact_dedup(docs, empty):
    import re

    norm = [(r[0], re.sub("[\x20\x09-\x0d]+", " ", r[1] or "")) for r in ROWS]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    want = sorted(((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=repr)
    assert collected(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "same"), (None, "same"), (5, "same"), (None, "alone"), (6, None)], "doc_id long, text string")
    got = collected(exact_dedup.exact_dedup(rows), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(None, 5, 3, False), (None, 5, 3, False), (5, 5, 3, True), (None, None, 1, True), (6, 6, 1, True)], key=repr)
    assert near_dedup.near_dedup(rows).count() == 5
    assert suffix_dedup.suffix_dedup(rows).count() == 5
    assert token_counts.token_prefix_index(rows, BYTE_BPE).count() == 5
    assert media.media_round_trip(rows).where("doc_id is null").count() == 3


def shingles(text):
    w = ((text or "").encode().lower()).split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup(docs, empty):
    sets = [(r[0], shingles(r[1])) for r in ROWS]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted(((i, len(s), find(i), find(i) == i) for i, s in sets), key=repr)
    assert collected(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dedup.near_dedup(empty).count() == 0


def test_an_id_with_two_texts_links_both(spark):
    a, b = make_text(random.Random(1), 60), make_text(random.Random(2), 60)
    near = lambda t: t + " tail"
    rows = [(1, a), (2, near(a)), (2, b), (3, near(b)), (4, "alone here and there too"), (5, b), (None, a)]
    for repeated in (rows, [(1, a), (2, a), (2, b), (3, b), (4, "alone here and there too"), (5, b), (None, a)]):
        got = near_dedup.near_dedup(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 1)]


def test_exact_copies_go_by_id_and_text(spark):
    rows = spark.createDataFrame([(1, "same text", 0), (2, "same  text", 1), (2, "another text", 2), (1, "same text", 3), (None, "same text", 4), (None, None, 5), (7, "", 6), (8, None, 7)], "doc_id long, text string, _copy int")
    kept = sorted(r["_copy"] for r in exact_dedup.without_copies(rows).collect())
    assert kept == [0, 2, 3, 4, 5, 6]
    one, two = exact_dedup.exact_dedup(rows).drop("text_sha256"), exact_dedup.exact_dedup(rows, digests=False)
    assert collected(one, "*") == collected(two.drop("text_sha256"), "*")
    assert two.where("group_size > 1 and text_sha256 is null").count() == 0 and two.where("text_sha256 is null").count() == 1


def test_a_hot_key_is_dealt_to_all_partitions(spark):
    from tracelight.llm._common import join_groups

    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).select("id", F.when(F.col("id") < 8000, 1).otherwise(F.col("id")).alias("k"))
        joined = join_groups(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 20_000, F.col("id"))
        assert "hashpartitioning(k#" in (plan := joined._jdf.queryExecution().toString()) and "_salt#" in plan.split("Physical Plan")[1].split("hashpartitioning(k#")[1].split(")")[0]
        sizes = [r["rows"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.sum("n")).collect()]
        assert len(sizes) == 8 and max(sizes) < 3500 and joined.where("n is null or (k = 1) <> (n = 8000)").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies around the threshold: links between them, not only to the smallest, decide the components."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 500)}" for _ in range(110)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = collected(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")
    assert got == sorted(((i, find(i)) for i in range(len(rows))), key=repr)
    assert 1 < len({find(i) for i in range(len(rows))}) < 60


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    a, b = np.unique(pool[:1500]), np.unique(pool[300:1800])
    s = near_dedup.sketch([a, b, np.union1d(a, b), np.zeros(0, np.uint64)])
    assert (np.maximum(s[0], s[1]) == s[2]).all() and not s[3].any()
    found = near_dedup.estimate(s[:1], s[1:2], np.array([1500.0]), np.array([1500.0]))[0]
    assert abs(found - 1200 / 1800) < 0.15


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    missed = 0
    for n in (4, 8, 20, 100):
        for _ in range(40):
            pool = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
            shared = pool[: -(-6 * n // 7)]
            a, b = np.concatenate([shared, pool[-(n - len(shared)) :]]) if n > len(shared) else shared, shared
            keys = near_dedup.band_keys(near_dedup.sketch([np.sort(a), np.sort(b)]))
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0


@pytest.mark.parametrize("task_links", [0, 1000])
def test_components(spark, task_links):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 205), (205, 203)] + [(300, rng.randint(301, 320)) for _ in range(30)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), task_links=task_links).collect()))
    assert {got[i] for i in range(61)} == {0} and got[203] == 200 and got[300] == 300 and 100 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def windows_brute(rows, match=50):
    first = {}
    for i, t in sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: x[0]):
        for p in range(len(t) - match + 1):
            first.setdefault(t[p : p + match], i)
    out = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - match + 1):
            if first[t[p : p + match]] < r[0]:
                gone[p : p + match] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(docs, empty):
    got = collected(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == windows_brute(ROWS)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_over_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", 20_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_TEXT", 20_000)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    got = collected(suffix_dedup.suffix_dedup(docs, memory=0), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == windows_brute(ROWS)


@pytest.mark.parametrize("hot_anchor", [1, 3, 50])
def test_hot_anchors_lose_nothing(spark, docs, monkeypatch, hot_anchor):
    """Windows of frequent anchors, dealt one by one, are removed as they are together."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD_TEXT", 4000)
    got = collected(suffix_dedup.suffix_dedup(docs, hot_anchor=hot_anchor), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == windows_brute(ROWS)
    rng = random.Random(4)
    line = "this very line stands in all of the documents, whatever is around it"
    rows = [(i, f"{rng.random()} {line}{'!' if i % 2 else ''} {rng.random()} {line}", None, None, 0, 0, 0, "", 0) for i in range(60)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), hot_anchor=hot_anchor)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == windows_brute(rows)


@pytest.mark.parametrize("memory", [0, 200, 1 << 20])
def test_induced_sort_orders_suffixes(memory):
    rng = np.random.default_rng(4)
    for _ in range(30):
        parts = [rng.integers(1, 5, rng.integers(1, 50)).astype(np.uint16) for _ in range(rng.integers(1, 6))]
        text = np.concatenate([np.append(p, 0).astype(np.uint16) for p in parts + parts[:1]])
        found = [(p, c) for pos, lcp in InducedSort(text, 8, memory).order() for p, c in zip(pos.tolist(), lcp.tolist())]
        assert sorted(p for p, _ in found) == list(range(len(text) - 1))
        strings = [text[p : p + 8].tolist() for p, _ in found]
        for (a, b), (_, c) in zip(zip(strings, strings[1:]), found[1:]):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if 0 not in a[:same]:
                assert a >= b and c == same


def test_packing_round_trip(docs, empty):
    lib = Tokenizer.from_file(WORD_BPE)
    ids = {r[0]: np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in ROWS}
    rows = packing.pack(docs, WORD_BPE, window=256, smallest=32).collect()
    total, seen = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        total.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    copies = {i: sum(x[0] == i for x in ROWS) for i in ids}
    for i, own in ids.items():
        assert sum(n for _, n in seen[i]) == copies[i] * len(own)
        assert sorted(seen[i])[0][0] == 0
    for parts in total.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier and at & (at - 1) == 0 and at <= 256
    assert list(rows[0].asDict()) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    tiers, sequences = {}, {}
    for r in packing.pack(docs, WORD_BPE, window=256, smallest=32, tokens_per_step=1024).where("offset = 0").collect():
        tiers.setdefault(r["step_group"], set()).add(r["tier"])
        sequences.setdefault(r["tier"], {}).setdefault(r["step_group"], []).append(r["sequence_id"])
    assert sorted(tiers) == list(range(len(tiers))) and all(len(t) == 1 for t in tiers.values())
    for tier, groups in sequences.items():
        sizes = [len(x) for x in groups.values()]
        assert max(sizes) * tier * (tier + 256) <= max(2 * 1024 * 256, tier * (tier + 256)) and max(sizes) - min(sizes) <= 1
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_chunk_ids_equal_the_library():
    lib, own = Tokenizer.from_file(WORD_BPE), ChunkIds(WORD_BPE, entries=50)
    rng = random.Random(8)
    marks = ["'s", "'", "’", "...", "Ǆ", "é", "́x", "\x1c", "\xa0", " ", "İ", "Σ", "5", "½", "<|endoftext|>", "\x85", "_", "̈"]
    texts = [r[1] or "" for r in ROWS] + ["".join(rng.choice(WORDS + marks + [" ", "\n", "  "]) for _ in range(40)) for _ in range(200)]
    got = own.encode([t.encode() for t in texts])
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_token_counts_equal_the_library_at_every_prefix():
    lib, own = Tokenizer.from_file(BYTE_BPE), PrefixCounts(BYTE_BPE, entries=50)
    rng = random.Random(9)
    marks = ["'s", "'ll", "'", "’re", "...", "\n", "\n\n", "  ", " ", "\t", "日本", "🙂", "5", "123", "<|endoftext|>", "\x1c", "\xa0", "　", "    "]
    texts = ["".join(rng.choice(WORDS + marks + [" "]) for _ in range(12)) for _ in range(60)] + ["", " ", "\n\nfoo", "don't  'll\n x"]
    for t in texts:
        counts = np.cumsum(own.steps(t), dtype=int).tolist()
        assert counts == [len(lib.encode(t[: k + 1], add_special_tokens=False).ids) for k in range(len(t))], t
    for r in ROWS:
        assert int(own.steps(r[1] or "").sum(dtype=int)) == len(lib.encode(r[1] or "", add_special_tokens=False).ids)


def test_token_counts_of_words_need_no_pattern():
    # op10: words, and those before stops, commas and line feeds, are told apart by their letters; other stretches are not
    lib, own = Tokenizer.from_file(BYTE_BPE), PrefixCounts(BYTE_BPE)
    asked, find = [], own.find
    own.find = lambda text: asked.append(text) or find(text)
    text = "One straßeniño erheitte, niño.\nThe ndtian. of\ndon't\n\nstop ⅷx a1,\nb.\n'll l'\ns"
    assert np.cumsum(own.steps(text), dtype=int).tolist() == [len(lib.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]
    assert not {" erheitte,", " niño.\nThe", "\nThe", " ndtian.", " straßeniño", "\nb."} & set(asked)


def test_token_index_answers_budgets(docs, empty):
    lib = Tokenizer.from_file(BYTE_BPE)
    index = token_counts.token_prefix_index(docs, BYTE_BPE)
    got = index.select("doc_id", "n_tokens", token_counts.longest_within("prefix_steps", F.lit(10)).alias("most"), token_counts.tokens_at("prefix_steps", F.lit(7)).alias("at7")).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == count(t) and r["at7"] == count(t[:7])
        assert count(t[: r["most"]]) <= 10 and (r["most"] == len(t) or count(t[: r["most"] + 1]) > 10)
    assert token_counts.token_prefix_index(empty, BYTE_BPE).count() == 0


def test_languages(spark, empty):
    rng = random.Random(6)
    kinds = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "straße über gehen haben werden nicht".split(), "cc": "être avoir faire pouvoir vouloir déjà".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(40)), k) for i in range(90) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 ### !!", None), (903, "lorem " * 30000, None), (None, "straße über", "bb"), (0, rows[0][1], "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = langid.identify(table, langid.fit_languages(table.where(learn))).collect()
    for r in got:
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]
        elif r["doc_id"] is not None and r["doc_id"] < 90:
            assert r["lang_pred"] == r["lang"] and 0.5 <= r["score"] <= 1 and not r["rejected"]
        elif r["doc_id"] == 903:
            assert r["lang_pred"] == "aa"
    assert len(got) == len(rows)
    nothing = langid.identify(table, langid.fit_languages(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify(empty, langid.fit_languages(table)).count() == 0


def test_quality(spark, empty):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, make_text(rng, 60) if good else "".join(rng.choice("#$%&*! abc") for _ in range(300)), "x"))
        labels.append((i, int(good)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 50000, "x"), (None, "some text", "x"), (0, rows[0][1], "x")]
    labels += [(5000, 1), (3, None)]
    table, truth = spark.createDataFrame(rows, "doc_id long, text string, stats string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality_scores(table, truth).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and len(held) > 30
    wrong = sum((r["score"] >= 0.3) != (r["doc_id"] % 3 > 0) for r in held if r["doc_id"] < 300)
    assert wrong <= 0.05 * len(held)
    assert {r["score"] for r in quality.quality_scores(table, truth.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, truth).count() == 0


def test_isotonic_fit_pools_violators():
    knots, levels = quality.pool_violators(np.array([2, 2, 0, 2]), np.array([0, 2, 0, 1]), np.array([0.1, 0.2, 0.3, 0.4]))
    assert levels.tolist() == [0.0, 0.75] and np.allclose(knots, [0.1, 0.3])


def water_filling(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        rate = left / sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + rate * w[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += rate * w[s]
            break
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= full
    return target


def test_mixing(docs, empty):
    import re

    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    target = water_filling(sizes)
    mixed = mixing.mix(docs, shard_words=1000).withColumn("taken", mixing.taken_words(F.col("draws"))).collect()
    taken, shards = {}, {}
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for x in r["draws"]:
            shards.setdefault(x["shard"], []).append(x["words"])
            assert 0 <= x["first_word"] and x["first_word"] + x["words"] <= r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    assert len(shards) > 4 and sorted(r["size"] for r in mixed) == sorted(count(r[1]) for r in ROWS)
    again = mixing.mix(docs.repartition(3), shard_words=1000)
    assert collected(again.select("doc_id", "size", F.to_json("draws").alias("d")), "doc_id", "size", "d") == sorted(((r["doc_id"], r["size"], x) for r, x in zip(mixed, [y["d"] for y in mixing.mix(docs, shard_words=1000).select(F.to_json("draws").alias("d")).collect()])), key=repr)
    assert mixing.mix(empty).count() == 0


def test_mixed_rows_hold_the_drawn_words(docs):
    mixed = mixing.mix(docs, carry=("doc_id", "text", "lang", "source", "n_chars"))
    taken = {}
    for r in mixed.select("doc_id", mixing.taken_words(F.col("draws")).alias("taken")).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for r in mixing.drawn_rows(mixed).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in taken.items() if v}


def test_splitting_tree_keeps_quotas_exact(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 300), ("c", 7), (None, 50)], "source string, quota long")
    rows = mixing.split_quotas(quotas, 4).collect()
    for source, quota in (("a", 1000), ("b", 300), ("c", 7), (None, 50)):
        own = sorted((r["shard"], r["first"], r["blocks"]) for r in rows if r["source"] == source)
        assert len(own) == 16 and sum(b for *_, b in own) == quota
        at = 0
        for _, first, blocks in own:
            assert first == at and blocks >= 0
            at += blocks
    per_shard = [sum(r["blocks"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(per_shard) - min(per_shard) <= 1


def test_hypergeometric_draws_follow_their_distribution(spark):
    from math import comb

    n, marked, drawn = 40, 12, 15
    u = (F.col("id") + 0.5) / 20000
    got = dict(map(tuple, spark.range(20000).select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(marked).cast("long"), F.lit(drawn).cast("long"), u).alias("x")).groupBy("x").count().collect()))
    for x in range(marked + 1):
        want = comb(marked, x) * comb(n - marked, drawn - x) / comb(n, drawn)
        assert abs(got.get(x, 0) / 20000 - want) < 2e-4


def test_media_round_trip(docs, empty):
    got = media.media_round_trip(docs).collect()
    assert len(got) == len(ROWS)
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    forms = {}
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.decode_image(media.encode_image(raw)) == (payload, len(raw))
        forms.setdefault(raw, set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in forms.values())
    assert media.media_round_trip(empty).count() == 0


def test_media_ranges_and_damaged_members(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/archives"
    media.write_media(docs, folder)
    whole = media.read_media(spark, folder)
    parts = media.read_media(spark, folder, range_bytes=700)
    assert parts.rdd.getNumPartitions() > 10
    assert collected(parts, "key", "media") == collected(whole, "key", "media")
    target = max((tmp_path / "archives").glob("*.zip"), key=lambda p: p.stat().st_size)
    raw = bytearray(target.read_bytes())
    at = raw.index(b"IDAT")
    raw[at + 20] ^= 255
    target.write_bytes(bytes(raw))
    rows = media.read_media(spark, folder).collect()
    assert len(rows) == len(ROWS) and sum(r["media"] is None for r in rows) == 1 and sum("checksum" in (r["error"] or "") for r in rows) == 1


def test_warc_round_trip(spark):
    rng = random.Random(10)
    rows = [(i, f"http://{rng.choice(['www.', 'm.', ''])}h{i % 5}.example.com/{i % 9}?q={i}", make_text(rng, 20)) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[0][2]) for i in range(8)] + [(200, None, None), (201, "", ""), (202, "not a url", "é" * 100), (203, "http://x.example/\t#f", "z" * 300_000), rows[5], (204, "http://[bad", "q")]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, file int")
    got = sorted(tuple(r) for r in warc.warc_round_trip(table).select("page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), i)
    want = sorted((i, len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), "response" if last[t or ""] == i else "revisit", -1 if last[t or ""] == i else last[t or ""]) for i, _, t in rows)
    assert got == want
    assert warc.warc_round_trip(table.limit(0)).count() == 0


def test_capture_index_finds_records_by_url(spark, tmp_path):
    rows = [(i, f"https://site{i % 7}.example/{i}", f"page {i}") for i in range(500)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index = f"file://{tmp_path}/warc", f"file://{tmp_path}/cdx"
    captures = warc.write_warc(table, archives)
    directory = f"file://{tmp_path}/directory"
    warc.build_index(captures, index, block_lines=16).write.parquet(directory)
    blocks = spark.read.parquet(directory).collect()
    found = warc.CaptureIndex(archives, index, directory)
    assert len(blocks) > 30
    for i in (0, 3, 250, 499):
        key = f"{warc.url_key(rows[i][1])} {i}"
        found.around(key, key)
        assert len(found.directory) <= 2
        (where,) = found.find(key)
        headers, body = found.read(*where)
        assert body == f"page {i}".encode() and headers["warc-type"] == "response"
    found.around("nothing", "nothing")
    assert list(found.find("nothing")) == []


def test_captures_of_a_url(spark, tmp_path):
    """All captures of a URL without their page ids, over several blocks and lookup tasks; neighbours stay out."""
    rows = [(i, f"https://a.example/{'x' if i % 3 else 'xy'}", f"page {i}") for i in range(90)] + [(900, None, "none"), (901, "https://a.example/x!", "z")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index, directory = (f"file://{tmp_path}/{x}" for x in ("warc", "cdx", "directory"))
    warc.build_index(warc.write_warc(table, archives), index, block_lines=8).write.parquet(directory)
    urls = spark.createDataFrame([("http://a.example/x",), ("https://a.example/x",), ("https://b.example/",), (None,)], "url string")
    got = warc.lookup_urls(urls, archives, index, directory, table.schema["page_id"].dataType, tasks=3).collect()
    assert sorted(r["id"] for r in got) == [*(i for i in range(90) if i % 3), 900]
    assert {r["url"] for r in got} == {"https://a.example/x", ""}


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?B=1#f") == "com,example)/a?b=1"
    assert warc.url_key("https://m.a.example") == "example,a,m)/"
    assert warc.url_key(None) == "" and " " not in warc.url_key("http://a b.c/d e")

"""The fitted models against plain recomputation: a dense ridge and isotonic fit, and compressed sizes."""

import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tracelight.llm import langid, quality


def isotonic(totals, sums):
    """Level of each bin by the max-min formula."""
    n = len(totals)
    mean = lambda a, b: sum(sums[a : b + 1]) / sum(totals[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_quality_fit_equals_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    x = rng.normal(size=(600, d)) * rng.uniform(0.5, 3, d) + rng.normal(size=d)
    y = (x[:, 0] + np.sin(x[:, 1]) + rng.normal(size=600) * 0.5 > x[:, 0].mean()).astype(int)
    half = rng.integers(0, 2, 600)
    rows = spark.createDataFrame([(v.astype("<f8").tobytes(), int(a), int(b)) for v, a, b in zip(x, y, half)], "stats binary, label int, half int").repartition(7)
    model = quality.fit_quality(rows)
    center, scale = x.mean(axis=0), x.std(axis=0)
    z = quality.fourier((x - center) / scale)

    def ridge(keep):
        penalty = np.eye(z.shape[1]) * quality.RIDGE * keep.sum()
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(z[keep].T @ z[keep] + penalty, z[keep].T @ y[keep])

    whole = ridge(np.ones(600, bool))
    assert np.allclose(model.center, center) and np.allclose(model.scale, scale) and np.allclose(model.weights, whole, atol=1e-6)
    raw = np.where(half == 0, z @ ridge(half == 1), z @ ridge(half == 0))
    low, high = quality.SPAN
    cell = np.clip(((raw - low) / (high - low) * quality.BINS).astype(int), 0, quality.BINS - 1)
    used = np.unique(cell)
    want = isotonic([int((cell == c).sum()) for c in used], [int(y[cell == c].sum()) for c in used])
    assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(model.levels, 9))))
    score = model.score(x)
    assert np.allclose(score, np.interp(z @ whole, model.knots, model.levels), atol=1e-6) and (np.diff(model.levels) > 0).all()


def test_word_shares_are_counted_exactly():
    words = [f"w{i}" for i in range(20_000)]
    assert quality.statistics(" ".join(words).encode())[quality.STATISTICS.index("top_word")] == 1 / 20_000


def test_languages_by_their_compressed_sizes(spark):
    rng = random.Random(6)
    kinds = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "straße über gehen haben werden nicht".split(), "cc": "être avoir faire pouvoir vouloir déjà".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(2, 400))), k) for i in range(120) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(500 + i, " ".join(rng.choice(kinds["aa"] + kinds["bb"]) for _ in range(200)), "aa") for i in range(20)] + [(700, "lorem " * 3000, "aa"), (701, "zz", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(table.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    learned = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert set(model.dictionaries) == set(kinds) and 120 > len(learned) > 60
    coders = {}
    for lang, content in model.dictionaries.items():
        coders[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    ties = 0
    for r in langid.identify(table, model).collect():
        raw = r["text"].lower().encode()
        n = max(1, round(len(raw) / langid.BLOCK_BYTES))
        size = -(-len(raw) // n)
        sizes = {lang: sum(len(c.compress(raw[i : i + size])) for i in range(0, len(raw), size)) for lang, c in coders.items()}
        best, second = sorted(sizes.values())[:2]
        if best == second:
            ties += 1
            assert sizes[r["lang_pred"]] == best
        else:
            margin = (second - best) / second
            assert sizes[r["lang_pred"]] == best and abs(r["margin"] - margin) < 1e-12 and r["rejected"] == (margin < langid.MIN_MARGIN)
            assert abs(r["score"] - (1 - 0.5 * 2 ** (-margin / langid.MIN_MARGIN))) < 1e-12
    assert ties < 20


def test_languages_learned_are_bounded(spark):
    rows = [(i, f"text number {i} of some words", f"l{i % 7}") for i in range(70)] + [(99, "more words here", "l0")]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=3)
    assert set(model.dictionaries) == {"l0", "l1", "l2"}


def test_added_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "lorem ipsum dolor", "aa", 7, "x"), (2, "straße über gehen", "bb", 8, "y")], "doc_id long, text string, lang string, score int, margin string")
    out = langid.identify(rows, langid.fit_languages(rows))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "margin", "rejected"] and dict(out.dtypes)["score"] == "double"

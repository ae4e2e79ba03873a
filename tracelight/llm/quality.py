"""Quality scores: ridge regression on random Fourier features of document statistics, isotonic calibration.

Beside the cosines stand the standardized statistics and a constant: the kernel is Gaussian plus linear."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import materialize, tidy

STATISTICS = ("log_chars", "log_words", "word_length", "word_spread", "distinct_words", "repeated_lines", "log_lines", "upper", "digit", "space", "mark", "symbol", "other_bytes", "end_marks", "bigram_repeat", "top_word")
FEATURES = 160
RIDGE = 1e-3
BINS = 512
SEED = 20
#: Rows of the Gram matrix travel in so many pieces, to be summed apart.
PIECES = 8
SPAN = (-0.5, 1.5)

_LOWER, _UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_MARK = np.isin(np.arange(256), list(b".,;:'\"-()?"))
_OTHER = np.arange(256) >= 128
_SYMBOL = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _MARK | _OTHER)
_CLASSES = np.stack([_UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL, _OTHER]).astype(np.float64)


def statistics(raw: bytes) -> list[float]:
    """The document statistics of a whole UTF-8 text."""
    if not raw:
        return [0.0] * len(STATISTICS)
    upper, digit, space, mark, symbol, other = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int32, n)
    lines = raw.split(b"\n")
    counts = Counter(words)
    distinct = len(counts)
    top = pairs = 0.0
    if n:
        top = max(counts.values()) / n
        if n > 1:
            keys = np.fromiter(map(crc32, words), np.uint32, n)
            pairs = 1 - len(np.unique(keys[:-1] * np.uint32(2654435761) ^ keys[1:])) / (n - 1)
    ends = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), float(lengths.mean()) if n else 0.0, float(lengths.std()) if n else 0.0, distinct / n if n else 0.0,
        1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))), upper, digit, space, mark, symbol, other, ends / n if n else 0.0, pairs, top,
    ]


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.center) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0, 1 / np.sqrt(size), (size, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, the standardized statistics themselves, and a constant."""
    directions, phases = _projection(x.shape[1])
    x = np.clip(x, -6, 6)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), x / np.sqrt(x.shape[1]), np.ones((len(x), 1))])


def pool_violators(totals: np.ndarray, sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit to binned means: (place of each block, its level)."""
    blocks: list[list[float]] = []
    for n, s, x in zip(totals, sums, at):
        if not n:
            continue
        blocks.append([n, s, x * n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def document_statistics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``stats`` (64-bit floats, packed) of each row's whole text; null is empty."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("stats", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                packed = [np.array(statistics(t or b""), "<f8").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=schema.fieldNames())

    return df.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, len(STATISTICS))


def _solve(gram: np.ndarray) -> np.ndarray:
    size = len(gram) - 1
    ridge = np.eye(size) * RIDGE * max(gram[size - 1, size - 1], 1.0)
    ridge[size - 1, size - 1] = 1e-9
    return np.linalg.solve(gram[:size, :size] + ridge, gram[:size, size])


def fit_quality(examples: DataFrame) -> QualityModel | None:
    """Fit from rows ``stats``, ``label`` (0 or 1), ``half`` (0 or 1); None without examples.

    Normal equations are summed by partition, then in pieces across partitions; only their sum, of a
    size that does not depend on the rows, reaches the driver. Each half is scored by the other
    half's ridge weights, and isotonic regression on bins of these scores calibrates the fit to all."""
    d = len(STATISTICS)

    def moments(batches):
        total = np.zeros((3, d))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total += [np.full(d, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pieces_of([total])

    def add(_, table):
        sums = sum(np.frombuffer(v, "<f8") for v in table.column("v").to_pylist())
        return pa.table({"k": table.column("k")[:1], "part": table.column("part")[:1], "v": pa.array([sums.tobytes()], pa.binary())})

    kv = "k long, part long, v binary"
    examples = examples.select("stats", "label", "half")
    groups = max(1, ceil(sqrt(examples.rdd.getNumPartitions())))

    def summed(parts):
        """The partitions' sums are added in two steps, neither of which meets more than the root of their number in a task."""
        some = examples.mapInArrow(parts, kv).groupBy("k", F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(add, kv)
        return {r["k"]: np.frombuffer(r["v"], "<f8") for r in some.groupBy("k").applyInArrow(add, kv).collect()}

    def pieces_of(sums: list[np.ndarray]):
        n, part = len(sums), TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([part] * n, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], names=["k", "part", "v"])

    found = summed(moments)
    n, s, q = found[0].reshape(3, d) if found else np.zeros((3, d))
    if not n[0]:
        return None
    center = s / n
    scale = np.sqrt(np.maximum(q / n - center**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    size = FEATURES + d + 2

    def gram(batches):
        total = np.zeros((2, size, size))
        for batch in batches:
            if batch.num_rows:
                half = np.asarray(batch.column(2))
                z = np.hstack([fourier((_matrix(batch.column(0)) - center) / scale), np.asarray(batch.column(1), dtype=float)[:, None]])
                for h in (0, 1):
                    total[h] += z[half == h].T @ z[half == h]
        yield pieces_of([p for h in (0, 1) for p in np.array_split(total[h], PIECES)])

    pieces = summed(gram)
    halves = [np.concatenate([pieces[h * PIECES + k] for k in range(PIECES)]).reshape(size, size) for h in (0, 1)]
    whole = _solve(halves[0] + halves[1])
    by_half = [_solve(g) if g[size - 2, size - 2] else whole for g in reversed(halves)]
    low, high = SPAN

    def bins(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            if batch.num_rows:
                z = fourier((_matrix(batch.column(0)) - center) / scale)
                half = np.asarray(batch.column(2))
                raw = np.where(half == 0, z @ by_half[0], z @ by_half[1])
                cell = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
                total[0] += np.bincount(cell, minlength=BINS)
                total[1] += np.bincount(cell, weights=np.asarray(batch.column(1), dtype=float), minlength=BINS)
        yield pieces_of([total])

    totals, sums = summed(bins)[0].reshape(2, BINS)
    knots, levels = pool_violators(totals, sums, low + (np.arange(BINS) + 0.5) * (high - low) / BINS)
    return QualityModel(center, scale, whole, knots, np.clip(levels, 0.0, 1.0))


@tidy
def quality_scores(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_mod: int = 5) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` of every row.

    Rows whose crc32 of the id as text is 0 modulo ``held_out_mod`` are never learned from. The score
    depends on the text alone; null and empty texts share one. Rows with a null id are scored, not
    learned from; null labels and labels of unknown ids are ignored, repeated labels count each.
    Without labels every score is 0.5. Further columns are ignored."""
    stats = materialize(document_statistics(df, id_col=id_col, text_col=text_col), "quality-stats")
    crc = F.crc32(F.col(id_col).cast("string"))
    truth = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    examples = stats.where(crc % held_out_mod != 0).join(truth, F.col(id_col) == F.col("_id"))
    model = fit_quality(materialize(examples.select("stats", "label", F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)).alias("half")), "quality-examples"))
    schema = T.StructType([stats.schema[0], T.StructField("score", T.DoubleType())])

    def predict(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            score = np.full(len(x), 0.5) if model is None or not len(x) else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=schema.fieldNames())

    scored = stats.mapInArrow(predict, schema)
    return scored.select(id_col, F.coalesce(crc % held_out_mod == 0, F.lit(False)).alias("held_out"), "score")

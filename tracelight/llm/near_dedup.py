"""Near duplicates: SetSketch registers, banding, joint likelihood, verification on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import HOT_SHARE, give_back, join_groups, materialize, pieces, tidy
from tracelight.llm.graph import connected_components

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
#: Registers: a power of two; their base, rate and largest value.
REGISTERS = 128
BASE, RATE, LARGEST = 1.001, 20.0, 65535
#: Registers of a band. 32 bands of 4 miss a pair of similarity 0.75 about five times in a million.
BAND_ROWS = 4
#: Estimates below are not verified: 0.5 is over six deviations of the estimate under 0.75 and loses a pair of that similarity once in 1e9.
ESTIMATE_FLOOR = 0.5
#: Up to so many ids (8 bytes each) are broadcast to prune texts before they are shuffled.
BROADCAST_IDS = 250_000
#: Members of an unsettled bucket that one task compares with so many others, and members of a centre that are dealt together.
BLOCK = 256
FOLLOWERS = 64
#: Bytes of text whose shingles are hashed at a time.
SEGMENT = 1 << 18

_U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_ORDER = np.random.default_rng(7).permutation(REGISTERS)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U64(_MULTIPLIER))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, x, np.uint64))]) for x in (_MULTIPLIER, inverse))


#: Powers of the odd multiplier and of its inverse modulo 2**64, for SEGMENT bytes.
_UP, _DOWN = _powers(2 * SEGMENT)


def _hashes(normal: list[bytes], words: int) -> list[np.ndarray]:
    """Hashes of the shingles of each text, in text order."""
    buffer = np.frombuffer(b"\n".join(normal) + b"\n", np.uint8)
    up, down = (_UP, _DOWN) if len(buffer) <= 2 * SEGMENT else _powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=sums[1:])
    gaps = np.flatnonzero((buffer == 32) | (buffer == 10))
    ends = np.flatnonzero(buffer[gaps] == 10)  # the place, among the gaps, of each text's end
    starts = np.concatenate([[0], gaps[:-1] + 1])
    out, first = [], 0
    for text, last in zip(normal, ends.tolist()):
        n = last + 1 - first if text else 0
        span = min(words, n)
        s, e = starts[first : last + 2 - span], gaps[first + span - 1 : last + 1]
        out.append(_mix((sums[e] - sums[s]) * down[s] ^ _mix((e - s).astype(np.uint64))) if n else np.zeros(0, np.uint64))
        first = last + 1
    return out


def shingle_sets(texts: list[bytes | None], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text.

    A-Z become lower case, words are split at ASCII white space; fewer than ``words`` words are one
    shingle as a whole, none give the empty set. A shingle's hash is a polynomial over its bytes with
    the words one space apart, taken from prefix sums over some SEGMENT bytes at a time: short texts
    are put together, and a long one is cut into stretches that overlap by all but one of a shingle's words."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        nonlocal held, size
        for (k, _), found in zip(held, _hashes([x for _, x in held], words) if held else []):
            parts[k].append(found)
        held, size = [], 0

    for k, text in enumerate(texts):
        own = (text or b"").lower().split()
        normal = b" ".join(own)
        step = max(1, len(own) * SEGMENT // max(len(normal), 1)) if len(normal) > SEGMENT else len(own)
        for at in range(0, max(1, len(own) - words + 1), max(1, step)):
            part = normal if step >= len(own) else b" ".join(own[at : at + step + words - 1])
            held.append((k, part))
            size += len(part)
            if size >= SEGMENT:
                flush()
    flush()
    out = []
    for found in parts:
        h = found[0] if len(found) == 1 else np.concatenate(found)
        h.sort()
        out.append(h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])])
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of each set, one row each, 16 bits a register; an empty set has zeros.

    Every element throws a point into each of REGISTERS intervals, one after the other, for registers
    in an order of its own; a register keeps its smallest point. As a set's registers are filled after
    a few intervals, later ones need not be thrown. Registers are the points' exponents to the base
    BASE of exponential variates, cut off at 0 and LARGEST: the maximum of two sketches, register by
    register, is the sketch of the union."""
    m = REGISTERS
    low = np.full((len(sets), m), 1.0)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    place = (h >> _U64(7)) & _U64(m - 1)
    step = ((h >> _U64(20)) & _U64(m - 1)) | _U64(1)
    flat = low.ravel()
    for j in range(m):
        if not len(h):
            break
        u = (_mix(h + _U64((j + 1) * _MULTIPLIER & (1 << 64) - 1)) >> _U64(11)).astype(np.float64) * 2.0**-53
        register = (place + step * _U64(j)) & _U64(m - 1)
        np.minimum.at(flat, owner * m + register.astype(np.int64), (j + u) / m)
        open_ = low.max(axis=1) > (j + 1) / m
        if not open_[owner].all():
            keep = open_[owner]
            h, place, step, owner = h[keep], place[keep], step[keep], owner[keep]
    points = -np.log1p(-np.clip(low, 1e-300, 1 - 1e-16)) / RATE
    registers = np.clip(np.floor(1 - np.log(points) / np.log(BASE)), 0, LARGEST).astype(np.uint16)
    registers[sizes == 0] = 0
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of BAND_ROWS registers: (sets, bands)."""
    bands = REGISTERS // BAND_ROWS
    packed = np.ascontiguousarray(registers[:, _ORDER].reshape(-1, bands, BAND_ROWS)).view(np.uint64)[:, :, 0]
    return _mix(packed ^ _mix(np.arange(1, bands + 1, dtype=np.uint64) * _U64(_MULTIPLIER))).view(np.int64)


def estimate(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of register rows, with known set sizes.

    The counts of smaller, larger and equal registers are multinomial, with probabilities that
    follow from the similarity and the sizes; their log-likelihood is concave in it."""
    plus, minus = (first > second).sum(axis=1), (first < second).sum(axis=1)
    equal = REGISTERS - plus - minus
    u = n_first / (n_first + n_second)
    v = 1 - u

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        a, b = np.maximum(p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(p(np.maximum(v - u * j, 0)), 1e-12)
        return plus * np.log(a) + minus * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def reaches(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, floor: float = ESTIMATE_FLOOR) -> np.ndarray:
    """Whether the estimate is at least ``floor``: as the likelihood is concave, whether it still rises there."""
    plus, minus = (first > second).sum(axis=1), (first < second).sum(axis=1)
    u = n_first / (n_first + n_second)
    v = 1 - u
    c, log_base = (BASE - 1) / BASE, np.log(BASE)
    x, y = np.maximum(u - v * floor, 0), np.maximum(v - u * floor, 0)
    a, b = np.maximum(-np.log1p(-x * c) / log_base, 1e-12), np.maximum(-np.log1p(-y * c) / log_base, 1e-12)
    da, db = -v * c / (log_base * (1 - x * c)), -u * c / (log_base * (1 - y * c))
    rise = plus * da / a + minus * db / b - (REGISTERS - plus - minus) * (da + db) / np.maximum(1 - a - b, 1e-12)
    return (rise >= 0) & (np.minimum(u / v, v / u) >= floor)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _packed_sets(column) -> list[np.ndarray]:
    """Sets of a binary column, without copies."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    return [np.frombuffer(data, np.uint64, (e - s) // 8, s) if e > s else np.zeros(0, np.uint64) for s, e in zip(ends, ends[1:])]


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("registers", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist())
                rows = sketch(sets)
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], names=schema.fieldNames())

    return df.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(give_back(run), schema)


def _bands(reps: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.LongType()), reps.schema["id"]])

    def run(batches):
        for batch in batches:
            keys = band_keys(_registers(batch.column(1)))
            index = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(index)], names=["key", "id"])

    return reps.select("id", "registers").mapInArrow(run, schema)


def _met(pairs: DataFrame, table: DataFrame, test) -> DataFrame:
    """Pairs (``a``, ``b``) of which ``test`` holds for some rows of both in ``table`` (``id``, ``n``, ``data``).

    Each a has one pair, while a b may have any number: its a are dealt to groups of about FOLLOWERS, each of which gets
    b's rows once, ahead of them, and goes through the others as they come. ``test`` takes one (n, data) and an Arrow
    batch of (n, data) and tells which rows pass."""
    schema = pairs.select("a", "b").schema
    total = pairs.count()
    many = pairs.groupBy("b").agg(F.count("*").alias("_count")).where(F.col("_count") > FOLLOWERS)
    dealt = join_groups(pairs.select("a", "b"), many, ["b"], "_count", total, F.col("a"))
    parts = F.coalesce(F.ceil(F.col("_count") / FOLLOWERS), F.lit(1)).cast("long")
    dealt = dealt.select("a", "b", parts.alias("_parts"), F.pmod(F.xxhash64("a"), parts).alias("_part"))
    rows = table.select("id", "n", "data")
    followers = dealt.join(rows, dealt["a"] == rows["id"]).select("b", "_part", F.lit(1).alias("_turn"), "a", "n", "data")
    heads = dealt.select("b", "_parts").distinct().join(rows, F.col("b") == rows["id"])
    heads = heads.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_turn"), F.col("b").alias("a"), "n", "data")
    together = heads.unionByName(followers).repartition(F.col("b"), F.col("_part")).sortWithinPartitions("b", "_part", "_turn")

    def run(batches):
        group, heads, fresh = None, [], True
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            turns = batch.column(2).to_pylist()
            keep, at = np.zeros(batch.num_rows, bool), 0
            while at < batch.num_rows:
                stop = at + 1
                while stop < batch.num_rows and keys[stop] == keys[at] and turns[stop] == turns[at]:
                    stop += 1
                part = batch.slice(at, stop - at)
                if turns[at] == 0:
                    if group != keys[at] or not fresh:
                        group, heads, fresh = keys[at], [], True
                    heads += list(zip(part.column(4).to_pylist(), part.column(5).to_pylist()))
                elif group == keys[at]:
                    fresh = False
                    for n, data in heads:
                        keep[at:stop] |= test(n, data, part.column(4), part.column(5))
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0)], names=["a", "b"]).filter(pa.array(keep))

    return together.select("b", "_part", "_turn", "a", "n", "data").mapInArrow(give_back(run), schema)


def _likely(n: int, data: bytes, others, registers) -> np.ndarray:
    rows = _registers(registers)
    return reaches(np.broadcast_to(np.frombuffer(data, np.uint16), rows.shape), rows, np.full(len(rows), float(n)), np.asarray(others, dtype=float))


def _full_sets(ids: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` and packed shingle set (``data``) of the ids in column ``_w``; texts are read again for these only.

    An id has a row for each of its distinct sets."""
    ids = materialize(ids.distinct(), "near-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("_text"))
    texts = source.join(wanted, source["id"] == ids["_w"], "left_semi")
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])

    def sets(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                found = shingle_sets(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=schema.fieldNames())

    return materialize(texts.mapInArrow(give_back(sets), schema).where("n > 0"), "near-sets")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test on sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    full = _full_sets(pairs.select(F.col("a").alias("_w")).unionByName(pairs.select(F.col("b").alias("_w"))), df, id_col, text_col)

    def alike(n, data, others, sets):
        own = np.frombuffer(data, np.uint64)
        return np.array([_alike(own, x, percent) for x in _packed_sets(sets)], bool)

    return _met(pairs, full, alike)


def _open_buckets(members: DataFrame, components: DataFrame, reps: DataFrame, total: int) -> DataFrame:
    """Members of buckets that hold two components: key, id, component, registers, n, count, minor, minors.

    All but the members of the bucket's largest component are ``minor``: a pair across components has one at least."""
    placed = members.select("key", "id", "count").join(components.withColumnRenamed("node", "id"), "id", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "id")), "near-placed")
    total *= REGISTERS // BAND_ROWS
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("_m"))
    split = parts.groupBy("key").agg(F.max(F.struct("_m", "component")).alias("_most"), F.sum("_m").alias("_n"))
    split = split.where((F.col("_n") > F.col("_most._m")) | (F.col("_n") * HOT_SHARE >= F.lit(total)))
    split = split.select("key", F.col("_most.component").alias("_major"), (F.col("_n") - F.col("_most._m")).alias("minors"), "_n")
    found = join_groups(placed, split, ["key"], "_n", total, F.col("id")).where("minors > 0")
    found = found.withColumn("minor", F.col("component") != F.col("_major"))
    return materialize(found.join(reps, "id").select("key", "id", "component", "registers", "n", "count", "minor", "minors"), "near-open")


def _dealt(members: DataFrame, *more: str) -> DataFrame:
    """Bucket members for tasks that compare them. A bucket of up to BLOCK members is one group (role 0). A larger one
    is a grid of groups: a block of its minor members (role 1) meets a block of all its members (role 2)."""
    across, down = F.ceil(F.col("count") / BLOCK).cast("int"), F.ceil(F.col("minors") / BLOCK).cast("int")
    place = lambda x, y, role: F.struct(x.cast("int").alias("_x"), y.cast("int").alias("_y"), F.lit(role).alias("_role"))
    block = lambda name, n: F.pmod(F.xxhash64("id", F.lit(name)), n)
    whole = F.transform(F.sequence(F.lit(0), down - 1), lambda x: place(x, block("all", across), 2))
    minor = F.transform(F.sequence(F.lit(0), across - 1), lambda y: place(block("minor", down), y, 1))
    places = F.when(F.col("count") <= BLOCK, F.array(place(F.lit(0), F.lit(0), 0))).when(F.col("minor"), F.concat(whole, minor)).otherwise(whole)
    dealt = members.withColumn("_p", F.explode(places)).select("key", "_p._x", "_p._y", "_p._role", "id", "component", "registers", "n", *more)
    return dealt.repartition(F.col("key"), F.col("_x"), F.col("_y")).sortWithinPartitions("key", "_x", "_y", "id")


def _whole_groups(batches):
    """Tables of (key, _x, _y, ...) rows cut where groups end."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = _group_keys(table)
        changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if len(changes):
            last = int(changes[-1]) + 1
            yield table.slice(0, last)
            table = table.slice(last)
        held = table
    if held is not None and held.num_rows:
        yield held


def _group_keys(table) -> np.ndarray:
    return np.stack([np.asarray(table.column(i), dtype=np.int64) for i in (0, 1, 2)], axis=1)


def _likely_in_groups(table):
    """Arrays (i, j, equal registers, group) of row pairs of one group and two components whose estimate reaches the floor.

    A pair that shares several bands is taken in the first of them only."""
    keys = _group_keys(table)
    group = np.cumsum(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) - 1
    role, n = np.asarray(table.column(3)), np.asarray(table.column(7), dtype=float)
    names: dict = {}
    part = np.array([names.setdefault(c, len(names)) for c in table.column(5).to_pylist()])
    registers = _registers(table.column(6))
    bands = band_keys(registers)
    for d in range(1, len(group)):
        i = np.flatnonzero(group[:-d] == group[d:])
        if not len(i):
            break
        j = i + d
        fits = (part[i] != part[j]) & ((role[i] != role[j]) | (role[i] == 0))
        i, j = i[fits], j[fits]
        for at in range(0, len(i), 20_000):
            a, b = i[at : at + 20_000], j[at : at + 20_000]
            same = bands[a] == bands[b]
            first = bands[a, same.argmax(axis=1)] == keys[a, 0]
            a, b = a[first], b[first]
            keep = reaches(registers[a], registers[b], n[a], n[b])
            if keep.any():
                a, b = a[keep], b[keep]
                yield a, b, (registers[a] == registers[b]).sum(axis=1), group[a]


def _best_partners(open_: DataFrame) -> DataFrame:
    """Per member of an open bucket, the likely one of another component that shares most registers: a pair (a, b) for an a at most."""
    kind = open_.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("equal", T.LongType())])

    def run(batches):
        for table in _whole_groups(batches):
            best: dict[int, tuple[int, int]] = {}
            for a, b, equal, _ in _likely_in_groups(table):
                for x, y, e in zip(a.tolist(), b.tolist(), equal.tolist()):
                    for p, q in ((x, y), (y, x)):
                        if best.get(p, (-1, 0))[0] < e:
                            best[p] = (e, q)
            ids = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(list(best), pa.int64())), ids.take(pa.array([q for _, q in best.values()], pa.int64())), pa.array([e for e, _ in best.values()], pa.int64())], names=["a", "b", "equal"])

    found = _dealt(open_).mapInArrow(run, schema)
    return found.groupBy("a").agg(F.max(F.struct("equal", "b"))["b"].alias("b"))


def _involved(open_: DataFrame) -> DataFrame:
    """Rows of open buckets that are in a likely pair there."""
    kind = open_.schema["id"].dataType

    def run(batches):
        for table in _whole_groups(batches):
            rows = [x for a, b, _, _ in _likely_in_groups(table) for x in (a, b)]
            at = pa.array(np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(at), table.column(4).combine_chunks().take(at)], names=["key", "id"])

    found = _dealt(open_).mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind)])).distinct()
    return open_.join(found, ["key", "id"], "left_semi")


def _settling_links(involved: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components among the rows of each bucket, by full sets: every likely pair is tested unless the
    group's earlier links have joined the two components, so a group gives fewer links than it has components."""
    kind = involved.schema["id"].dataType

    def run(batches):
        for table in _whole_groups(batches):
            full, names = _packed_sets(table.column(8)), table.column(5).to_pylist()
            root: dict = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x

            found = []
            for a, b, _, group in _likely_in_groups(table):
                for i, j, g in zip(a.tolist(), b.tolist(), group.tolist()):
                    x, y = find((g, names[i])), find((g, names[j]))
                    if x != y and _alike(full[i], full[j], percent):
                        root[x] = y
                        found.append((i, j))
            ids = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1)], names=["a", "b"])

    dealt = _dealt(involved.join(sets.select("id", "data"), "id"), "data")
    return dealt.mapInArrow(give_back(run), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


@tidy
def near_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Rows of equal shingle sets form a class first, and only the class's smallest id goes on. Sketch
    bands put likely pairs into buckets. Each class is first paired with the one centre (smallest id
    of a bucket) that it shares most bands with, then, across the components that verified links give,
    with the likeliest partner in its buckets. What is left of buckets with two components is gone
    through in full where their members meet: every pair across components whose likelihood estimate
    allows it is tested on full sets, unless it is joined by then. So no task writes a bucket's pairs,
    and no link that would join two components is passed over.

    Null and empty texts have no shingles and are components of their own, kept. Rows repeated with
    one id share a component, whether their texts are equal or not; all of them are kept if that id is
    its smallest. Rows with a null id are left out of links and kept. Further columns are ignored; an
    empty table gives no rows."""
    table = materialize(sketches(df, id_col, text_col), "near-sketches")
    total = table.count()
    linked = table.where("n > 0 and id is not null")
    classes = materialize(linked.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "near-classes")
    shared = classes.where("size > 1")
    reps_of = join_groups(table.select("id", "n", "same"), shared, ["same"], "size", total, F.col("id"))
    reps_of = reps_of.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"))
    # an id with two texts stands in two classes, which it links
    twice = reps_of.where("id is not null").groupBy("id").agg(F.collect_set("rep").alias("_reps")).where("size(_reps) > 1")
    twice = twice.select(F.col("id").alias("a"), F.explode("_reps").alias("b")).where("a <> b")
    lone = linked.join(classes.select("same", "rep"), [linked["same"] == classes["same"], linked["id"] == classes["rep"]], "left_semi")
    variants = materialize(lone.select("id", "same", "n", "registers").dropDuplicates(["id", "same"]).drop("same"), "near-reps")

    bands = materialize(_bands(variants).distinct() if variants.select("id").distinct().count() < variants.count() else _bands(variants), "near-bands")
    buckets = bands.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("count")).where("count > 1")
    members = materialize(join_groups(bands, buckets, ["key"], "count", total * (REGISTERS // BAND_ROWS), F.col("id")).where("count is not null"), "near-members")
    centred = members.where("id <> low").groupBy("id", "low").agg(F.count("*").alias("bands"))
    best = centred.groupBy("id").agg(F.min(F.struct((-F.col("bands")).alias("bands"), F.col("low"))).alias("best"))
    pairs = materialize(best.select(F.col("id").alias("a"), F.col("best.low").alias("b")), "near-centres")
    pairs = materialize(_met(pairs, variants.withColumnRenamed("registers", "data"), _likely), "near-pairs")
    links = materialize(_verified(pairs, df, id_col, text_col, percent).unionByName(twice), "near-links")
    components = materialize(connected_components(links), "near-components")

    best = materialize(_best_partners(_open_buckets(members, components, variants, total)), "near-pairs")
    links = materialize(links.unionByName(_verified(best, df, id_col, text_col, percent)), "near-links")
    components = materialize(connected_components(links), "near-components")

    involved = materialize(_involved(_open_buckets(members, components, variants, total)), "near-involved")
    sets = _full_sets(involved.select(F.col("id").alias("_w")), df, id_col, text_col)
    links = materialize(links.unionByName(_settling_links(involved, sets, percent)), "near-links")
    components = materialize(connected_components(links), "near-components")

    sizes = reps_of.where("rep is not null").groupBy("rep").agg(F.count("*").alias("_n"))
    roots = sizes.join(components, sizes["rep"] == components["node"], "left").select("rep", F.col("component").alias("_component"), "_n")
    roots = roots.where(F.col("_component").isNotNull() | (F.col("_n") * HOT_SHARE >= F.lit(total)))
    out = join_groups(reps_of, roots, ["rep"], "_n", total, F.col("id"))
    component = F.coalesce("_component", "rep")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import give_back, materialize, tidy
from tracelight.llm.bpe import chunk_ids

WINDOW = 2048
SMALLEST = 256
END_ID = 1
#: Documents packed against each other at a time; what does not fill a window is carried on.
BLOCK = 4096
TOKENS_PER_STEP = 1 << 16


class TierPacker:
    """Cuts and places documents into windows of power-of-two tiers without padding.

    A document is routed by length: whole ``window`` pieces stand alone, the rest goes to the
    smallest tier that holds it. Tiers are packed from long to short; the gap of each window takes
    the longest pieces of shorter tiers that fit, and the last bit of a gap is cut from the shortest
    that does not. Windows that nothing is left to fill are carried to the next block; at the end
    the carried pieces are laid out in a row and cut at the window and then at falling powers of two."""

    def __init__(self, window: int = WINDOW, smallest: int = SMALLEST):
        self.window, self.tiers = window, []
        t = window
        while t >= min(smallest, window):
            self.tiers.append(t)
            t //= 2
        self.carried: list[tuple[int, int, int]] = []  # length, start, document
        self.sequences: list[tuple[int, list[tuple[int, int, int]]]] = []  # tier, its (document, start, length)

    def pack(self, documents: list[tuple[int, int]]) -> None:
        """documents: (key, tokens)."""
        routed: dict[int, list] = {t: [] for t in self.tiers}
        for length, start, doc in self.carried:
            routed[self._tier(length)].append((length, start, doc))
        self.carried = []
        for doc, tokens in documents:
            start = 0
            while tokens - start >= self.window:
                self.sequences.append((self.window, [(doc, start, self.window)]))
                start += self.window
            if tokens > start:
                routed[self._tier(tokens - start)].append((tokens - start, start, doc))
        pool = sorted(x for t in self.tiers[1:] for x in routed[t])
        longest = sorted(routed[self.tiers[0]], reverse=True)
        for at, tier in enumerate(self.tiers):
            if at:
                cut = bisect_right(pool, (tier // 2 if at + 1 < len(self.tiers) else 0, 1 << 62))
                while len(pool) > cut:
                    self._fill(tier, pool.pop(), pool)
                    cut = bisect_right(pool, (tier // 2 if at + 1 < len(self.tiers) else 0, 1 << 62))
            else:
                for piece in longest:
                    self._fill(tier, piece, pool)

    def _tier(self, length: int) -> int:
        return next(t for t in reversed(self.tiers) if length <= t) if length <= self.window else self.window

    def _fill(self, tier: int, piece: tuple[int, int, int], pool: list) -> None:
        placed, gap = [piece], tier - piece[0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 1 << 62)) - 1
            if at >= 0:
                length, start, doc = pool.pop(at)
                placed.append((length, start, doc))
                gap -= length
            else:
                length, start, doc = pool.pop(0)
                placed.append((gap, start, doc))
                insort(pool, (length - gap, start + gap, doc))
                gap = 0
        if gap:
            self.carried += placed
        else:
            self.sequences.append((tier, [(d, s, n) for n, s, d in placed]))

    def finish(self) -> None:
        left = sum(x[0] for x in self.carried)
        row = sorted(self.carried, reverse=True)
        self.carried = []
        size = self.window
        at, taken = 0, 0
        while left:
            while size > left:
                size //= 2
            placed, need = [], size
            while need:
                length, start, doc = row[at]
                n = min(need, length - taken)
                placed.append((doc, start + taken, n))
                taken += n
                need -= n
                if taken == length:
                    at, taken = at + 1, 0
            self.sequences.append((size, placed))
            left -= size


@tidy
def pack(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW, smallest: int = SMALLEST, tokens_per_step: int = TOKENS_PER_STEP) -> DataFrame:
    """Pieces of packed sequences: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``tier``, ``step_group``.

    Documents are tokenized and packed where they are read, so no text or ids are shuffled; every
    sequence holds a power of two of tokens at most ``window``, so none needs padding. ``tier`` is
    that number. Step groups balance the work of training steps: each holds sequences of one tier,
    whose linear and quadratic costs add up to those of ``tokens_per_step`` tokens in windows at most; a
    tier's sequences are shared evenly among its groups, and no two tiers share a group number.

    A null text is empty; an empty text is its end id alone. Repeated rows and null ids are packed as
    documents of their own. Very long texts become whole windows and a rest. Further columns are
    ignored. An empty table has no pieces."""
    id_type = df.schema[id_col].dataType
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "_part", "_nth")
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in longs)])
    arrow_id = None

    def run(batches):
        lib, packer, part = chunk_ids(tokenizer_path), TierPacker(window, smallest), TaskContext.get().partitionId()
        tail = end_id.to_bytes(4, "little")
        held: dict[int, list] = {}  # document -> [id, ids, pieces' tokens left]
        serial, nth, block = 0, {}, []
        id_arrow = arrow_id

        def flush():
            columns = [[] for _ in schema.fields]
            for tier, placed in packer.sequences:
                number = flush.sequences
                flush.sequences += 1
                order = nth.get(tier, 0)
                nth[tier] = order + 1
                offset = 0
                for doc, start, length in placed:
                    entry = held[doc]
                    row = (entry[0], start, length, zlib.crc32(memoryview(entry[1])[4 * start : 4 * (start + length)]), len(entry[1]) // 4, (part << 32) + number, offset, tier, part, order)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += length
                    entry[2] -= length
                    if not entry[2]:
                        del held[doc]
            packer.sequences = []
            types = [id_arrow, *[pa.int64()] * len(longs)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.fieldNames())

        flush.sequences = 0
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                view = batch.slice(at, 256)
                ids = lib.encode([t or b"" for t in view.column(1).to_pylist()])
                for name, own in zip(view.column(0).to_pylist(), ids):
                    own += tail
                    held[serial] = [name, own, len(own) // 4]
                    block.append((serial, len(own) // 4))
                    serial += 1
                if len(block) >= BLOCK:
                    packer.pack(block)
                    block = []
                    yield flush()
        if id_arrow is not None:
            packer.pack(block)
            packer.finish()
            yield flush()

    source = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    pieces = materialize(source.mapInArrow(give_back(run), schema), "pieces")
    counts = pieces.where("offset = 0").groupBy("_part", "tier").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("tier").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("tier")))
    tiers = counts.groupBy("tier").agg(F.max("_all").alias("_all")).withColumn("_groups", _groups_of(F.col("tier"), F.col("_all"), window, tokens_per_step))
    earlier = Window.orderBy(F.col("tier").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each tier
    tiers = tiers.select("tier", "_groups", F.coalesce(F.sum("_groups").over(earlier), F.lit(0)).alias("_base"))
    counts = counts.join(F.broadcast(tiers), "tier")
    group = F.col("_base") + F.floor((F.col("_before") + F.col("_nth")) * F.col("_groups") / F.col("_all"))
    out = pieces.join(counts, ["_part", "tier"]).withColumn("step_group", group.cast("long"))
    return out.select(id_col, *longs[:-2], "step_group")


def _groups_of(tier, sequences, window: int, tokens_per_step: int):
    """Step groups of a tier. A sequence costs its tokens and, as much again at the window, their square: a group's
    cost is that of ``tokens_per_step`` tokens in windows, whatever its tier."""
    most = F.greatest(F.lit(1), F.floor(F.lit(2.0 * tokens_per_step * window) / (tier * (tier + window))))
    return F.ceil(sequences / most)

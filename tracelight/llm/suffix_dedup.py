"""Removal of long substrings that repeat across documents, by suffix sorting of the places where repeats can be.

Equal strings of MATCH bytes have the same anchor: of the GRAM-byte strings they hold, the first with
the least hash. So each window of MATCH bytes is sent to the shard of its anchor, and equal windows
meet there. Only anchors seen in two documents travel at all, as regions (the windows that share one
anchor occurrence, overlapping); each shard orders the suffixes of its regions by external induced
sorting, and runs of suffixes with MATCH bytes in common tell each window's smallest document. An
anchor of very many occurrences would make its shard grow with the corpus; its windows are regions by
themselves, dealt by their own hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import give_back, join_groups, materialize, tidy
from tracelight.llm.suffix_order import InducedSort

MATCH = 50
GRAM = 24
#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of text behind one bucket of anchor hashes, and behind one shard of regions.
BUCKET_TEXT = 16 << 20
SHARD_TEXT = 2 << 20
#: Shards of a task on average, one in memory at a time: a task writes one file, which on file:// costs the executor three chmod processes.
SHARDS_PER_TASK = 4
#: An anchor that occurs so often is hot: its windows go to shards of their own rather than all to the anchor's.
HOT_ANCHOR = 8192
#: Replies up to so many bytes are broadcast to the chunks; more meet them in a shuffled join.
BROADCAST_BYTES = 64 << 20
#: Bytes of queues a shard keeps in memory; the rest is on disk.
MEMORY = 48 << 20
PIECE = 1 << 16

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _gram_hash(buffer: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from every place, or from the given ones."""
    words = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    places = len(buffer) - GRAM + 1
    h = None
    for shift in range(0, GRAM, 8):
        word = words[at + shift] if at is not None else words[shift : shift + places]
        h = _mix(word if h is None else h * _U(0x9E3779B97F4A7C15) + word)
    return h


def _window_hash(buffer: np.ndarray, at: np.ndarray, match: int) -> np.ndarray:
    """64-bit hashes of the ``match`` bytes from the given places."""
    words = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    h = np.full(len(at), match, np.uint64)
    for shift in (*range(0, match - 7, 8), match - 8):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + words[at + shift])
    return h


def anchors(text: bytes, sizes: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: (first window, windows, document number, anchor hash).

    text: documents put together; sizes: their lengths. Windows stay inside documents."""
    buffer, ends = np.frombuffer(text, np.uint8), np.cumsum(sizes)
    span = match - GRAM + 1
    total = len(buffer) - match + 1
    if total <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    found = np.empty(total, np.int64)
    low = _U(PIECE * 2 - 1)
    for start in range(0, total, PIECE):
        part = buffer[start : min(start + PIECE, total) + match - 1]
        h = (_gram_hash(part) & ~low) | np.arange(len(part) - GRAM + 1, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if span > width:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        found[start : start + PIECE] = (h & low).astype(np.int64) + start
    document = np.repeat(np.arange(len(sizes)), sizes)[:total]
    inside = np.arange(total) + match <= ends[document]
    new = np.empty(total, bool)
    new[0] = True
    new[1:] = (found[1:] != found[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new & inside)
    # windows of a run are inside together: what is outside is the end of a document's windows
    stops = np.flatnonzero(np.append(new[1:] | (inside[:-1] & ~inside[1:]), True)) + 1
    count = stops[np.searchsorted(stops, first, side="right")] - first
    return first, count, document[first], _gram_hash(buffer, found[first])


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31)


CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("text", T.BinaryType())])


def _chunks(batches):
    """Documents put together, sorted by id within a chunk, and compressed: chunks are moved again for their replies."""
    part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush():
        nonlocal serial, held, size
        held.sort(key=lambda x: x[0])
        row = ((part << 32) + serial, np.array([x[0] for x in held], "<i8").tobytes(), np.array([len(x[1]) for x in held], "<i8").tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join([x[1] for x in held])))
        serial, held, size = serial + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=CHUNK.fieldNames())

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            view = batch.slice(at, 256)
            for name, text in zip(view.column(0).to_pylist(), view.column(1).to_pylist()):
                if held and size + len(text) > CHUNK_BYTES:
                    yield flush()
                held.append((name, text))
                size += len(text)
    if held:
        yield flush()


def _chunk_rows(batch):
    for at in range(batch.num_rows):
        chunk, ids, sizes, text, *more = (c[at].as_py() for c in batch.columns)
        sizes = np.frombuffer(sizes, "<i8")
        yield chunk, np.frombuffer(ids, "<i8"), sizes, zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(sizes.sum()))), *more


def _places(document: np.ndarray, keys: np.ndarray, buckets: int):
    """Distinct anchor hashes of a chunk by bucket: (bucket and 32-bit hash in one, whether two documents have it and how often it occurs, place of each anchor)."""
    joined = ((keys >> _U(32)) % _U(buckets) << _U(32)) | (keys & _U(0xFFFFFFFF))
    distinct, place = np.unique(joined, return_inverse=True)
    least, most = np.full(len(distinct), 1 << 60), np.full(len(distinct), -1)
    np.minimum.at(least, place, document)
    np.maximum.at(most, place, document)
    often = np.minimum(np.bincount(place, minlength=len(distinct)), 0x7FFF)
    return distinct, (often | (least != most).astype(np.int64) << 15).astype("<u2"), place


def _anchor_rows(buckets: int, match: int):
    """Per chunk and bucket: the 32-bit hashes, how often each occurs in the chunk and whether in two documents."""

    def run(batches):
        for batch in batches:
            for chunk, _, sizes, text in _chunk_rows(batch):
                _, _, document, keys = anchors(text, sizes, match)
                distinct, seen, _ = _places(document, keys, buckets)
                bucket = (distinct >> _U(32)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
                rows = [(int(bucket[s]), chunk, distinct[s:e].astype("<u4").tobytes(), seen[s:e].tobytes()) for s, e in zip(cuts[:-1], cuts[1:])]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "keys", "seen"])

    return run


def _repeated(hot_anchor: int):
    """Per chunk and bucket, a bit for each hash: whether it occurs in two documents anywhere; then, if any is hot, another: whether it is.

    Buckets are dealt to tasks by hash, several to some: rows wait as they come, and one bucket at a time is laid out."""

    def one(bucket, rows):
        hashes = [np.frombuffer(r[1], "<u4") for r in rows]
        joined = np.concatenate(hashes)
        order = np.argsort(joined, kind="stable")
        own, seen = joined[order], np.concatenate([np.frombuffer(r[2], "<u2") for r in rows])[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
        counts = np.diff(np.append(starts, len(own)))
        flags = np.empty((2, len(own)), bool)
        if len(own):
            flags[0, order] = np.repeat((counts > 1) | np.logical_or.reduceat(seen >> 15, starts).astype(bool), counts)
            flags[1, order] = np.repeat(np.add.reduceat((seen & 0x7FFF).astype(np.int64), starts) >= hot_anchor, counts)
        cuts = np.cumsum([0, *map(len, hashes)])
        bits = [np.packbits(flags[0, s:e]).tobytes() + (np.packbits(flags[1, s:e]).tobytes() if flags[1, s:e].any() else b"") for s, e in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array(bits, pa.binary())], names=["chunk", "part", "reply"])

    def run(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for bucket, chunk, keys, seen in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(bucket, []).append((chunk, keys, seen))
        for bucket in list(rows):
            yield one(bucket, rows.pop(bucket))

    return run


#: shard -1 holds what the chunk itself needs later: its windows' runs and the region each repeats.
REGION = T.StructType([T.StructField("shard", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])


def _region_rows(buckets: int, shards: int, match: int):
    """Regions of repeated anchors, each distinct one of a chunk once, with the smallest id that has it.

    All regions of an anchor go to one shard, but for hot anchors: each of their windows is a region of its own there,
    and goes to the shard of its own hash, where equal windows meet as well."""

    def run(batches):
        for batch in batches:
            for chunk, ids, sizes, text, reply in _chunk_rows(batch):
                first, count, document, keys = anchors(text, sizes, match)
                distinct, _, place = _places(document, keys, buckets)
                bucket = (distinct >> _U(32)).astype(np.int64)
                again, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
                for r in reply or []:
                    s, e = np.searchsorted(bucket, [r["part"], r["part"] + 1])
                    bits = np.frombuffer(r["reply"], np.uint8)
                    again[s:e] = np.unpackbits(bits, count=e - s)
                    if len(bits) > -(-(e - s) // 8):
                        hot[s:e] = np.unpackbits(bits[-(-(e - s) // 8) :], count=e - s)
                take = np.flatnonzero(again[place])
                own = hot[place][take]
                first, count, document, keys = first[take], count[take], document[take], keys[take]
                if own.any():
                    parts = np.where(own, count, 1)
                    which = np.repeat(np.arange(len(parts)), parts)
                    first = first[which] + np.where(own[which], np.arange(len(which)) - (np.cumsum(parts) - parts)[which], 0)
                    count, document, keys, own = np.where(own, 1, count)[which], document[which], keys[which], own[which]
                    keys = np.where(own, _window_hash(np.frombuffer(text, np.uint8), first, match), keys)
                shard = ((keys >> _U(17)) % _U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                first, count, document, keys, shard = first[order], count[order], document[order], keys[order], shard[order]
                known: dict[bytes, int] = {}
                region = np.fromiter((known.setdefault(text[s : s + n + match - 1], len(known)) for s, n in zip(first.tolist(), count.tolist())), np.int64, len(first))
                highest = np.maximum.accumulate(region) if len(region) else region
                new = np.flatnonzero(np.append(True, highest[1:] > highest[:-1])) if len(region) else np.zeros(0, int)
                # documents are in order of id, so the first to have a region has the smallest
                owner = np.full(len(known), len(ids), np.int64)
                np.minimum.at(owner, region, document)
                texts = list(known)
                rows = []
                cuts = np.append(np.flatnonzero(np.append(True, shard[new][1:] != shard[new][:-1])), len(new)) if len(new) else np.zeros(1, int)
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    body = np.frombuffer(b"".join(texts[s:e]), np.uint8)
                    rows.append((int(shard[new[s]]), chunk, e - s, _pack(keys[new[s:e]].astype("<u8"), ids[owner[s:e]].astype("<i8"), count[new[s:e]].astype("<u2"), body)))
                if len(first):
                    rows.append((-1, chunk, len(first), _pack(first.astype("<i8"), region.astype("<i8"), ids[owner[region]].astype("<i8"), count.astype("<u2"))))
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=REGION.fieldNames())

    return run


def repeated_windows(regions: list[bytes], keys: np.ndarray, owners: np.ndarray, match: int, memory: int) -> list[np.ndarray]:
    """For each distinct region, which of its windows also start in a document with a smaller id than its owner.

    Regions whose anchor no other region has hold no window of another and are left out."""
    out = [np.zeros(len(r) - match + 1, bool) for r in regions]
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(counts[place] > 1)
    if not len(chosen):
        return out
    text = np.zeros(sum(len(regions[i]) + 1 for i in chosen), np.uint16)
    sizes = np.array([len(regions[i]) + 1 for i in chosen])
    starts = np.cumsum(sizes) - sizes
    whole = np.ones(len(text), bool)
    whole[starts + sizes - 1] = False
    text[whole] = np.frombuffer(b"".join([regions[i] for i in chosen]), np.uint8).astype(np.uint16) + 1
    at_window = np.zeros(len(text), bool)
    for k in range(int(sizes.max()) - match):
        at_window[starts[sizes - match > k] + k] = True
    region_of = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes)
    owner = owners[chosen]
    hit = np.zeros(len(text), bool)
    pending: list[np.ndarray] = []

    def settle(pos):
        """One run of equal windows, or several after another with their cuts."""
        least = owner[region_of[pos]].min()
        hit[pos] = owner[region_of[pos]] > least

    for pos, lcp in InducedSort(text, match, memory).order():
        keep = at_window[pos]
        # the common prefix of two windows is the least value between them, those of other suffixes included
        cuts = np.flatnonzero(lcp < match)
        group = np.searchsorted(cuts, np.arange(len(pos)), side="right")
        pos, group = pos[keep], group[keep]
        if len(cuts) and pending:
            head = pos[group == 0]
            settle(np.concatenate([*pending, head]))
            pending = []
            pos, group = pos[group > 0], group[group > 0]
        elif not len(cuts):
            pending.append(pos)
            continue
        last = group == len(cuts)
        if len(pos) and last.any():
            pending.append(pos[last])
            pos, group = pos[~last], group[~last]
        if len(pos):
            firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            own = owner[region_of[pos]]
            least = np.minimum.reduceat(own, firsts)
            hit[pos] = own > np.repeat(least, np.diff(np.append(firsts, len(pos))))
    if pending:
        settle(np.concatenate(pending))
    for k, i in enumerate(chosen.tolist()):
        out[i] = hit[starts[k] : starts[k] + len(out[i])]
    return out


def _shard_replies(match: int, memory: int):
    """Per chunk and shard: of each region sent, the windows to remove from its owner, as bits; and whether all are its."""

    def one(shard, rows):
        known: dict[bytes, int] = {}
        texts, keys, owners, refs = [], [], [], []
        for chunk, n, data in rows:
            raw = _unpack(data)
            key, own = np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n)
            count = np.frombuffer(raw, "<u2", n, 16 * n).astype(np.int64)
            stops = np.cumsum(count + match - 1) + 18 * n
            ref = np.empty(n, np.int64)
            start = 18 * n
            for k, (stop, a, b) in enumerate(zip(stops.tolist(), key.tolist(), own.tolist())):
                body = raw[start:stop]
                start = stop
                i = known.setdefault(body, len(known))
                if i == len(texts):
                    texts.append(body)
                    keys.append(a)
                    owners.append(b)
                elif b < owners[i]:
                    owners[i] = b
                ref[k] = i
            refs.append((chunk, ref, own, count))
        owners = np.array(owners, np.int64)
        hits = repeated_windows(texts, np.array(keys, np.uint64), owners, match, memory)
        for chunk, ref, own, count in refs:
            bits = [hits[i] if o == owners[i] else np.ones(len(hits[i]), bool) for i, o in zip(ref.tolist(), own.tolist())]
            flat = np.concatenate(bits)
            yield chunk, shard, _pack(np.array([len(flat)], "<i8"), np.packbits(flat))

    def run(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for shard, chunk, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(shard, []).append((chunk, n, data))
        for shard in list(rows):
            found = list(zip(*one(shard, rows.pop(shard))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "part", "reply"])

    return run


RESULT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _results(match: int):
    def run(batches):
        for batch in batches:
            for _, ids, sizes, text, own, reply in _chunk_rows(batch):
                own = own[0] if own else None
                buffer = np.frombuffer(text, np.uint8)
                gone = np.zeros(len(buffer) + 1, np.int32)
                if own is not None:
                    raw = _unpack(own["data"])
                    n = own["n"]
                    first, region = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
                    owner, count = np.frombuffer(raw, "<i8", n, 16 * n), np.frombuffer(raw, "<u2", n, 24 * n).astype(np.int64)
                    # regions were sent in order of shard, so replies in that order give their bits in order
                    sent = np.zeros(int(region.max()) + 1, np.int64)
                    sent[region] = count
                    parts = [_unpack(r["reply"]) for r in sorted(reply, key=lambda r: r["part"])]
                    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int(np.frombuffer(b, "<i8", 1)[0])) for b in parts])
                    starts = np.cumsum(sent) - sent
                    window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    bit = np.repeat(starts[region] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    document = np.searchsorted(np.cumsum(sizes), first, side="right")
                    hit = bits[bit].astype(bool) | np.repeat(ids[document] > owner, count)
                    np.add.at(gone, window[hit], 1)
                    np.add.at(gone, window[hit] + match, -1)
                gone = np.cumsum(gone[:-1]) > 0
                starts, rows = 0, []
                for size in sizes.tolist():
                    cut = gone[starts : starts + size]
                    spans = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(size > 0 and cut[0])
                    removed = int(np.count_nonzero(cut))
                    whole = text[starts : starts + size]
                    digest = hashlib.sha256(whole)
                    kept = hashlib.sha256(buffer[starts : starts + size][~cut].tobytes()) if removed else digest
                    rows.append((digest.digest(), size, removed, spans, kept.hexdigest()))
                    starts += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=RESULT.fieldNames())

    return run


def _with_replies(chunks: DataFrame, replies: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Chunks with the replies to them (and rows of their own) in lists.

    Replies of a bit per anchor are broadcast if they are few; with rows of their own the chunks are shuffled."""
    grouped = replies.groupBy("chunk").agg(F.collect_list(F.struct("part", "reply")).alias("reply"))
    if more is not None:
        own = more.groupBy("chunk").agg(F.collect_list(F.struct("n", "data")).alias("own"))
        return chunks.join(own.join(grouped, "chunk", "left").select("chunk", "own", "reply").hint("merge"), "chunk", "left")
    size = replies.agg(F.coalesce(F.sum(F.length("reply") + 64), F.lit(0))).first()[0]
    return chunks.join(F.broadcast(grouped) if size <= BROADCAST_BYTES else grouped, "chunk", "left")


@tidy
def suffix_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, memory: int = MEMORY, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Per input row: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``match`` bytes that covers it also starts in a document with a smaller
    id; strings are judged on the input. Of equal texts, the smallest id stands for all: the others
    go whole, if they have ``match`` bytes. Null texts are empty, and empty texts lose nothing. Rows
    repeated with one id do not remove each other; a null id counts as larger than all others, and so
    does the largest 64-bit integer, which comes back as null; ids must be integers. Very long texts are
    chunks of their own. Further columns are ignored; an empty table gives no rows."""
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} is no integer")
    last = (1 << 63) - 1
    source = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    source = source.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = materialize(source.select("id", "digest", F.octet_length("text").cast("long").alias("n")), "suffix-rows")
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = materialize(rows.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "suffix-groups")
    repeats = groups.where("size > 1").select("digest", "rep", "size")
    copies = join_groups(rows, repeats, ["digest"], "size", total, F.col("id")).where("rep < id").select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    copies = materialize(copies, "suffix-copies")
    dropped = F.broadcast(copies) if copies.count() <= 250_000 else copies
    single = source.join(dropped, (source["id"] == copies["_id"]) & (source["digest"] == copies["_digest"]), "left_anti")

    chunks = single.select("id", "text").mapInArrow(give_back(_chunks), CHUNK)
    path_options = {"parquet.block.size": str(8 << 20)}
    chunks = materialize(chunks, "suffix-chunks", path_options)
    buckets, shards = max(1, size // BUCKET_TEXT), max(1, size // SHARD_TEXT)
    sent = chunks.mapInArrow(give_back(_anchor_rows(buckets, match)), "bucket long, chunk long, keys binary, seen binary")
    kind = "chunk long, part long, reply binary"
    found = materialize(sent.repartition(max(1, buckets // 2), "bucket").mapInArrow(give_back(_repeated(hot_anchor)), kind), "suffix-anchors")
    regions = materialize(_with_replies(chunks, found).mapInArrow(give_back(_region_rows(buckets, shards, match)), REGION), "suffix-regions")
    inside = regions.where("shard >= 0")
    replies = materialize(inside.repartition(max(1, shards // SHARDS_PER_TASK), "shard").mapInArrow(give_back(_shard_replies(match, memory)), kind), "suffix-replies")
    result = _with_replies(chunks, replies, regions.where("shard = -1").select("chunk", "n", "data"))
    result = materialize(result.select("chunk", "ids", "sizes", "text", "own", "reply").mapInArrow(give_back(_results(match)), RESULT), "suffix-results")
    per_text = result.dropDuplicates(["digest"]).join(groups, "digest")
    out = join_groups(rows, per_text.select("digest", "rep", "size", "n_removed", "n_spans", "kept_sha256"), ["digest"], "size", total, F.col("id"))
    copy = (F.col("rep") < F.col("id")) & (F.col("n") >= match)
    return out.select(
        F.when(F.col("id") != last, F.col("id")).cast(df.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )

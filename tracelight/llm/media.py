"""Media columns: payloads stored as 8-bit images in archives, read back by byte ranges.

``MediaArchives`` is a Spark data source over a folder of ZIP archives. Writing stores one member
per row, in the archive's own directory and in a member index beside it; reading plans partitions as
byte ranges, takes each range's members from its stretch of the index, and streams them through Arrow."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tracelight.llm._common import new_path, pieces

#: Payloads are rows of so many 8-bit samples.
WIDTH = 64
#: Deflate level of the stored samples, and the ceiling of one image data chunk.
LEVEL = 4
CHUNK_BYTES = 1 << 24
#: A task's byte range, at least; as there are MOST_RANGES at most, larger folders have larger ones. The size at
#: which a writer starts another archive.
RANGE_BYTES = 8 << 20
MOST_RANGES = 100_000
ARCHIVE_BYTES = 256 << 20
#: A batch is sent on when it holds so many bytes.
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(raw: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of WIDTH."""
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_image(raw: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row, of the padded payload; a private chunk holds the unpadded length."""
    payload = payload_of(raw)
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, WIDTH)
    data = zlib.compress(rows.tobytes(), LEVEL)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)), _chunk(b"laSz", struct.pack(">Q", len(raw)))]
    parts += [_chunk(b"IDAT", data[i : i + CHUNK_BYTES]) for i in range(0, len(data), CHUNK_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def decode_image(stored: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of a stored image."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], 0
    while at < len(stored):
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"laSz":
            (size,) = struct.unpack(">Q", body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes(), size


def image_features(payload: bytes) -> str:
    """Shape, mean and deviation of the samples, and their shares over eight equal ranges in thousandths."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    level, n = np.arange(256), len(payload)
    mean = float(counts @ level) / n
    spread = max(0.0, float(counts @ (level * level)) / n - mean * mean) ** 0.5
    shares = counts.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"{WIDTH}x{n // WIDTH} mean={mean:.3f} sd={spread:.3f} hist={'-'.join(map(str, shares.tolist()))}"


#: A row of a member index: offset, size, checksum and bytes of the name, which follows. At the index's end stand, for
#: the first member and one in each INDEX_BYTES, its offset in the archive and its row's in the index, and their number.
_ENTRY, _MARK, _COUNT = struct.Struct("<QQII"), struct.Struct("<QQ"), struct.Struct("<Q")
INDEX_BYTES = 1 << 20


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int

    def __init__(self, archive: str, start: int, stop: int):
        super().__init__(None)
        self.archive, self.start, self.stop = archive, start, stop


@dataclass
class Written(WriterCommitMessage):
    archives: list


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class _Reader(DataSourceReader):
    """Rows (key, media, error) of the archives a committed folder lists."""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        files, root = _filesystem(self.path)
        with files.open_input_stream(f"{root}/manifest.json") as f:
            archives = json.loads(f.read())
        size = max(self.range_bytes, sum(n for _, n in archives) // MOST_RANGES)
        ranges = [ByteRange(a, s, min(s + size, n)) for a, n in archives for s in range(0, n, size)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition):
        if not partition.archive:
            return
        files, root = _filesystem(self.path)
        with files.open_input_file(f"{root}/{partition.archive}.index") as f:
            members = _members(f, partition.start, partition.stop)
        with files.open_input_file(f"{root}/{partition.archive}") as f:
            group, size = [], 0
            for m in members:
                group.append(m)
                size += m.compress_size
                if size >= BATCH_BYTES:
                    yield self.batch(f, group)
                    group, size = [], 0
            if group:
                yield self.batch(f, group)

    def batch(self, f, members):
        """Members that follow each other, by one range read; one that fails its checksum is read again by itself."""
        start = members[0].header_offset
        stop = members[-1].header_offset + 30 + len(members[-1].filename.encode()) + 1024 + members[-1].compress_size
        f.seek(start)
        stretch = f.read(stop - start)
        keys, media, errors = [], [], []
        for m in members:
            body, error = None, None
            try:
                body = _member(stretch, m.header_offset - start, m)
            except ValueError as e:
                error = str(e)
                for _ in range(ATTEMPTS):
                    try:
                        f.seek(m.header_offset)
                        body, error = _member(f.read(30 + 65536 * 2 + m.compress_size), 0, m), None
                        break
                    except (ValueError, OSError) as again:
                        error = str(again)
            keys.append(m.filename)
            media.append(body)
            errors.append(error)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], names=["key", "media", "error"])


def _members(index, start: int, stop: int) -> list[zipfile.ZipInfo]:
    """Members that begin from ``start`` to before ``stop``, by the stretch of the index that lists them."""
    end = index.size() - _COUNT.size
    index.seek(end)
    (count,) = _COUNT.unpack(index.read(_COUNT.size))
    index.seek(end - count * _MARK.size)
    marks = list(_MARK.iter_unpack(index.read(count * _MARK.size)))
    first = max(bisect_right(marks, (start, 1 << 63)) - 1, 0)
    last = bisect_left(marks, (stop, 0))
    at, over = marks[first][1], marks[last][1] if last < count else end - count * _MARK.size
    index.seek(at)
    listed, at, found = index.read(over - at), 0, []
    while at < len(listed):
        offset, size, checksum, n = _ENTRY.unpack_from(listed, at)
        at += _ENTRY.size
        if start <= offset < stop:
            member = zipfile.ZipInfo(listed[at : at + n].decode())
            member.header_offset, member.compress_size, member.file_size, member.CRC = offset, size, size, checksum
            found.append(member)
        at += n
    return found


def _member(stretch: bytes, at: int, member: zipfile.ZipInfo) -> bytes:
    if stretch[at : at + 4] != b"PK\x03\x04":
        raise ValueError(f"{member.filename}: no member at its offset")
    names, extra = struct.unpack_from("<HH", stretch, at + 26)
    at += 30 + names + extra
    body = stretch[at : at + member.compress_size]
    if len(body) != member.file_size or zlib.crc32(body) != member.CRC:
        raise ValueError(f"{member.filename}: checksum")
    return body


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        archives, stream, zipped, name, count, index, marks = [], None, None, "", 0, None, []

        def close():
            zipped.close()
            archives.append((name, stream.tell()))
            stream.close()
            index.write(b"".join([_MARK.pack(*m) for m in marks]) + _COUNT.pack(len(marks)))
            index.close()

        for batch in iterator:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if zipped is None:
                    name, marks = f"{uuid.uuid4().hex}.zip", []
                    stream = files.open_output_stream(f"{root}/{name}", compression=None)
                    index = files.open_output_stream(f"{root}/{name}.index", compression=None)
                    zipped = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{count:09d}-{key}")
                count += 1
                zipped.writestr(member, media)
                if not marks or member.header_offset - marks[-1][0] >= INDEX_BYTES:
                    marks.append((member.header_offset, index.tell()))
                title = member.filename.encode()
                index.write(_ENTRY.pack(member.header_offset, member.compress_size, member.CRC, len(title)) + title)
                if stream.tell() >= ARCHIVE_BYTES:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        return Written(archives)

    def commit(self, messages):
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps([a for m in messages if m is not None for a in m.archives]).encode())

    def abort(self, messages):
        """Archives without a manifest are never read."""


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)`` and ``df.write.format("media_archives")``."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return "key string, media binary, error string"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_media(df: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store each row's text (null: empty) as one image member, named by its id; repeated rows become members of their own."""

    def encode(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                images = [encode_image(t or b"") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], names=["key", "media"])

    df.sparkSession.dataSource.register(MediaArchives)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = df.select(key.alias("key"), F.col(text_col).cast("binary").alias("media"))
    rows.mapInArrow(encode, "key string, media binary").write.format("media_archives").mode("append").save(folder)


def read_media(spark: SparkSession, folder: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``key``, ``media``, ``error``: one per stored member; a member that stays unreadable has a null media and says why."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("range_bytes", range_bytes).load(folder)


DIGEST = T.StructType(
    [T.StructField(n, t) for n, t in (("key", T.StringType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("error", T.StringType()))]
)


def media_digests(media: DataFrame) -> DataFrame:
    """Decode stored media and describe them; members that could not be read have null columns and their error."""

    def describe(batches):
        for batch in batches:
            rows = []
            for key, stored, error in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if stored is None:
                    rows.append((key, None, None, None, None, None, None, None, error))
                    continue
                payload, size = decode_image(stored)
                rows.append((key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), image_features(payload), None))
            columns = list(zip(*rows)) or [()] * len(DIGEST)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=DIGEST.fieldNames())

    return media.select("key", "media", "error").mapInArrow(describe, DIGEST)


def media_round_trip(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image, read the archives back and describe what was read.

    Null texts are empty and stored as one row of zeros; very long texts become taller images;
    repeated rows and null ids come back as often as they went in. Further columns are ignored. A member
    that stays unreadable is a row without id or digests whose ``error`` says why."""
    folder = new_path(df.sparkSession, "media")
    write_media(df, folder, id_col=id_col, text_col=text_col)
    out = media_digests(read_media(df.sparkSession, folder))
    name = F.regexp_extract("key", r"^\d+-(.*)$", 1)
    id_type = df.schema[id_col].dataType
    own = F.when(name == "null", F.lit(None)).otherwise(name).cast(id_type)
    return out.select(own.alias(id_col), *[c for c in DIGEST.fieldNames() if c != "key"])

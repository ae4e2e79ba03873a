"""WARC archives with a two-level capture index.

Records go to gzip-per-record WARC files. Captures are sorted by reversed-host URL key into
compressed blocks; a sparse directory names each block's first key and byte range. A lookup
binary-searches the directory, reads one block, binary-searches it, and reads one record's range."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import join_groups, materialize, new_path
from tracelight.llm.media import _filesystem

BLOCK_LINES = 1024
GZIP_LEVEL = 3
#: A fixed capture date: the tables carry none, and reruns must agree.
CAPTURED = "2020-01-01T00:00:00Z"
#: Blocks a lookup task keeps decompressed, and directory rows it holds at a time.
KEPT_BLOCKS = 8
#: Bytes of records that one lookup task reads, and captures that one index file holds, on average.
TASK_BYTES = 8 << 20
FILE_CAPTURES = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Reversed-host sort key: ``https://m.a.example/x?q`` is ``example,a,m)/x?q``; what is no URL is its own key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url.lower())
    if not host:
        return re.sub(r"\s", "%20", url.lower())
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail.lower())


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompressobj(31).decompress(data)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload and names the response it repeats."""
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if is_revisit else b"response"),
        f"WARC-Record-ID: <urn:page:{page_id}>".encode(),
        f"WARC-Date: {CAPTURED}".encode(),
        b"WARC-Target-URI: " + re.sub(r"[\r\n]+", "", url or "").encode("utf-8", "replace"),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        f"WARC-Payload-Length: {len(payload)}".encode(),
    ]
    if is_revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    body = b"" if is_revisit else payload
    lines += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def _urn(value: str | None):
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    return None if not found or found[1] == "None" else found[1]


def write_warc(df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row and return the captures: ``key``, ``id``, ``file``, ``start``, ``length``.

    Digests are taken where the rows are read; equal payloads are grouped by digest alone, which
    names for each the largest id as the response, so bodies move once, to meet that decision."""

    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(payload_col).cast("binary").alias("_body"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1(F.coalesce(F.col("_body"), F.lit(b"")))))
    digests = materialize(rows.select("_id", "_digest"), "payload-digests")
    total = digests.count()
    groups = digests.groupBy("_digest").agg(F.max("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = materialize(groups, "payload-groups")
    repeats = join_groups(digests, groups, ["_digest"], "_n", total, F.col("_id")).where("_n is not null and _first <> _id")
    repeats = repeats.select("_id", "_digest", "_first").distinct()
    judged = rows.join(repeats, ["_id", "_digest"], "left").select("_id", "_url", "_body", "_first")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", id_type), T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])

    def write(batches):
        files, root = _filesystem(folder)
        stream, name, at = None, "", 0
        for batch in batches:
            keys, starts, lengths = [], [], []
            for page, url, body, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if stream is None:
                    files.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    stream = files.open_output_stream(f"{root}/{name}", compression=None)
                body = body or b""
                packed = _gzip(record(page, url, body, payload_digest(body), first, first is not None))
                stream.write(packed)
                keys.append(f"{url_key(url)} {page}")
                starts.append(at)
                lengths.append(len(packed))
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0), pa.array([name] * len(keys), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=schema.fieldNames())
        if stream is not None:
            stream.close()

    return materialize(judged.mapInArrow(write, schema), "captures")


def build_index(captures: DataFrame, folder: str, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by key into compressed blocks; returns the sparse directory, a row for each block: ``first`` and
    ``last`` key, ``file``, ``start``, ``length``, ``lines``."""
    schema = T.StructType([T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("lines", T.LongType())])

    def pack(batches):
        files, root = _filesystem(folder)
        stream, name, at, lines = None, "", 0, []
        out = []

        def flush():
            nonlocal stream, name, at, lines
            if stream is None:
                files.create_dir(root, recursive=True)
                name = f"cdx-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"
                stream = files.open_output_stream(f"{root}/{name}", compression=None)
            packed = _gzip("\n".join(lines).encode())
            stream.write(packed)
            out.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], name, at, len(packed), len(lines)))
            at += len(packed)
            lines = []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines.append("\t".join(map(str, row)))
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if stream is not None:
            stream.close()
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=schema.fieldNames())

    files = max(1, captures.count() // FILE_CAPTURES)
    ordered = captures.select("key", "file", "start", "length").repartitionByRange(files, F.col("key")).sortWithinPartitions("key")
    return ordered.mapInArrow(pack, schema)


class CaptureIndex:
    """Lookups over the two levels. Of the sparse directory, only the rows around the keys in hand are held."""

    def __init__(self, archives: str, index: str, directory: str):
        import pyarrow.dataset as ds

        self.archives, self.index = _filesystem(archives), _filesystem(index)
        files, root = _filesystem(directory)
        self.rows = ds.dataset(root, filesystem=files, format="parquet")
        self.directory: list[tuple[str, str, int, int]] = []
        self.firsts: list[str] = []
        self.blocks: OrderedDict[tuple[str, int], tuple[list[str], list[str]]] = OrderedDict()
        self.open: dict[str, object] = {}

    def around(self, low: str, high: str) -> None:
        """Hold the directory's rows of blocks that can have keys from ``low`` to ``high``; the files' statistics skip the others."""
        import pyarrow.dataset as ds

        table = self.rows.to_table(columns=["first", "file", "start", "length"], filter=(ds.field("first") <= high) & (ds.field("last") >= low))
        self.directory = sorted(zip(*(table.column(i).to_pylist() for i in range(4))))
        self.firsts = [d[0] for d in self.directory]

    def _range(self, where, name: str, start: int, length: int) -> bytes:
        files, root = where
        f = self.open.get(name)
        if f is None:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            f = self.open[name] = files.open_input_file(f"{root}/{name}")
        f.seek(start)
        return f.read(length)

    def _block(self, at: int) -> tuple[list[str], list[str]]:
        _, name, start, length = self.directory[at]
        if (name, start) in self.blocks:
            self.blocks.move_to_end((name, start))
            return self.blocks[name, start]
        lines = _gunzip(self._range(self.index, name, start, length)).decode().split("\n")
        found = self.blocks[name, start] = ([line.split("\t", 1)[0] for line in lines], lines)
        if len(self.blocks) > KEPT_BLOCKS:
            self.blocks.popitem(last=False)
        return found

    def find(self, key: str, above: str | None = None) -> Iterator[tuple[str, int, int]]:
        """(file, start, length) of the captures with exactly this key, or with keys from it to below ``above``."""
        at = max(bisect_left(self.firsts, key) - 1, 0)
        while at < len(self.directory) and (self.firsts[at] <= key if above is None else self.firsts[at] < above):
            keys, lines = self._block(at)
            for line in lines[bisect_left(keys, key) : bisect_right(keys, key) if above is None else bisect_left(keys, above)]:
                _, name, start, length = line.rsplit("\t", 3)
                yield name, int(start), int(length)
            at += 1

    def read(self, name: str, start: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse_record(_gunzip(self._range(self.archives, name, start, length)))


_READ = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("url", T.StringType())])


def _read_captures(keys: DataFrame, archives: str, index: str, directory: str, tasks: int, id_type: T.DataType, whole_urls: bool) -> DataFrame:
    def read(batches):
        found = None
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            if not wanted:
                continue
            found = found or CaptureIndex(archives, index, directory)
            # page ids follow a URL's key after a space, so its captures end before the next character
            spans = [(f"{k} ", f"{k}!") if whole_urls else (k, None) for k in wanted]
            found.around(spans[0][0], spans[-1][1] or spans[-1][0])
            for start in range(0, len(wanted), 64):
                rows = []
                for name, (low, above) in zip(wanted[start : start + 64], spans[start : start + 64]):
                    for capture in found.find(low, above):
                        headers, body = found.read(*capture)
                        size, digest = int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and (len(body) != size or payload_digest(body) != digest):
                            raise ValueError(f"{headers['warc-record-id']}: the payload read back differs from its digest")
                        rows.append((name, _urn(headers["warc-record-id"]), size, digest, headers["warc-type"], _urn(headers.get("warc-refers-to")), headers["warc-target-uri"]))
                columns = list(zip(*rows)) or [()] * len(_READ)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 2 else pa.string()) for i, c in enumerate(columns)], names=_READ.fieldNames())

    ordered = keys.select("key").repartitionByRange(max(1, tasks), F.col("key")).sortWithinPartitions("key")
    out = ordered.mapInArrow(read, _READ)
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def lookup(keys: DataFrame, archives: str, index: str, directory: str, id_type: T.DataType, *, tasks: int = 1) -> DataFrame:
    """Read the captures of each distinct capture ``key`` back: one row per capture.

    Keys are sorted in ``tasks`` ranges, so a task reads neighbouring blocks once each, and of the
    directory (a row per block of a thousand captures) the part around its keys, a batch of keys at a time."""
    return _read_captures(keys, archives, index, directory, tasks, id_type, False).drop("key")


def lookup_urls(urls: DataFrame, archives: str, index: str, directory: str, id_type: T.DataType, *, url_col: str = "url", tasks: int = 1) -> DataFrame:
    """All captures of each distinct URL, whatever their page: ``key`` (the URL's) and the columns of ``lookup``."""
    kind = T.StructType([T.StructField("key", T.StringType())])

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return _read_captures(urls.select(url_col).mapInArrow(keyed, kind).distinct(), archives, index, directory, tasks, id_type, True)


def warc_round_trip(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives and index for all rows, then read every capture back through the index.

    Of records with equal payloads, the one with the largest id is a response and the others revisit
    it. Null payloads are empty, null URLs have the empty key. Rows repeated with the same id and
    payload are responses each, and both come back; rows with a null id are responses with a null
    ``id_col``. Further columns are ignored; an empty table gives no rows."""
    spark = df.sparkSession
    archives, index, directory = (new_path(spark, t) for t in ("warc", "cdx", "cdx-directory"))
    id_type = df.schema[id_col].dataType
    captures = write_warc(df, archives, id_col=id_col, url_col=url_col, payload_col=payload_col)
    build_index(captures, index).write.parquet(directory)
    tasks = -(-captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // TASK_BYTES)
    out = lookup(captures.select("key").distinct(), archives, index, directory, id_type, tasks=tasks)
    return out.withColumnRenamed("id", id_col)

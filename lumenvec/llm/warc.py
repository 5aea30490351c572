"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with the records of about frame_bytes, then a skippable frame that maps
record identifiers to (frame, offset in it, length), then the seek table of the Zstandard seekable format. So one record
is read with the footer and one frame, and the frames of a bundle can be read by different tasks. Frames and places are below 4 GiB, as the
format has it: a record is one value of a table, so under 2 GiB.

Pages with equal payloads are stored once: the one with the smallest id is a response, the others revisit it. A task drops the payloads of
rows that one of its own with a smaller id makes revisits, before anything is shuffled: of a hot payload each task passes on a few. The rows then meet their
digest's smallest id in a join with salted keys, and each task writes its own bundles to the shared folder under names of their own. The manifest, a table in
that folder, lists records of committed tasks only, so files that a lost attempt left are never read. Reading deals the frames out by the
bytes they hold.

Defined cases: a null payload counts as empty; a very long one is one record in a frame of its own; rows with equal ids have records with identifiers of their own, as
these come from the id and the row's place in the table (what a shuffle deals out is written first, so that places stay); of rows with equal id and payload all are responses
if theirs is the smallest id; a null id never is the smallest, and where all are null all are responses; urls are escaped in the target header and kept whole in
another; an empty table gives an empty manifest and no file; columns other than the three are not read, so their names may be any.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_struct, folder, spark_struct, stable, written

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
MANIFEST = {"page_id": "bigint", "record_id": "string", "bundle": "string", "frame": "int", "offset": "bigint", "length": "bigint"}
RECORD = {"page_id": "bigint", "record_id": "string", "url": "string", "record_type": "string", "refers_to": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "payload": "binary"}
SALTS = 16  # over which the rows of one digest are spread in the join
CHUNK_FRAMES = 16  # neighbouring frames that one task reads
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(map(chr, range(33, 127)))


def record_id(page_id: int | None, row: int) -> str:
    """Of a row of the table."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: tuple[int, str] | None = None) -> bytes:
    """A response, or where payload is None a revisit of refers_to, a page and its record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = {"WARC-Type": "response" if payload is not None else "revisit", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}"}
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if url is not None:
        head["WARC-Target-URI"] = safe = urllib.parse.quote(url, safe=_SAFE, errors="replace")
        if safe != url:
            head["X-Target-URI-JSON"] = json.dumps(url)
    if payload is None:
        head |= {"WARC-Profile": _PROFILE}
        if refers_to is not None:
            head |= {"WARC-Refers-To": refers_to[1], "X-Refers-To-Page": str(refers_to[0])}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The record at a place, as the values of RECORD, and where it ends."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = body + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} doesn't end where it says")
    kind = head["WARC-Type"]
    url = json.loads(head["X-Target-URI-JSON"]) if "X-Target-URI-JSON" in head else head.get("WARC-Target-URI")
    content = data.index(b"\r\n\r\n", body, end) + 4
    page, refers = (int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page"))
    if kind == "revisit":
        http = dict(x.split(": ", 1) for x in data[body : content - 4].decode().split("\r\n")[1:])
        return (page, head["WARC-Record-ID"], url, kind, refers, int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), None), end + 4
    payload = data[content:end]
    return (page, head["WARC-Record-ID"], url, kind, None, len(payload), base32_sha1(payload), payload), end + 4


class Bundle:
    """Writes one file."""

    def __init__(self, store: fs.FileSystem, path: str, frame_bytes: int, level: int = 3) -> None:
        self.path, self.out, self.frame_bytes = path, store.open_output_stream(path, compression=None), frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pending, self.pending_bytes, self.frames, self.index, self.bytes = [], 0, [], [], 0

    def add(self, name: str, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in it, and length."""
        place = (len(self.frames), self.pending_bytes, len(data))
        self.pending.append(data)
        self.pending_bytes += len(data)
        self.bytes += len(data)
        self.index.append((name, place))
        if self.pending_bytes >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.pending:
            frame = self.compressor.compress(b"".join(self.pending))
            self.out.write(frame)
            self.frames.append((len(frame), self.pending_bytes))
            self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<IIIH", *place, len(name.encode())) + name.encode() for name, place in self.index)
        table = b"".join(struct.pack("<II", *x) for x in self.frames + [(len(index) + 8, 0)]) + struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class Reader:
    """Reads frames, and records by identifier, of one file."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = list(struct.iter_unpack("<II", self.at(size - 9 - 8 * n, 8 * n)))
        starts = [0]
        for length, _ in table:
            starts.append(starts[-1] + length)
        self.frames = [(a, *x) for a, x in zip(starts, table, strict=False)]
        self.index_at = self.frames.pop()

    def at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, n: int) -> bytes:
        start, length, size = self.frames[n]
        return zstandard.ZstdDecompressor().decompress(self.at(start, length), max_output_size=size)

    def index(self) -> dict[str, tuple[int, int, int]]:
        start, length, _ = self.index_at
        data, at, out = self.at(start, length), 8, {}
        while at < len(data):
            *place, n = struct.unpack_from("<IIIH", data, at)
            out[data[at + 14 : at + 14 + n].decode()] = tuple(place)
            at += 14 + n
        return out

    def record(self, name: str) -> tuple:
        frame, offset, _ = self.index()[name]
        return parse(self.frame(frame), offset)[0]


_SIFTED = {"page_id": "bigint", "row": "bigint", "url": "string", "payload": "binary", "sha1": "string", "size": "bigint"}


def _sift(least: int):
    """For mapInArrow over (page_id, row, url, payload): adds digest and size, and drops payloads of rows after one with the same payload and a smaller id. A task keeps an id for each digest."""
    kind = pa.schema(list(arrow_struct(_SIFTED)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[bytes, int] = {}
        for b in batches:
            payloads, digests, sizes = [], [], []
            for page, payload in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                data = payload.as_py()
                digest = hashlib.sha1(data)
                digests.append(digest.hexdigest())
                sizes.append(len(data))
                known = smallest.get(digest.digest())
                again = known is not None and len(data) >= least and (page is None or page > known)
                if page is not None and (known is None or page < known):
                    smallest[digest.digest()] = page
                payloads.append(None if again else data)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], schema=kind)

    return task


def stored(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, row, url, payload (null for revisits), sha1 (hexadecimal), size, refers_to, refers_row."""
    data = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    rows = stable(pages.select(id_col, url_col, payload_col)).select(F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.col(url_col).alias("url"), data.alias("payload"))
    light = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "row", F.sha1("payload").alias("sha1"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first")
    groups = light.groupBy("sha1").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null")
    spread = groups.select("sha1", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sifted = rows.mapInArrow(_sift(min_revisit_bytes), spark_struct(_SIFTED)).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    joined = sifted.join(spread, ["sha1", "salt"], "left")
    return joined.select("page_id", "row", "url", F.when(~again, F.col("payload")).alias("payload"), "sha1", "size", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.row")).alias("refers_row"))


def write(pages: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, root: str | None = None, **options) -> DataFrame:
    """Write all pages as records, to root or a folder of the application; the manifest."""
    root = root or f"{folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    kind = pa.schema(list(arrow_struct(MANIFEST)))

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(root)
        store.create_dir(where)
        bundle, rows = None, []

        def done() -> pa.RecordBatch:
            bundle.close()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        for batch in batches:
            for values in zip(*(c for c in batch.columns), strict=True):
                page, row, url, payload, sha1, size, refers_to, refers_row = (x.as_py() for x in values)
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store, f"{where}/{name}", frame_bytes)
                    info = b"software: lumenvec\r\nformat: WARC File Format 1.1\r\n"
                    about = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'bundle:{name}')}>"
                    bundle.add("warcinfo", f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {about}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    bundle.flush()  # a frame of its own
                own = record_id(page, row)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                rows.append((page, own, f"{root}/{name}", *bundle.add(own, record(own, page, url, payload, digest, size, refers_to is not None and (refers_to, record_id(refers_to, refers_row)) or None))))
                if bundle.bytes >= bundle_bytes:
                    yield done()
                    bundle, rows = None, []
        if bundle:
            yield done()

    return written(stored(pages, **options).mapInArrow(bundles, spark_struct(MANIFEST)), "manifest")


def _dealt(rows: DataFrame, task_bytes: int) -> DataFrame:
    """Rows (bundle, frame, bytes, ...) in as many partitions as their bytes ask for, neighbouring frames together and in order."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    return rows.repartition(max(1, -(-total // task_bytes)), "bundle", F.floor(F.col("frame") / CHUNK_FRAMES)).sortWithinPartitions("bundle", "frame")


class _Frames:
    """Frames by path and number; the last file and frame stay at hand."""

    def __init__(self) -> None:
        self.path, self.reader, self.n, self.data = None, None, -1, b""

    def get(self, path: str, n: int) -> bytes:
        if path != self.path:
            self.path, self.reader, self.n = path, Reader(*fs.FileSystem.from_uri(path)), -1
        if n != self.n:
            self.n, self.data = n, self.reader.frame(n)
        return self.data


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def read(manifest: DataFrame, payloads: bool = True, task_bytes: int = 1 << 25) -> DataFrame:
    """All records of the manifest's frames, parsed again; lengths and digests are taken anew from the payloads."""
    fields = {k: v for k, v in RECORD.items() if payloads or k != "payload"}
    kind = pa.schema(list(arrow_struct(fields)))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _Frames()
        for batch in batches:
            for path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at, rows = frames.get(path, n), 0, []
                while at < len(data):
                    row, at = parse(data, at)
                    rows.append(row[: len(fields)])
                yield _batch(rows, kind)

    frames = manifest.groupBy("bundle", "frame").agg(F.sum("length").alias("bytes"))
    return _dealt(frames, task_bytes).select("bundle", "frame").mapInArrow(records, spark_struct(fields))


def fetch(manifest: DataFrame, record_ids: DataFrame, task_bytes: int = 1 << 25) -> DataFrame:
    """The records whose identifiers are in record_ids (record_id), each by its frame and offset."""
    kind = pa.schema(list(arrow_struct(RECORD)))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _Frames()
        for batch in batches:
            rows, size = [], 0
            for path, n, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(parse(frames.get(path, n), offset)[0])
                size += len(rows[-1][-1] or b"")
                if size > task_bytes:
                    yield _batch(rows, kind)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kind)

    found = written(manifest.join(record_ids.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame", "offset", F.col("length").alias("bytes")), "wanted")
    return _dealt(found, task_bytes).select("bundle", "frame", "offset").mapInArrow(records, spark_struct(RECORD))

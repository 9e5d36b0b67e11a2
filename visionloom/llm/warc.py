"""WARC records in ZIP archives: members stored, found through central and ZIP64 directories, records range-read.

An archive holds `archive/data.warc.gz` (a gzip member per record) and `indexes/index.cdx` (a line per record), both
stored, so a record is read by its place in the archive alone. Archives lie in the shared folder through pyarrow's file
systems, as on a cluster.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_dir, utf8

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
U32, U16 = 0xFFFFFFFF, 0xFFFF


def warc_record(kind: str, page_id: object, url: str | None, payload: bytes, length: int, digest: str, refers_to: object = None) -> bytes:
    """A record; a revisit carries its payload's digest and length, not its bytes."""
    body = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}"]
    head += ["WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut off")
    return headers, rest[:n]


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class ZipWriter:
    """Streams stored members to a sink that can't seek: sizes follow each member (bit 3) and stand in the directory.
    Wide fields are used where a size or place needs them, or where `zip64` asks."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.at, self.entries, self.zip64, self.open = sink, 0, [], zip64, None

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        self.open = [name.encode(), self.at, 0, 0]
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 8, 0, 0, 33, 0, U32, U32, len(self.open[0]), 20) + self.open[0] + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, raw: bytes) -> int:
        """Place of the bytes in the archive."""
        at = self.at
        self._put(raw)
        self.open[2] += len(raw)
        self.open[3] = zlib.crc32(raw, self.open[3])
        return at

    def end(self) -> None:
        _, _, n, crc = self.open
        self._put(struct.pack("<4sIQQ", b"PK\7\10", crc, n, n))
        self.entries.append(tuple(self.open))

    def close(self) -> None:
        start = self.at
        for name, at, n, crc in self.entries:
            wide = self.zip64 or n >= U32 or at >= U32
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
            small = (U32, U32, U32) if wide else (n, n, at)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 8, 0, 0, 33, crc, small[0], small[1], len(name), len(extra), 0, 0, 0, 0, small[2]) + name + extra)
        size, count = self.at - start, len(self.entries)
        wide = self.zip64 or start >= U32 or size >= U32 or count >= U16
        if wide:
            end64 = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end64, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, U16 if wide else count, U16 if wide else count, U32 if wide else size, U32 if wide else start, 0))


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError("the archive is cut off")
    return raw


def zip_directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """{member: (place of its bytes, length, method)} from the end record, the ZIP64 end record and the directory."""
    tail_at = max(0, size - 65_557)
    tail = read_at(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("not a ZIP archive")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if U32 in (length, start) or count == U16:
        sign, _, end64, _ = struct.unpack("<4sIQI", read_at(f, tail_at + end - 20, 20))
        if sign != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        count, length, start = struct.unpack("<QQQ", read_at(f, end64 + 32, 24))
    raw, at, out = read_at(f, start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack("<H", raw[at + 10 : at + 12])
        packed, plain, names, extras, notes = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        place, = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + names].decode()
        extra, k = raw[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                plain = next(wide) if plain == U32 else plain
                packed = next(wide) if packed == U32 else packed
                place = next(wide) if place == U32 else place
            k += 4 + n
        local = read_at(f, place, 30)
        n, e = struct.unpack("<HH", local[26:30])
        out[name] = (place + 30 + n + e, packed, method)
        at += 46 + names + extras + notes
    return out


def archive_records(f, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record that the index names, range-read one at a time."""
    members = zip_directory(f, size)
    (data, length, how), (index, n, how2) = members[DATA], members[INDEX]
    if how or how2:
        raise ValueError("the members are not stored")
    at = 0
    rest = b""
    while at < n or rest:
        lines = (rest + (read_at(f, index + at, min(1 << 20, n - at)) if at < n else b"")).split(b"\n")
        at += 1 << 20
        rest = lines.pop() if at < n else b""
        for line in filter(None, lines):
            place, took = map(int, line.split(b" ")[-2:])
            if place + took > length:
                raise ValueError("the index points outside its member")
            yield parse_record(zlib.decompress(read_at(f, data + place, took), 31))


def write_archives(pages: DataFrame, folder: str, most_bytes: int = 32 << 20) -> DataFrame:
    """Archive rows (path, size, records) of pages(page_id, url, html, digest, size, refers_to).

    Each task streams its rows into archives of about most_bytes; a retried task writes new names, and only the rows of
    finished tasks name archives. The caller must materialise the result before it reads archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = None

        def close():
            z.end()
            z.begin(INDEX)
            z.write(index.getvalue())
            z.end()
            z.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "size": [z.at], "records": [count]}, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

        for b in batches:
            for page, url, html, digest, size, refers in zip(*(b.column(i).to_pylist() for i in range(6))):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(path)
                    z, index, count = ZipWriter(out), io.BytesIO(), 0
                    z.begin(DATA)
                    data = z.at
                raw = gzip_member(warc_record("response" if refers is None else "revisit", page, url, utf8(html) if refers is None else b"", size, digest, refers))
                index.write(f"{page} {digest} {z.write(raw) - data} {len(raw)}\n".encode())
                count += 1
                if z.at >= most_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = pages.select("page_id", "url", "html", "digest", "size", "refers_to")
    return rows.mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("records", T.LongType())]))


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A RECORD row per WARC record. A response's payload is checked against its digest; a damaged archive fails the job."""

    def number(urn: str | None) -> int | None:
        tail = urn.rpartition(":")[2].rstrip(">") if urn else "None"
        return None if tail == "None" else int(tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with store.open_input_file(path) as f:
                    for head, body in archive_records(f, size):
                        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                        if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(head["x-payload-length"])):
                            raise ValueError(f"{path}: the payload doesn't match its digest")
                        rows.append((number(head["warc-record-id"]), int(head["x-payload-length"]), digest, kind, number(head.get("warc-refers-to"))))
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r)) for r in rows], schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r)) for r in rows], schema=schema)

    return archives.select("path", "size").mapInArrow(run, RECORD)


def deduplicated_archives(pages: DataFrame, least_bytes: int = 1000, most_bytes: int = 32 << 20) -> DataFrame:
    """Pages written as WARC records in ZIP archives and read back: a RECORD row per page.

    Of equal payloads of least_bytes or more, that with the largest page_id is the response and the others revisit it;
    others are responses. Null html is empty, a null page_id never is a response of a group that has ids; rows that
    repeat the largest id are all responses. The full payload is hashed natively; only digests are grouped, and the
    revisits found join back on the id, broadcast by Spark only if their written size allows.
    """
    spark = pages.sparkSession
    data = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(data).alias("digest"), F.octet_length(data).cast("bigint").alias("size"))
    keyed = rows.where(F.col("size") >= least_bytes).select("digest", "page_id")
    groups = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.where("n > 1 and refers_to is not null").select("digest", "refers_to"), "groups")
    revisits = keyed.join(groups, "digest").where("not (page_id <=> refers_to)").distinct()
    revisits = materialise(revisits.select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "refers_to"), "revisits")
    decided = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("digest") == F.col("__d")), "left").drop("__p", "__d")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = materialise(write_archives(decided, folder, most_bytes), "archives")
    n = max(1, spark.sparkContext.defaultParallelism, archives.count())
    return read_archives(archives.repartition(n), folder)

"""Image files: size, kind and orientation from their headers; decoding, content hashes and perceptual hashes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visionloom.sources.formats import IMAGE_SUFFIXES
from visionloom.sources.listing import as_listed, list_files, store_of

HEAD = 1 << 16  # bytes read for a header; a JPEG whose frame lies beyond is read whole


def _jpeg(b: bytes) -> tuple | None:
    at, turned = 2, None
    while at + 9 < len(b) and b[at] == 0xFF:
        mark, size = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if mark == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            turned = _orientation(b[at + 10 : at + 2 + size])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", b, at + 5)
            return "jpeg", w, h, turned
        at += 2 + size
    return None


def _orientation(tiff: bytes) -> int | None:
    try:
        e = "<" if tiff[:2] == b"II" else ">"
        at = struct.unpack_from(e + "I", tiff, 4)[0]
        for i in range(struct.unpack_from(e + "H", tiff, at)[0]):
            tag, _, _, value = struct.unpack_from(e + "HHIH", tiff, at + 2 + 12 * i)
            if tag == 0x0112:
                return value
    except struct.error:
        pass
    return None


def _tiff(read: Callable[[int, int], bytes]) -> tuple | None:
    """Of the first directory, wherever read(at, n) finds it; the sizes and counts of BigTIFF are wider."""
    b = read(0, 16)
    e = "<" if b[:2] == b"II" else ">"
    big = struct.unpack_from(e + "H", b, 2)[0] == 43
    at = struct.unpack_from(e + ("Q" if big else "I"), b, 8 if big else 4)[0]
    counter, size, value = ("Q", 20, 12) if big else ("H", 12, 8)
    start = struct.calcsize(counter)
    n = struct.unpack(e + counter, read(at, start))[0]
    raw, found = read(at + start, n * size), {}
    for i in range(len(raw) // size):
        tag, kind = struct.unpack_from(e + "HH", raw, i * size)
        if tag in (256, 257, 274) and kind in (1, 3, 4, 16):
            found[tag] = struct.unpack_from(e + {1: "B", 3: "H", 4: "I", 16: "Q"}[kind], raw, i * size + value)[0]
    return ("tiff", found[256], found[257], found.get(274)) if 256 in found and 257 in found else None


def _is_tiff(b: bytes) -> bool:
    return b[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")


def header(b: bytes) -> tuple | None:
    """(kind, width, height, orientation) of the first bytes of a file, null where they are no known image."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack_from(">II", b, 16), None
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
        if b[:4] == b"GIF8":
            return "gif", *struct.unpack_from("<HH", b, 6), None
        if _is_tiff(b):
            return _tiff(lambda at, n: b[at : at + n])
        if b[:2] == b"BM":
            w, h = struct.unpack_from("<ii", b, 18)
            return "bmp", w, abs(h), None
        if b[:4] == b"RIFF" and b[8:16] == b"WEBPVP8X":
            return "webp", int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, None
        if b[:4] == b"RIFF" and b[8:16] == b"WEBPVP8 ":
            w, h = struct.unpack_from("<HH", b, 26)
            return "webp", w & 0x3FFF, h & 0x3FFF, None
        if b[:4] == b"RIFF" and b[8:16] == b"WEBPVP8L":
            bits = struct.unpack_from("<I", b, 21)[0]
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, None
    except struct.error:
        pass
    return None


def probe(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, kind, width, height, orientation) per file of the column path; sizes are null where the header is unknown or
    the file can't be read. Tasks read the first 64 KB of each file only, and the directory of a TIFF."""

    def read(uri: str) -> tuple | None:
        from pyarrow import fs

        uri = uri.replace("file:/", "/", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
        try:
            held, at = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
            with held.open_input_file(at) as f:
                b = f.read(HEAD)
                if _is_tiff(b):
                    return _tiff(lambda at, n: f.read_at(min(n, max(0, f.size() - at)), at))
                return header(b) or (header(b + f.read()) if b[:2] == b"\xff\xd8" else None)
        except (OSError, pa.ArrowInvalid, struct.error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(u) or (None,) * 4 for u in b.column(0).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.string() if i == 0 else pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["path", "kind", "width", "height", "orientation"])

    return files.select(F.col(path).alias("path")).mapInArrow(run, "path string, kind string, width int, height int, orientation int")


def turned(probed: DataFrame) -> DataFrame:
    """Files whose orientation is set and is not upright."""
    return probed.where(F.col("orientation").isNotNull() & ~F.col("orientation").isin(0, 1))


def decoded(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, width, height, channels, data): pixels by rows, blue first; sizes are -1 where a file can't be decoded, and -2
    where it is a sound WebP of a kind that isn't decoded here (lossy or animated)."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    rest = raw.select(as_listed("image.origin"), "image.width", "image.height", "image.nChannels", "image.data").toDF("path", "width", "height", "channels", "data")
    webp = F.lower("path").endswith(".webp")
    return rest.where(~webp).unionByName(decoded_webp(rest.where(webp).select("path")))


def decoded_webp(files: DataFrame) -> DataFrame:
    """The same of the WebP files of the column path, read and decoded in tasks; lossless ones have four channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from visionloom.sources import webp

        for b in batches:
            for uri in b.column(0).to_pylist():
                try:
                    held, at, _ = store_of(uri if ":" in uri else "file:" + uri)
                    with held.open_input_file(at) as f:
                        kind, px = webp.decode(f.read())
                except OSError:
                    kind, px = "broken", None
                size = -1 if kind == "broken" else -2
                row = (px.shape[1], px.shape[0], 4, px[..., [2, 1, 0, 3]].tobytes()) if px is not None else (size, size, size, b"")
                yield pa.RecordBatch.from_arrays([pa.array([uri]), *[pa.array([v], pa.int32()) for v in row[:3]], pa.array([row[3]], pa.binary())], names=["path", "width", "height", "channels", "data"])

    return files.select("path").mapInArrow(run, "path string, width int, height int, channels int, data binary")


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """(path) of image files that are empty or can't be decoded. A sound lossy WebP is readable, though not decoded here."""
    empty = list_files(spark, root).where("size = 0").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(IMAGE_SUFFIXES))
    return decoded(spark, root).where("width = -1").select("path").unionByName(empty.select("path")).distinct()


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha1, sha256) of every file below root, computed in the JVM."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select("path", F.col("length").alias("size"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def _resample(n: int, to: int) -> np.ndarray:
    """Weights (to, n) of a windowed-sinc reduction with three lobes."""
    scale = max(1.0, n / to)
    centre = (np.arange(to)[:, None] + 0.5) * n / to
    x = (np.arange(n)[None, :] + 0.5 - centre) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def perceptual(gray: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """Unsigned fingerprint: low frequencies of the cosine transform of a small picture against their median, the first left
    out of it; the first frequency is the highest bit."""
    n = size * factor
    small = np.clip(np.rint(_resample(gray.shape[0], n) @ gray @ _resample(gray.shape[1], n).T), 0, 255)
    k = np.arange(n)
    basis = np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))[:, None]
    low = (basis @ small @ basis.T)[:size, :size].ravel()
    return int("".join("1" if v > np.median(low[1:]) else "0" for v in low), 2)


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """(path, fp) of decoded images, fp a signed bigint for clean.near_duplicate_pairs; undecodable ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, c, data in zip(*[b.column(i).to_pylist() for i in range(1, 5)]):
                px = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
                gray = px[..., 0] if c == 1 else np.rint(px[..., :3] @ [0.114, 0.587, 0.299])
                v = perceptual(gray)
                out.append(v - (v >> 63 << 64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["path", "fp"])

    return images.where("width > 0 and height > 0").select("path", "width", "height", "channels", "data").mapInArrow(run, "path string, fp long")

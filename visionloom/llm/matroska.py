"""Matroska media columns: payloads stored as 8-bit PCM in EBML, parsed back into packet tables.

Element ids and the variable-length integer coding are those of RFC 8794 (EBML) and RFC 9559 (Matroska).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, utf8

# Fixed values of the format: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}

FRAME, RATE = 576, 8000  # bytes of a frame; samples a second (so a frame lasts 72 ms)
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 16
FRAME_MS = FRAME * 1000 // RATE

PACKET = T.StructType(
    [
        T.StructField("track", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("lace", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("keyframe", T.BooleanType()),
        T.StructField("cluster_offset", T.LongType()),
        T.StructField("cued", T.BooleanType()),
    ]
)


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _element(x: int, body: bytes) -> bytes:
    n = len(body)
    width = next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return _id(x) + ((1 << (7 * width)) | n).to_bytes(width, "big") + body


def _uint(x: int, n: int) -> bytes:
    return _element(x, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track: a fixed-size laced SimpleBlock per 8 frames, a cue per cluster."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    audio = _element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, audio)
    head = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000)) + _element(TRACKS, _element(TRACK_ENTRY, track))
    parts, at, cues = [head], len(head), []
    block, cluster = FRAME * FRAMES_PER_BLOCK, FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for c in range(0, len(payload), cluster):
        ms = c // FRAME * FRAME_MS
        body = [_uint(TIMESTAMP, ms)]
        for b in range(c, min(c + cluster, len(payload)), block):
            data = payload[b : b + block]
            frames, rel = len(data) // FRAME, b // FRAME * FRAME_MS - ms
            lacing = bytes([0x80 | (0x04 if frames > 1 else 0)]) + (bytes([frames - 1]) if frames > 1 else b"")
            body.append(_element(SIMPLE_BLOCK, b"\x81" + rel.to_bytes(2, "big", signed=True) + lacing + data))
        whole = _element(CLUSTER, b"".join(body))
        position = _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, ms) + position))
        parts.append(whole)
        at += len(whole)
    parts.append(_element(CUES, b"".join(cues)))
    return _element(EBML, _element(DOC_TYPE, b"matroska")) + _element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value of the variable-length integer at a place (None: unknown size) and the place after it."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("bad variable-length integer")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << (7 * width)) - 1
    return (None if value == (1 << (7 * width)) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body), masters before what they hold; unknown sizes run to `end`."""
    while at < end:
        start = at
        x, at = read_vint(data, at, keep_marker=True)
        n, at = read_vint(data, at)
        stop = end if n is None else at + n
        if stop > end:
            raise ValueError("an element runs over its parent")
        yield x, start, at, stop
        if x in MASTERS and n is None and x != SEGMENT:
            continue  # what follows is flat; a cluster of unknown size ends where a sibling begins
        if x in MASTERS:
            yield from elements(data, at, stop, depth + 1)
        at = stop


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins: no lacing, Xiph (1), fixed-size (2) or EBML (3)."""
    if not lacing:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed-size lacing doesn't divide")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            first = at
            n, at = read_vint(data, at)
            if n is None:
                n = (1 << (7 * (at - first))) - 1
            if i:
                n = sizes[-1] + n - ((1 << (7 * (at - first) - 1)) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing runs over its block")
    return sizes, at


def demux(data: bytes) -> list[tuple]:
    """Packets of a file as PACKET tuples, in file order."""
    packets: list[list] = []
    cued: set[int] = set()
    scale, base, cluster, segment = 1_000_000, 0, -1, 0
    for x, start, body, end in elements(data, 0, len(data)):
        if x == SEGMENT:
            segment = body
        elif x == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[body:end], "big")
        elif x == CLUSTER:
            cluster = start - segment
        elif x == TIMESTAMP:
            base = int.from_bytes(data[body:end], "big")
        elif x == CUE_CLUSTER_POSITION:
            cued.add(int.from_bytes(data[body:end], "big"))
        elif x in (SIMPLE_BLOCK, BLOCK):
            track, at = read_vint(data, body)
            rel, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
            sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
            ms = (base + rel) * scale // 1_000_000
            for lace, n in enumerate(sizes):
                packets.append([track, ms, lace, at, n, bool(flags & 0x80) or x == BLOCK, cluster])
                at += n
    return [(*p, p[6] in cued) for p in packets]


def packet_bytes(data: bytes, packets: list[tuple]) -> bytes:
    return b"".join([data[p[3] : p[3] + p[4]] for p in packets])


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text with bytes 255 up to a positive multiple of a frame, and its length before."""
    raw = utf8(text)
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)


def encode_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `media`, the Matroska file of each whole text (null: empty), and `n_bytes`. No shuffle."""

    def fn(texts: list) -> dict:
        both = [padded(t) for t in texts]
        return {"media": [mux(p) for p, _ in both], "n_bytes": [n for _, n in both]}

    return append_columns(docs, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())], fn, [text])


def packet_table(media: DataFrame, key: str, content: str = "media") -> DataFrame:
    """One row per packet: (key, packet number, the PACKET fields, error). Damaged files give one row with `error`.

    Null content has no rows. Repeated keys keep their rows apart only by content. No shuffle.
    """

    def fn(files: list) -> dict:
        packets, errors = [], []
        for data in files:
            try:
                found, error = demux(data) if data is not None else None, None
            except (ValueError, IndexError) as e:
                found, error = [], f"damaged: {e}"
            packets.append([dict(zip(PACKET.names, p)) for p in found] if found is not None else None)
            errors.append(error)
        return {"packets": packets, "error": errors}

    fields = [T.StructField("packets", T.ArrayType(PACKET)), T.StructField("error", T.StringType())]
    parsed = append_columns(media.select(key, content), fields, fn, [content]).where(F.col("packets").isNotNull())
    return parsed.select(F.col(key), "error", F.posexplode_outer("packets").alias("packet", "p")).select(key, "packet", "p.*", "error")


def media_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as Matroska, read back through its packets, with checksums and sample features.

    feature: packets, duration, and of the samples as signed 8-bit: mean and root mean square in hundredths and sign
    changes. Null text is as empty; equal texts have equal values; repeated ids keep a row each. No shuffle.
    """
    out = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}

    def fn(texts: list) -> dict:
        rows = []
        for t in texts:
            raw, n = padded(t)
            media = mux(raw)
            packets = demux(media)
            back = packet_bytes(media, packets)
            x = (np.frombuffer(back, np.uint8).astype(np.int16) - 128).astype(np.int32)
            changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            mean, rms = int(x.sum(dtype=np.int64)) * 100 // len(x), int((int((x * x).sum(dtype=np.int64)) * 10_000 // len(x)) ** 0.5)
            feature = f"packets={len(packets)};ms={packets[-1][1] + (packets[-1][2] + 1) * FRAME_MS};mean={mean};rms={rms};changes={changes}"
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return dict(zip(out, map(list, zip(*rows)))) if rows else {k: [] for k in out}

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return append_columns(src, [T.StructField(k, v) for k, v in out.items()], fn, ["__text"]).drop("__text")

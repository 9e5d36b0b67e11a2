"""Small pictures for reports: area resampling of decoded pixels, written as PNG with a filter for each row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EDGE, MOST_BYTES = 200, 30_000


def area_resize(px: np.ndarray, w: int, h: int) -> np.ndarray:
    """(h, w, channels) means of the areas that each new pixel covers, parts of pixels by their share; never enlarges."""

    def along(a: np.ndarray, to: int) -> np.ndarray:
        n = a.shape[0]
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        edge = np.arange(to + 1) * n / to
        low = np.minimum(edge.astype(int), n - 1)
        part = (edge - low).reshape(-1, *[1] * (a.ndim - 1))
        upto = total[low] + part * a[low]
        return np.diff(upto, axis=0) * to / n

    out = along(along(px.astype(float), min(h, px.shape[0])).swapaxes(0, 1), min(w, px.shape[1])).swapaxes(0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def filtered_rows(px: np.ndarray) -> bytes:
    """Rows of PNG data, each under that of the five filters whose bytes are smallest in sum, taken as signed."""
    h, w, c = px.shape
    rows = px.reshape(h, w * c).astype(np.int16)
    up = np.concatenate([np.zeros((1, w * c), np.int16), rows[:-1]])
    left = np.concatenate([np.zeros((h, c), np.int16), rows[:, :-c]], axis=1)
    corner = np.concatenate([np.zeros((h, c), np.int16), up[:, :-c]], axis=1)
    guess = left + up - corner
    off = [np.abs(guess - x) for x in (left, up, corner)]
    paeth = np.where((off[0] <= off[1]) & (off[0] <= off[2]), left, np.where(off[1] <= off[2], up, corner))
    each = np.stack([(rows - x) & 255 for x in (np.zeros_like(rows), left, up, (left + up) >> 1, paeth)]).astype(np.uint8)
    best = np.abs(each.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return np.concatenate([best[:, None].astype(np.uint8), each[best, np.arange(h)]], axis=1).tobytes()


def png(px: np.ndarray) -> bytes:
    """A PNG of (h, w, 1, 3 or 4) bytes: grey, RGB or RGBA."""
    h, w, c = px.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered_rows(px), 9)) + chunk(b"IEND", b"")


def thumbnail(px: np.ndarray, edge: int = EDGE, most_bytes: int = MOST_BYTES) -> bytes:
    """A PNG of at most `edge` pixels a side; smaller where it would take more than most_bytes (down to 8 pixels)."""
    h, w, _ = px.shape
    while True:
        scale = min(1.0, edge / max(h, w))
        small = area_resize(px, max(1, round(w * scale)), max(1, round(h * scale)))
        data = png(small)
        if len(data) <= most_bytes or max(small.shape[:2]) <= 8:
            return data
        edge = max(8, min(max(small.shape[:2]) - 1, int(max(small.shape[:2]) * (most_bytes / len(data)) ** 0.5)))


def thumbnails(decoded: DataFrame, edge: int = EDGE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, png) of decoded pictures (path, width, height, channels, data), pixels blue first; those that could not be
    decoded are left out. Each task shrinks its pictures one by one; only small ones leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, out = [], []
            for i in range(b.num_rows):
                w, h, c, data = (b.column(k)[i].as_py() for k in range(1, 5))
                px = np.frombuffer(data, np.uint8).reshape(h, w, c)
                paths.append(b.column(0)[i].as_py())
                out.append(thumbnail(px if c == 1 else px[..., [2, 1, 0, 3][:c]], edge, most_bytes))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.binary())], names=["path", "png"])

    small = decoded.where("width > 0 and height > 0 and channels in (1, 3, 4)")
    return small.select("path", "width", "height", "channels", "data").mapInArrow(run, "path string, png binary")

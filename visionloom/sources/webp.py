"""WebP files: chunks, and pixels of the lossless kind (VP8L) by the published bitstream specification."""

from __future__ import annotations

import struct
from itertools import product

import numpy as np

#: Fixed values of the bitstream: the order of code-length codes, and the hash of the colour cache.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_HASH = 0x1E35A7BD
#: Near distances by code: the pixel above first, then by distance, higher rows first, left before right.
NEAR = sorted(((x, y) for x, y in product(range(-7, 9), range(8)) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Broken(ValueError):
    pass


def chunks(b: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name; an error where the container is no WebP or is cut off."""
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        raise Broken("no WebP")
    end, at, out = 8 + struct.unpack_from("<I", b, 4)[0], 12, {}
    if end > len(b):
        raise Broken("cut off")
    while at + 8 <= end:
        name, size = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + size > end:
            raise Broken("a chunk is cut off")
        out.setdefault(name, b[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        if self.n < n:
            more = self.data[self.at : self.at + 8]
            self.held |= int.from_bytes(more, "little") << self.n
            self.at += len(more)
            self.n += 8 * len(more)

    def read(self, n: int) -> int:
        self._fill(n)
        if self.n < n:
            raise Broken("the bits end early")
        v = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return v


class Prefix:
    """A canonical prefix code. Codes of up to 8 bits are looked up at once."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        if not used:
            raise Broken("an empty code")
        self.short: list[tuple[int, int] | None] = [None] * 256
        self.long: dict[tuple[int, int], int] = {}
        code, last = 0, 0
        for n, s in sorted(used):
            code <<= n - last
            turned, last = int(f"{code:0{n}b}"[::-1], 2), n
            if n <= 8:
                for k in range(turned, 256, 1 << n):
                    self.short[k] = (s, n)
            else:
                self.long[n, turned] = s
            code += 1
        if self.only is None and code != 1 << last:
            raise Broken("a code that is not complete")

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        bits._fill(15)
        hit = self.short[bits.held & 255]
        if hit is None:
            hit = next(((s, n) for n in range(9, 16) if (s := self.long.get((n, bits.held & ((1 << n) - 1)))) is not None), None)
        if hit is None or hit[1] > bits.n:
            raise Broken("the bits end early")
        bits.held >>= hit[1]
        bits.n -= hit[1]
        return hit[0]


def _prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise Broken("a symbol beyond the alphabet")
            lengths[s] = 1
        return Prefix(lengths)
    own = [0] * 19
    for k in range(bits.read(4) + 4):
        own[LENGTH_ORDER[k]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, before = Prefix(own), 0, 8
    while at < size and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        value, times = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + times > size:
            raise Broken("a repeat beyond the alphabet")
        lengths[at : at + times] = [value] * times
        at += times
    return Prefix(lengths)


def _number(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, w: int, h: int, main: bool) -> list[int]:
    """The entropy-coded values of an image, ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("a colour cache that is too large")
    groups, tile, per_row, which = 1, 0, 0, [0]
    if main and bits.read(1):
        tile = bits.read(3) + 2
        per_row = -(-w // (1 << tile))
        which = [p >> 8 & 0xFFFF for p in _pixels(bits, per_row, -(-h // (1 << tile)), False)]
        groups = max(which) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_prefix(bits, n) for n in sizes] for _ in range(groups)]
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    out: list[int] = []
    total, kept = w * h, 0  # kept: how many pixels are in the cache
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, far = codes[which[(at // w >> tile) * per_row + (at % w >> tile)] if per_row else 0]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _number(bits, s - 256)
            d = _number(bits, far.read(bits))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * w)
            if d > at or at + n > total:
                raise Broken("a copy from or to outside")
            if d >= n:
                out += out[at - d : at - d + n]
            else:
                out += (out[at - d :] * (n // d + 1))[:n]
        else:
            while kept < at:
                cache[(CACHE_HASH * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out.append(cache[s - 280])
    return out


def _channels(argb: list[int], h: int, w: int) -> np.ndarray:
    """(h, w, 4) of alpha, red, green, blue."""
    return np.array(argb, ">u4").view(np.uint8).reshape(h, w, 4).astype(np.int32)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The guess from the pixels left, above, above to the right and above to the left."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _half(_half(left, right), top)
    if mode in (6, 7, 8, 9):
        return _half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        off = mean - corner
        return np.clip(mean + np.sign(off) * (np.abs(off) >> 1), 0, 255)
    return np.array([255, 0, 0, 0])


def _unpredict(px: np.ndarray, modes: np.ndarray, bits: int) -> None:
    h, w, _ = px.shape
    px[0, 0] = (px[0, 0] + [255, 0, 0, 0]) & 255
    for x in range(1, w):
        px[0, x] = (px[0, x] + px[0, x - 1]) & 255
    for y in range(1, h):
        px[y, 0] = (px[y, 0] + px[y - 1, 0]) & 255
        row = modes[y >> bits]
        for x in range(1, w):
            right = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
            px[y, x] = (px[y, x] + _predicted(int(row[x >> bits]), px[y, x - 1], px[y - 1, x], right, px[y - 1, x - 1])) & 255


def _signed(v: np.ndarray) -> np.ndarray:
    return (v ^ 128) - 128


def lossless(data: bytes, w: int, h: int) -> np.ndarray:
    """(h, w, 4) uint8 pixels, red, green, blue, alpha, of an image stream: transforms, then the entropy-coded image."""
    bits, full, done = Bits(data), w, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [d[0] for d in done]:
            raise Broken("a transform comes twice")
        if kind in (0, 1):
            size = bits.read(3) + 2
            bw, bh = -(-w // (1 << size)), -(-h // (1 << size))
            done.append((kind, size, w, _channels(_pixels(bits, bw, bh, False), bh, bw)))
        elif kind == 2:
            done.append((kind, 0, w, None))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_pixels(bits, n, 1, False), 1, n)[0], axis=0) & 255
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            done.append((kind, size, w, table))
            w = -(-w // (1 << size))
    px = _channels(_pixels(bits, w, h, True), h, w)
    for kind, size, wide, held in reversed(done):
        if kind == 0:
            _unpredict(px, held[..., 2] & 15, size)
        elif kind == 1:
            tile = held[np.arange(h)[:, None] >> size, np.arange(wide)[None, :] >> size]
            green = _signed(px[..., 2])
            px[..., 1] = (px[..., 1] + (_signed(tile[..., 3]) * green >> 5)) & 255
            px[..., 3] = (px[..., 3] + (_signed(tile[..., 2]) * green >> 5) + (_signed(tile[..., 1]) * _signed(px[..., 1]) >> 5)) & 255
        elif kind == 2:
            px[..., 1] = (px[..., 1] + px[..., 2]) & 255
            px[..., 3] = (px[..., 3] + px[..., 2]) & 255
        else:
            x, each = np.arange(wide), 8 >> size
            index = px[:, x >> size, 2] >> ((x & ((1 << size) - 1)) * each) & ((1 << each) - 1)
            px = np.concatenate([held, np.zeros((256, 4), held.dtype)])[index]
    return px[..., [1, 2, 3, 0]].astype(np.uint8)


def alpha_plane(chunk: bytes, w: int, h: int) -> np.ndarray:
    """(h, w) of an alpha chunk, raw or lossless, its filter undone."""
    how, filtered = chunk[0] & 3, chunk[0] >> 2 & 3
    flat = np.frombuffer(chunk[1 : 1 + w * h], np.uint8).reshape(h, w) if how == 0 else lossless(chunk[1:], w, h)[..., 1]
    out = flat.astype(np.int32)
    if filtered == 0:
        return flat
    out[0] = np.cumsum(out[0]) & 255
    for y in range(1, h):
        if filtered == 2:
            out[y] = (out[y] + out[y - 1]) & 255
            continue
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for x in range(1, w):
            guess = out[y, x - 1] if filtered == 1 else min(255, max(0, out[y, x - 1] + out[y - 1, x] - out[y - 1, x - 1]))
            out[y, x] = (out[y, x] + guess) & 255
    return out.astype(np.uint8)


def decode(b: bytes) -> tuple[str, np.ndarray | None]:
    """("lossless", RGBA pixels), ("lossy", None) where the frame is there but is not of the kind that is decoded here,
    ("animated", None), or ("broken", None)."""
    try:
        parts = chunks(b)
        if b"VP8L" in parts:
            data = parts[b"VP8L"]
            size = struct.unpack_from("<I", data, 1)[0]
            if data[0] != 0x2F or size >> 29:
                raise Broken("no lossless image")
            px = lossless(data[5:], (size & 0x3FFF) + 1, (size >> 14 & 0x3FFF) + 1)
            if not size >> 28 & 1:
                px[..., 3] = 255
            return "lossless", px
        if b"VP8 " in parts:
            frame = parts[b"VP8 "]
            first = int.from_bytes(frame[:3], "little")  # a key frame: a bit, its start code, a first part that is not cut off
            return ("broken" if first & 1 or frame[3:6] != b"\x9d\x01\x2a" or (first >> 5) > len(frame) - 10 else "lossy"), None
        return ("animated" if b"ANMF" in parts else "broken"), None
    except (Broken, struct.error, IndexError, ValueError):
        return "broken", None

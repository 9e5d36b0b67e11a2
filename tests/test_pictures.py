import os
import random
import struct
import sysconfig
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visionloom.operators import clean, report
from visionloom.sources import images, listing, thumbs, webp


class Writer:
    """Bits of a lossless WebP stream, lowest first; codes of equal length for all symbols."""

    def __init__(self):
        self.v = self.n = 0

    def put(self, v, n):
        self.v |= v << self.n
        self.n += n

    def done(self):
        return self.v.to_bytes(-(-self.n // 8), "little")

    def code(self, lengths):
        """A prefix code with the given lengths (a power of two in sum); gives a function that writes a symbol."""
        self.put(0, 1)
        own = [4] * 16  # sixteen lengths of four bits each
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(own[s] if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)
        order, codes, code, last = sorted((n, s) for s, n in enumerate(lengths) if n), {}, 0, 0
        for n, s in order:
            code <<= n - last
            codes[s], last = (int(f"{code:0{n}b}"[::-1], 2), n), n
            code += 1
        return lambda s: self.put(*codes[s])

    def single(self, s=0):
        self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(s, 8)


def entropy_image(w, px, main, cache_bits=0, copies=()):
    """An entropy-coded image: literals, but for copies (at, length, code of the distance) and what is in the cache."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    lengths = [9] * size
    for k in range(512 - size):  # shorter codes for the first ones make the code complete
        lengths[k] = 8
    green = w.code(lengths)
    red, blue, alpha = (w.code([8] * 256) for _ in range(3))
    far = w.code([6] * 16 + [5] * 24)
    flat, at, cache = px.reshape(-1, 4).tolist(), 0, {}
    copies = {a: (n, d) for a, n, d in copies}

    def number(v, put):
        for k in range(24):
            low, extra = (k + 1, 0) if k < 4 else (((2 + (k & 1)) << ((k - 2) >> 1)) + 1, (k - 2) >> 1)
            if low <= v < low + (1 << extra):
                put(k)
                w.put(v - low, extra)
                return

    used = 0
    while at < len(flat):
        r, g, b, a = flat[at]
        argb = a << 24 | r << 16 | g << 8 | b
        slot = (webp.CACHE_HASH * argb & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if at in copies:
            n, d = copies[at]
            number(n, lambda s: green(256 + s))
            number(d, far)
        elif cache_bits and cache.get(slot) == argb:
            green(280 + slot)
            n, used = 1, used + 1
        else:
            green(g), red(r), blue(b), alpha(a)
            n = 1
        for r, g, b, a in flat[at : at + n]:
            argb = a << 24 | r << 16 | g << 8 | b
            if cache_bits:
                cache[(webp.CACHE_HASH * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
        at += n
    return used


def file_of(stream, w, h, alpha=True):
    data = b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14 | alpha << 28) + stream
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encoded(px, cache_bits=0, copies=(), green=False):
    h, w, _ = px.shape
    out = Writer()
    if green:
        out.put(1, 1), out.put(2, 2)
    out.put(0, 1)
    src = px.astype(np.int32)
    if green:
        src = src.copy()
        src[..., 0] = (src[..., 0] - src[..., 1]) & 255
        src[..., 2] = (src[..., 2] - src[..., 1]) & 255
    used = entropy_image(out, src, True, cache_bits, copies)
    return file_of(out.done(), w, h), used


def noise(w, h, seed=1, colours=None):
    g = np.random.default_rng(seed)
    px = g.integers(0, 256, (h, w, 4)).astype(np.uint8)
    return px if colours is None else px.reshape(-1, 4)[:colours][g.integers(0, colours, (h, w))]


def test_lossless_webp_decodes_to_known_pixels():
    px = noise(13, 7)
    data, _ = encoded(px)
    kind, got = webp.decode(data)
    assert kind == "lossless" and (got == px).all()
    assert (webp.decode(encoded(px, green=True)[0])[1] == px).all()
    few = noise(20, 9, 2, 6)
    data, used = encoded(few, cache_bits=4)
    assert used > 50 and (webp.decode(data)[1] == few).all()
    tiled = np.tile(noise(4, 3, 3), (3, 4, 1))  # 16 x 9: each pixel is the one four to the left, or three rows above
    left, above = webp.NEAR.index((4, 0)) + 1, webp.NEAR.index((0, 3)) + 1
    copies = [(4, 12, left), (20, 12, left), (36, 12, left), (48, 96, above)]
    assert (webp.decode(encoded(tiled, copies=copies)[0])[1] == tiled).all()
    far = [(4, 12, left), (48, 96, 120 + 48)]  # the same distance as a plain number
    assert (webp.decode(encoded(tiled, copies=far)[0])[1] == tiled).all()


def test_transforms_of_lossless_webp():
    g = np.random.default_rng(5)
    h, w = 6, 9
    table = g.integers(0, 256, (3, 4)).astype(np.int64)
    index = g.integers(0, 3, (h, w))
    out = Writer()
    out.put(1, 1), out.put(3, 2), out.put(2, 8)  # three colours: four to a byte
    entropy_image(out, np.diff(table, axis=0, prepend=0)[None] & 255, False)
    out.put(0, 1)
    packed = np.zeros((h, 3, 4), np.int64)
    for x in range(w):
        packed[:, x // 4, 1] |= index[:, x] << 2 * (x % 4)
    entropy_image(out, packed, True)
    assert (webp.decode(file_of(out.done(), w, h))[1] == table[index]).all()

    px = noise(9, 6, 6).astype(np.int64)

    def guess(mode, y, x):
        at = lambda dy, dx: px[y + dy, x + dx]
        if (y, x) == (0, 0):
            return np.array([0, 0, 0, 255])
        if y == 0 or x == 0:
            return at(0, -1) if y == 0 else at(-1, 0)
        left, top, corner = at(0, -1), at(-1, 0), at(-1, -1)
        right = at(-1, 1) if x + 1 < 9 else px[y, 0]
        mean = lambda a, b: (a + b) // 2
        select = left if abs(top - corner).sum() < abs(left - corner).sum() else top
        full = np.clip(left + top - corner, 0, 255)
        half = np.array([min(255, max(0, a + int((a - c) / 2))) for a, c in zip(mean(left, top).tolist(), corner.tolist())])
        return [np.array([0, 0, 0, 255]), left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)), select, full, half][mode]

    for mode in range(14):
        out = Writer()
        out.put(1, 1), out.put(0, 2), out.put(0, 3)  # blocks of four pixels
        modes = np.zeros((2, 3, 4), np.int64)
        modes[..., 1] = mode
        entropy_image(out, modes, False)
        out.put(0, 1)
        rest = np.array([[(px[y, x] - guess(mode, y, x)) & 255 for x in range(9)] for y in range(6)])
        entropy_image(out, rest, True)
        assert (webp.decode(file_of(out.done(), 9, 6))[1] == px).all(), mode

    s8 = lambda v: v - 256 if v > 127 else v
    out = Writer()
    out.put(1, 1), out.put(1, 2), out.put(0, 3)
    mult = g.integers(0, 256, (2, 3, 4)).astype(np.int64)  # red to blue, green to blue, green to red as R, G, B
    entropy_image(out, mult, False)
    out.put(0, 1)
    rest = px.copy()
    for y in range(6):
        for x in range(9):
            rb, gb, gr, _ = mult[y // 4, x // 4].tolist()
            red, green, blue, _ = px[y, x].tolist()
            rest[y, x, 0] = (red - (s8(gr) * s8(green) >> 5)) & 255
            rest[y, x, 2] = (blue - (s8(gb) * s8(green) >> 5) - (s8(rb) * s8(red) >> 5)) & 255
    entropy_image(out, rest, True)
    assert (webp.decode(file_of(out.done(), 9, 6))[1] == px).all()


def sample(name):
    path = os.path.join(sysconfig.get_paths()["stdlib"], "test", "test_email", "data", name)
    if not os.path.exists(path):
        pytest.skip("the interpreter comes without its test data")
    return path


def test_a_real_alpha_plane_equals_that_of_the_png():
    with open(sample("python.webp"), "rb") as f:
        data = f.read()
    assert webp.decode(data) == ("lossy", None)
    with open(sample("python.png"), "rb") as f:
        raw = f.read()
    at = raw.index(b"tRNS")
    clear = raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]]
    at = raw.index(b"IDAT")
    rows, want = zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]]), []
    before = [0] * 16
    for y in range(16):
        kind, row = rows[17 * y], list(rows[17 * y + 1 : 17 * y + 17])
        for i in range(16):
            a, b, c = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[i] = (row[i] + (0, a, b, (a + b) // 2, near)[kind]) & 255
        want.append([clear[v] if v < len(clear) else 255 for v in row])
        before = row
    assert (webp.alpha_plane(webp.chunks(data)[b"ALPH"], 16, 16) == np.array(want)).all()


def test_broken_webp_never_fails():
    good, _ = encoded(noise(13, 7))
    g = random.Random(2)
    for k in range(150):
        b = bytearray(good)
        b = b[: g.randrange(len(b))] if k % 2 else b
        for _ in range(k % 3 * 2):
            if b:
                b[g.randrange(len(b))] = g.randrange(256)
        kind, px = webp.decode(bytes(b))
        assert (kind == "lossless") == (px is not None)
    assert webp.decode(b"")[0] == webp.decode(good[:-9])[0] == "broken"


def test_area_resampling_equals_a_plain_loop():
    px = noise(17, 11, 9)[..., :3]
    for w, h in ((5, 4), (17, 11), (1, 1), (16, 3)):
        got = thumbs.area_resize(px, w, h)
        for y in range(h):
            for x in range(w):
                total = np.zeros(3)
                for j in range(11):
                    for i in range(17):
                        wy = max(0, min(j + 1, (y + 1) * 11 / h) - max(j, y * 11 / h))
                        wx = max(0, min(i + 1, (x + 1) * 17 / w) - max(i, x * 17 / w))
                        total += px[j, i] * (wx * wy)
                assert np.abs(got[y, x] - total * w * h / (11 * 17)).max() <= 0.5 + 1e-6


def test_thumbnails_of_large_and_odd_files(spark, tmp_path):
    g = np.random.default_rng(1)
    for k in range(24):  # 24 large pictures of some structure and noise
        y, x = np.mgrid[0:900, 0:1200]
        px = np.stack([(x * (k + 1) // 7) % 256, (y + 31 * k) % 256, (x + y) % 256], axis=2) + g.integers(0, 40, (900, 1200, 3))
        (tmp_path / f"p{k}.png").write_bytes(thumbs.png(np.clip(px, 0, 255).astype(np.uint8)))
    gray = noise(30, 20, 4)[..., :1]
    (tmp_path / "gray one.png").write_bytes(thumbs.png(gray))
    four = noise(12, 10, 5)
    (tmp_path / "w.webp").write_bytes(encoded(four)[0])
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "bad.webp").write_bytes(encoded(four)[0][:-7])
    with open(sample("python.webp"), "rb") as f:
        (tmp_path / "lossy.webp").write_bytes(f.read())
    name = F.regexp_extract("path", "([^/]+)$", 1)
    plain = {r["n"]: r for r in images.decoded(spark, str(tmp_path)).where("path like '%one.png' or path like '%.webp'").select(name.alias("n"), "*").collect()}
    assert (np.frombuffer(plain["gray one.png"]["data"], np.uint8).reshape(20, 30, -1)[..., 0] == gray[..., 0]).all()  # the JVM reads what is written here
    assert bytes(plain["w.webp"]["data"]) == four[..., [2, 1, 0, 3]].tobytes() and plain["bad.webp"]["width"] == -1 and plain["lossy.webp"]["width"] == -2
    assert {r["path"].rsplit("/", 1)[1] for r in images.unreadable(spark, str(tmp_path)).collect()} == {"empty.jpg", "bad.webp"}
    small = {r["n"]: bytes(r["png"]) for r in thumbs.thumbnails(images.decoded(spark, str(tmp_path))).select(name.alias("n"), "png").collect()}
    assert len(small) == 26 and max(map(len, small.values())) <= 30_000
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.png").write_bytes(small["w.webp"])
    back = images.decoded(spark, str(tmp_path / "t")).first()
    assert (np.frombuffer(back["data"], np.uint8).reshape(10, 12, 4)[..., :3] == four[..., 2::-1]).all()
    rows = spark.createDataFrame([(f"i{k}", f"p{k}.png", "s", 1200, 900, "train", None, None, k, f"{tmp_path}/p{k}.png") for k in range(24)] + [("x", "x.png", "s", 5, 5, None, None, None, 99, f"{tmp_path}/none.png")], "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long, path string")
    boxes = spark.createDataFrame([(f"i{k}", "cat", "bbox", 1.0, 1.0, 11.0, 11.0, None) for k in range(24)], "image_uid string, category string, kind string, x1 double, y1 double, x2 double, y2 double, score double")
    html = report.pictures(rows, boxes, "path")
    assert html.count("data:image/png;base64,") == 24 and len(html) < 1_000_000


def test_empty_images_are_listed_and_flagged(spark, tmp_path):
    for folder in ("a/b/c", "a/d e", "f"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "a/b/c/1.jpg").write_bytes(b"")
    (tmp_path / "a/d e/2 x.png").write_bytes(thumbs.png(noise(40, 40)[..., :3]))
    (tmp_path / "f/3.txt").write_text("x")
    (tmp_path / "top.txt").write_text("")
    (tmp_path / ".hidden").write_text("x")
    got = {r["rel"]: (r["path"], r["size"]) for r in listing.list_files(spark, str(tmp_path)).collect()}
    assert {k: v[1] for k, v in got.items() if k != "a/d e/2 x.png"} == {"a/b/c/1.jpg": 0, "f/3.txt": 1, "top.txt": 0}
    assert got["a/b/c/1.jpg"][0] == f"file:{tmp_path}/a/b/c/1.jpg"
    assert listing.list_files(spark, str(tmp_path / "f" / "none")).count() == 0
    rows = spark.createDataFrame([("u1", got["a/b/c/1.jpg"][0]), ("u2", got["a/d e/2 x.png"][0])], "uid string, path string")
    found = clean.file_findings(rows, spark.createDataFrame([], "path string, orientation int"), images.unreadable(spark, str(tmp_path)), spark.createDataFrame([], "rel string"))
    assert [(r["rule"], r["image_uid"]) for r in found.collect()] == [("image_unreadable", "u1")]

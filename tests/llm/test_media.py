import hashlib
import io
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillbase.llm import media

RNG = np.random.default_rng(1)


def bmp(image):
    h, w = image.shape[:2]
    rows = [image[y, :, ::-1].tobytes().ljust((w * 3 + 3) // 4 * 4, b"\0") for y in range(h - 1, -1, -1)]
    return struct.pack("<2sIHHI", b"BM", 54 + len(b"".join(rows)), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(rows)


def test_formats():
    grey = RNG.integers(0, 256, (5, 7), dtype=np.uint8)
    rgb = RNG.integers(0, 256, (4, 5, 3), dtype=np.uint8)
    wide = RNG.integers(0, 1000, (3, 2)).astype(">u2")
    bits = RNG.integers(0, 2, (3, 11), dtype=np.uint8)
    assert (media.decode(b"P5 #x\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P6\n5 4 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P5 2 3 999\n" + wide.tobytes()) == (wide.astype(np.int64) * 65535 * 2 + 999) // 1998).all()  # scaled to 16 bits
    assert (media.decode(b"P5 2 3 65535\n" + wide.tobytes()) == wide).all()
    assert (media.decode(b"P2 7 5 255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P3 5 4 255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert (media.decode(b"P4 11 3\n" + np.packbits(bits, axis=1).tobytes()) == (1 - bits) * 255).all()
    assert (media.decode(b"P1 11 3\n" + "".join(map(str, bits.ravel())).encode()) == (1 - bits) * 255).all()
    assert (media.decode(bmp(rgb)) == rgb).all()
    for bad in (b"", b"GIF89a", b"P5 0 4 255\n", b"P5 4 4 255\nabc"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.decode(bad)


def brute(image, height, width):
    h, w = image.shape
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(width):
            total = Fraction(0)
            for i in range(h):
                a = min(Fraction((y + 1) * h, height), i + 1) - max(Fraction(y * h, height), i)
                for j in range(w) if a > 0 else ():
                    b = min(Fraction((x + 1) * w, width), j + 1) - max(Fraction(x * w, width), j)
                    total += a * b * int(image[i, j]) if b > 0 else 0
            out[y, x] = (total / Fraction(h * w, height * width) + Fraction(1, 2)) // 1
    return out


@pytest.mark.parametrize("shape", [(1, 64), (13, 64), (3, 5), (40, 9)])
def test_resize_is_the_mean_of_areas(shape):
    image = RNG.integers(0, 256, shape, dtype=np.uint8)
    for target in ((8, 9), (4, 4), (20, 30)):
        assert (media.resize(image, *target) == brute(image, *target)).all()


def test_tiles(spark):
    image = RNG.integers(0, 256, (50, 40), dtype=np.uint8)
    rows = [(1, media.encode_pgm(image)), (2, b"no image"), (None, None), (1, media.encode_pgm(image))]
    got = media.with_tiles(spark.createDataFrame(rows, "doc_id long, picture binary"), "picture").collect()
    assert len(got) == 4 and got[0].tile == got[3].tile
    assert (np.load(io.BytesIO(got[0].tile)) == media.resize(image, 32, 32)).all()
    cells = media.resize(image, 8, 9)
    assert int(got[0].dhash, 16) == int("".join(str(int(a > b)) for row in cells for a, b in zip(row, row[1:], strict=False)), 2)
    assert got[1].tile is None and got[1].error and got[2].error


def test_texts_survive(spark, odd, none):
    got = sorted(media.payload_features(media.text_images(odd)).drop("tile").collect(), key=str)
    want = []
    for r in odd.collect():
        data = (r.text or "").encode()
        full = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        stored = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        want.append((r.doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    assert len({r.feature for r in got if r.payload_sha256 == got[0].payload_sha256}) == 1
    assert media.payload_features(media.text_images(none)).count() == 0


def test_query(spark, sf):
    """The registered query, row by row, with a plain area mean and difference hash."""
    def mean(rows, n, m):
        def cover(size, parts):
            return [[(k, min(Fraction(size * (i + 1), parts), k + 1) - max(Fraction(size * i, parts), k)) for k in range(size * i // parts, -(-size * (i + 1) // parts))] for i in range(parts)]

        ys, xs = cover(len(rows), n), cover(64, m)
        area = Fraction(len(rows) * 64, n * m)
        return [[int(sum(rows[y][x] * v * w for y, v in a for x, w in b) / area + Fraction(1, 2)) for b in xs] for a in ys]

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op5_media(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id]
        full = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        image = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(image), hashlib.sha256(image).hexdigest())
    for r in sorted(rows, key=lambda r: r.payload_bytes)[:25]:
        full = docs[r.doc_id].ljust(r.payload_bytes, b"\0")
        lines = [full[k : k + 64] for k in range(0, len(full), 64)]
        cells = mean(lines, 8, 9)
        bits = "".join(str(int(a > b)) for row in cells for a, b in zip(row, row[1:], strict=False))
        tile = bytes(x for row in mean(lines, 16, 16) for x in row)
        assert r.feature == f"{int(bits, 2):016x}:{hashlib.sha256(tile).hexdigest()[:16]}"


def test_samples_outside_their_range():
    for bad in (b"P2\n1 1\n255\n99999999999999999999", b"P2\n1 1\n255\n300", b"P2\n1 1\n255\n-5", b"P1\n1 1\n7", b"P5\n1 1\n15\n\xff"):
        with pytest.raises(ValueError):
            media.decode(bad)
    assert media.decode(b"P2\n3 1\n15\n0 15 5").tolist() == [[0, 255, 85]]


def test_long_images_are_summed_in_steps(monkeypatch):
    image = RNG.integers(0, 256, (5000, 64), dtype=np.uint8)
    whole = media.resize(image, 16, 16)
    monkeypatch.setattr(media, "MAX_SUMMED", 64 * 7)
    assert (media.resize(image, 16, 16) == whole).all()

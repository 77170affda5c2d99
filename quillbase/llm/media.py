"""Operator 5, media columns: Netpbm and BMP images to NPY tiles with difference hashes.

Decoded: Netpbm P1 to P6 (bits, greys and colours, plain and raw, up to 16 bits a sample) and uncompressed BMP
with 8, 24 or 32 bits. Tiles are area-resized: each target cell is the mean of the source area it covers,
fractions of pixels included, taken from an integral image. The difference hash has one bit for each pair of
neighbouring cells of a 9 x 8 grey tile: 1 if the left one is brighter.

A null or undecodable image has null results and the reason in `error`; so has one without pixels or with samples
outside its range. Samples of a smaller range are scaled to 8 (or 16) bits. Very long images are summed some rows at a time.
For op5, texts become 64-wide grey images; an empty text (or null) is one row of 64 zero bytes. Each row depends on
its own bytes alone: equal texts have equal values, repeated rows and clashing or null ids don't matter. An empty table
gives an empty result; a column to keep with the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

WIDTH = 64
TILE = (32, 32)
#: Of the texts' images.
TEXT_TILE = (16, 16)
#: Samples that an integral image has in memory at once.
MAX_SUMMED = 1 << 20


def _pnm(data: bytes) -> np.ndarray:
    kind, fields, at = data[:2], [], 2
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = (*fields, 1)[:3]
    if not (width and height and 0 < top < 65536):
        raise ValueError("no pixels")
    planes = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, planes)[: 3 if planes == 3 else 2]
    n = height * width * planes
    if kind == b"P1":
        bits = np.frombuffer(b"".join(data[at:].split()), np.uint8)[:n] - 48
        if (bits > 1).any():
            raise ValueError("a bit that is neither 0 nor 1")
        return ((1 - bits) * 255).astype(np.uint8).reshape(shape)
    if kind in (b"P2", b"P3"):
        words = data[at:].split()[:n]
        if any(len(w) > 5 for w in words):
            raise ValueError("a sample over the maximum")
        return _scaled(np.array(words, np.int64).reshape(shape), top)
    body = data[at + 1 :]
    if kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(body, np.uint8, row * height).reshape(height, row), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    return _scaled(np.frombuffer(body, np.uint8 if top < 256 else np.dtype(">u2"), n).reshape(shape), top)


def _scaled(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to top as 8 bits, or as 16 where top needs them."""
    kind, full = (np.uint8, 255) if top < 256 else (np.uint16, 65535)
    if top == full and samples.dtype == np.uint8:
        return samples
    if samples.size and (samples.min() < 0 or samples.max() > top):
        raise ValueError("a sample outside its range")
    return samples.astype(kind) if top == full else ((samples.astype(np.int64) * full * 2 + top) // (2 * top)).astype(kind)


def _bmp(data: bytes) -> np.ndarray:
    start, header, width, height, _, depth, packed = struct.unpack_from("<4xI" "IiiHHI", data, 6)
    if packed or depth not in (8, 24, 32):
        raise ValueError("packed or unusual BMP")
    if width <= 0 or not height:
        raise ValueError("no pixels")
    row = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """height x width (grey) or height x width x 3 (red, green, blue) samples."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _pnm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of areas, rounded half up, from an integral image read between its grid points."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        # sums over [i * size / n, (i + 1) * size / n) in units of 1 / n, from running sums at the edges
        size = x.shape[0]
        edge = np.arange(n + 1) * size
        whole, part = edge // n, edge % n
        wanted = np.unique(np.concatenate((whole, np.minimum(whole + 1, size))))
        total = np.zeros((len(wanted), *x.shape[1:]), np.int64)
        before, step = np.zeros(x.shape[1:], np.int64), max(1, MAX_SUMMED // max(1, x[0].size))
        for at in range(0, size, step):
            running = before + np.cumsum(x[at : at + step], axis=0, dtype=np.int64)
            here = (wanted > at) & (wanted <= at + step)
            total[here] = running[wanted[here] - at - 1]
            before = running[-1]
        part = part.reshape(-1, *[1] * (x.ndim - 1))
        low, high = total[np.searchsorted(wanted, whole)], total[np.searchsorted(wanted, np.minimum(whole + 1, size))]
        return np.diff(low * n + part * (high - low), axis=0)

    sums = along(np.swapaxes(along(image, height), 0, 1), width)
    area = image.shape[0] * image.shape[1]
    return np.swapaxes((2 * sums + area) // (2 * area), 0, 1)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def difference_hash(image: np.ndarray) -> str:
    cells = resize(grey(image), 8, 9)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def with_tiles(df: DataFrame, image_col: str, keep: tuple[str, ...] = ("doc_id",), tile: tuple[int, int] = TILE) -> DataFrame:
    """For each row height, width, tile (bytes of an NPY file), dhash and error."""
    names = ("height", "width", "tile", "dhash", "error")
    kept = [c for c in keep if c not in names]
    src = df.select(*kept, F.col(image_col).alias("__image__"))
    schema = T.StructType([src.schema[c] for c in kept]).add("height", "integer").add("width", "integer").add("tile", "binary").add("dhash", "string").add("error", "string")

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(len(kept)):
                try:
                    image = decode(data.as_py() or b"")
                    small = resize(image, *tile).astype(image.dtype)
                    rows.append((image.shape[0], image.shape[1], npy(small), difference_hash(image), None))
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    rows.append((None, None, None, None, str(e)[:200]))
            made = zip(*rows, strict=True) if rows else [[]] * 5
            arrays = [pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + arrays, names=schema.names)

    return src.mapInArrow(run, schema)


def text_to_pgm(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, a grey image 64 wide of them and of the padding)."""
    data = (text or "").encode()
    samples = np.zeros(max(1, -(-len(data) // WIDTH)) * WIDTH, np.uint8)
    samples[: len(data)] = np.frombuffer(data, np.uint8)
    return len(data), encode_pgm(samples.reshape(-1, WIDTH))


def _mapped(df: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...], schema: T.StructType, make) -> DataFrame:
    """keep (but for names of results) and what make() gives for the values of some columns in each row, as a tuple."""
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [c for c in keep if c not in schema.names]
    src = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__value{i}__") for i, c in enumerate(columns)])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [make(*(x.as_py() for x in values)) for values in zip(*part.columns[len(kept) :], strict=True)]
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + made, names=[*kept, *schema.names])

    return src.mapInArrow(run, T.StructType([src.schema[c] for c in kept] + schema.fields))


def text_images(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row n_bytes and image (a PGM file)."""
    return _mapped(df, (text_col,), keep, T.StructType().add("n_bytes", "long").add("image", "binary"), text_to_pgm)


def payload_features(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What is read back from stored images: their samples' digests, the image's own, tile (an NPY file of the area-resized samples) and feature.

    feature: the difference hash of the image, and a digest of the samples of the tile as it reads back.
    """
    schema = T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("tile", "binary").add("feature", "string")

    def make(data):
        image = decode(data)
        payload = image.tobytes()
        tile = npy(resize(image, *TEXT_TILE).astype(np.uint8))
        cells = np.load(io.BytesIO(tile)).tobytes()
        feature = f"{difference_hash(image)}:{hashlib.sha256(cells).hexdigest()[:16]}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), tile, feature

    return _mapped(df, ("image",), keep, schema, make)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = stored(text_images(table(spark, sf_dir, "documents")), "media")
    return payload_features(images).drop("tile")

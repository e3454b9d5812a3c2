"""Media columns: Netpbm and BMP in numpy, area resizing, NPY tiles, difference hashes.

Images are binary columns. Netpbm of all six plain and raw kinds and
uncompressed BMP of 8, 24 and 32 bits are decoded to arrays (rows, columns,
channels). A resize takes means over areas by an integral image, of which a
strip is made at a time, with exact weights for pixels that an area cuts.
Tiles are NPY files in a column, and hashes compare neighbours in a tile.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, shared_path, slices, trimmed

#: Width of the images that hold payloads; rows and columns of a tile; rows of an image that are summed at once.
WIDTH, TILE, STRIP = 64, (8, 9), 1 << 14


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows from the bottom, each padded to four bytes."""
    h, w = samples.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    start = 14 + len(info) + palette.nbytes
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + info + palette.tobytes() + rows.tobytes()


def _tokens(data: bytes, n: int) -> tuple[list[int], int]:
    """The next n numbers of a Netpbm header after its kind, and where they end."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = int(data[1:2])
    bits, channels, raw = kind in (1, 4), 3 if kind in (3, 6) else 1, kind > 3
    numbers, at = _tokens(data, 2 if bits else 3)
    w, h, top = numbers[0], numbers[1], 1 if bits else numbers[2]
    if raw and bits:
        rows = np.frombuffer(data, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :w])[:, :, None]
    if raw:
        kind_of = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        return np.frombuffer(data, kind_of, h * w * channels, at + 1).reshape(h, w, channels)
    body = data[at:]
    values = [int(c) for c in body.decode() if c in "01"] if bits else [int(x) for x in body.split()]
    found = np.array(values[: h * w * channels], np.uint16 if top > 255 else np.uint8).reshape(h, w, channels)
    return 1 - found if bits else found


def decode_bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("BMP of a kind that is not read")
    stride = -(-w * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if depth == 8:
        (colours,) = struct.unpack_from("<I", data, 46)
        palette = np.frombuffer(data, np.uint8, 4 * (colours or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
        if len(palette) == 256 and (palette == np.arange(256)[:, None]).all():
            return rows[:, :w, None]
        return palette[rows[:, :w]]
    return rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def integral_rows(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of the integral image of a two-dimensional image of whole numbers, which is made STRIP rows at a time."""
    h, w = image.shape
    out, above = np.zeros((len(wanted), w + 1), np.int64), np.zeros(w + 1, np.int64)
    for start in range(0, h, STRIP):
        sums = np.cumsum(image[start : start + STRIP], axis=0, dtype=np.int64)
        np.cumsum(sums, axis=1, out=sums)
        sums += above[1:]
        here = np.flatnonzero((wanted > start) & (wanted <= start + len(sums)))
        out[here, 1:] = sums[wanted[here] - start - 1]
        above[1:] = sums[-1]
    return out


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of a two-dimensional image over rows x columns areas of equal size.

    Sums are whole numbers, in parts of a pixel, so only the last division rounds.
    """
    h, w = image.shape

    def places(n: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * n
        return at // parts, np.minimum(at // parts + 1, n), at % parts

    low, high, part = places(h, rows)
    lines = integral_rows(image, np.concatenate([low, high]))
    lines = lines[: rows + 1] * rows + (lines[rows + 1 :] - lines[: rows + 1]) * part[:, None]
    low, high, part = places(w, columns)
    cells = lines[:, low] * columns + (lines[:, high] - lines[:, low]) * part
    return np.diff(np.diff(cells, axis=0), axis=1) / (h * w)


def difference_hash(tile: np.ndarray) -> str:
    bits = np.packbits((tile[:, 1:] > tile[:, :-1]).ravel())
    return bits.tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(tile))
    return out.getvalue()


@trimmed
def _stored(batches, form: str):
    put = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    for batch in batches:
        for part in slices(batch):
            texts = [t or b"" for t in byte_rows(part.column(1))]
            padded = [t + bytes(-len(t) % WIDTH or (0 if t else WIDTH)) for t in texts]
            media = [put(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p in padded]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


@trimmed
def _read(batches):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        for b in slices(batch):
            out = []
            for data in byte_rows(b.column("media")):
                image = decode(data)
                payload = image.tobytes()
                tile = np.clip(np.rint(area_resize(image[:, :, 0], *TILE)), 0, 255).astype(np.uint8)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tile), npy(tile)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]], ["doc_id", "n_bytes", *MEASURES])


MEASURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]


def store_texts(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes as the samples of a grey image 64 wide.

    Zero bytes fill the last row; a null or empty text is one row of zeros.
    Very long texts are tall images. Repeated rows and ids stay rows of their
    own, other columns go, and an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda b: _stored(b, form), f"doc_id {kind}, n_bytes long, media binary")


def measure(media: DataFrame) -> DataFrame:
    """Digests, an NPY tile (uint8, TILE) and its difference hash, from the bytes of (doc_id, n_bytes, media).

    Equal media have equal measures; where neighbours of a tile tie, the bit is 0.
    """
    kind = dict(media.dtypes)["doc_id"]
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, f"doc_id {kind}, n_bytes long, {schema}")


def op7_media_netpbm(docs: DataFrame) -> DataFrame:
    """The media are written as a table in the shared folder and read back."""
    spark = docs.sparkSession
    path = shared_path(spark, "media")
    store_texts(docs).write.option("compression", "zstd").parquet(path)
    return measure(spark.read.parquet(path)).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")

"""Media columns: Netpbm and BMP to numpy arrays, area-resized, as NPY tiles with difference hashes.

Decoders: Netpbm P1-P6 (plain and raw, 8 and 16 bits), BMP with 8, 24 or 32 bits and no compression.
Resizing averages exact areas by an integral image, so a pixel that straddles a border counts by
its share.  The difference hash compares neighbours of a grey 9 x 8 reduction.

Media that cannot be decoded, and null media, give null tiles and hashes, never a failure: sizes are held against the bytes that are
there, and samples against the maximum that the header states, before anything is allocated.  Tiles are scaled by that maximum to 0 to 255.
Very large media and texts are taken whole; a row needs about 20 times its bytes of memory for a moment.  A text becomes media by :func:`pack`: its UTF-8 bytes (null: none), zeros up to a positive multiple of 64, as a raw PGM that is 64
pixels wide, so an empty text is one row of zeros.  Rows are worked on alone: repeated rows agree, an empty
table gives an empty result, and other columns are never read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.batches import slices
from tamis.shared import col

WIDTH = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


# -- formats ------------------------------------------------------------------


def pack(data: bytes, width: int = WIDTH) -> bytes:
    """Bytes as the samples of a raw PGM, padded with zeros to whole rows (one at least)."""
    rows = max(1, -(-len(data) // width))
    return b"P5\n%d %d\n255\n" % (width, rows) + data.ljust(rows * width, b"\0")


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """Samples of a PBM, PGM or PPM as (rows, columns, channels), and their maximum; black bits are 0, white 255."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        token = _TOKEN.match(data, at)
        if token is None:
            raise ValueError("the header ends early")
        fields.append(int(token[1]))
        at = token.end()
    width, height = fields[:2]
    most = fields[2] if len(fields) > 2 else 255
    if width < 1 or height < 1 or not 1 <= most <= 65535:
        raise ValueError("sizes out of range")
    channels = 3 if kind in (b"P3", b"P6") else 1
    count, stride = width * height * channels, -(-width // 8)
    raw_bytes = {b"P4": stride * height, b"P5": count, b"P6": count}.get(kind)
    if raw_bytes is None:
        if count > len(data) - at:  # a plain sample has one byte at least
            raise ValueError("the image ends early")
    elif raw_bytes * (2 if most > 255 else 1) > len(data) - at - 1:
        raise ValueError("the image ends early")
    if kind == b"P4":
        raw = np.frombuffer(data, np.uint8, raw_bytes, at + 1).reshape(height, stride)
        return np.where(np.unpackbits(raw, axis=1)[:, :width], 0, 255).astype(np.uint8)[:, :, None], most
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:count], np.uint8)
        if ((bits != ord("0")) & (bits != ord("1"))).any():
            raise ValueError("a bit is neither 0 nor 1")
        flat = np.where(bits == ord("1"), 0, 255).astype(np.uint8)
    elif kind in (b"P2", b"P3"):
        samples = [int(w) for w in re.sub(rb"#[^\n]*\n", b"\n", data[at:]).split()[:count]]
        if samples and not 0 <= min(samples) <= max(samples) <= most:
            raise ValueError("a sample is out of range")
        flat = np.array(samples, dtype=np.uint16 if most > 255 else np.uint8)
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count, at + 1)
        if most not in (255, 65535) and flat.max() > most:
            raise ValueError("a sample is out of range")
    if len(flat) != count:
        raise ValueError("the image ends early")
    return flat.reshape(height, width, channels), most


def decode_bmp(data: bytes) -> np.ndarray:
    """Samples of an uncompressed BMP as (rows from the top, columns, channels in RGB order)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    offset, header = struct.unpack_from("<II", data, 10)
    width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or depth not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError("this kind of BMP is not supported")
    stride, height_ = (width * depth // 8 + 3) // 4 * 4, abs(height)
    if offset + stride * height_ > len(data):
        raise ValueError("the image ends early")
    rows = np.frombuffer(data, np.uint8, stride * height_, offset).reshape(height_, stride)
    rows = rows[:, : width * depth // 8].reshape(height_, width, depth // 8)
    rows = rows if height < 0 else rows[::-1]
    if depth == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        if colours > 256 or 14 + header + 4 * colours > len(data) or rows.max() >= colours:
            raise ValueError("a palette out of range")
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(colours, 4)[:, 2::-1]
        return palette[rows[:, :, 0]]
    return rows[:, :, 2::-1]


def samples_of(data: bytes) -> tuple[np.ndarray, int]:
    """The samples of an image, and the largest value that its format allows them."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def decode(data: bytes) -> np.ndarray:
    return samples_of(data)[0]


# -- features -----------------------------------------------------------------


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over the exact areas of a ``rows`` by ``columns`` grid, as float64, for each channel."""

    def reduce(values: np.ndarray, n: int) -> np.ndarray:
        """Along the first axis: differences of the integral at the borders, interpolated inside a pixel."""
        integral = np.zeros((len(values) + 1, *values.shape[1:]))
        np.cumsum(values, axis=0, out=integral[1:])
        border = np.arange(n + 1) * (len(values) / n)
        whole = np.minimum(border.astype(np.int64), len(values) - 1)
        part = (border - whole).reshape(-1, *[1] * (values.ndim - 1))
        at = integral[whole] + part * values[whole]
        return (at[1:] - at[:-1]) / (len(values) / n)

    tall = reduce(image.astype(np.float64), rows)
    return reduce(tall.swapaxes(0, 1), columns).swapaxes(0, 1)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 8 grey areas is darker than its right neighbour."""
    small = area_resize(image.astype(np.float64).mean(axis=2, keepdims=True), 8, 9)[:, :, 0]
    bits = np.round(small[:, 1:], 6) > np.round(small[:, :-1], 6)
    return np.packbits(bits).tobytes().hex()


def tile(image: np.ndarray, side: int, most: int = 255) -> bytes:
    """The image area-resized to a square of 8-bit samples, ``most`` as 255, in NPY format, row by row."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.rint(np.round(area_resize(image, side, side) * (255 / most), 6)).astype(np.uint8)))
    return out.getvalue()


# -- operators ----------------------------------------------------------------


def tiles(media: DataFrame, side: int = 32, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """For each row: ``doc_id``, ``rows``, ``columns``, ``channels``, the NPY ``tile`` and the ``dhash``."""
    source = media.select(col(id_col).alias("doc_id"), col(media_col).alias("media"))
    key_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for data in part.column("media").to_pylist():
                try:
                    image, most = samples_of(data or b"")
                except (ValueError, struct.error):
                    rows.append((None,) * 5)
                    continue
                rows.append((*image.shape, tile(image, side, most), difference_hash(image)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *arrays], names=["doc_id", "rows", "columns", "channels", "tile", "dhash"]
            )

    return source.mapInArrow(run, f"doc_id {key_type}, rows int, columns int, channels int, tile binary, dhash string")


def write_tiles(tiled: DataFrame, path: str) -> None:
    """The ``tile`` column and the hashes as Parquet, where any executor's attempt can be repeated."""
    tiled.write.mode("overwrite").parquet(path)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``media``: each text's bytes as a raw PGM."""
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            stored = [pack((t or "").encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "media": pa.array(stored, pa.binary())})

    return source.mapInArrow(run, f"doc_id {key_type}, media binary")


def media_digests(docs: DataFrame, side: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as media, read back from the stored bytes, with digests and features.

    One pass over each text does what :func:`text_media` and :func:`tiles` do; ``feature`` is the difference hash
    and the first 16 digits of the NPY tile's SHA-256.
    """
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()
    fields = [
        ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ]

    def row(text: str | None) -> tuple:
        data = (text or "").encode()
        stored = pack(data)
        image = decode(stored)
        payload = image.tobytes()
        feature = f"{difference_hash(image)}:{hashlib.sha256(tile(image, side)).hexdigest()[:16]}"
        return (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
            len(stored), hashlib.sha256(stored).hexdigest(), feature,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = zip(*[row(t) for t in part.column("text").to_pylist()], strict=True)
            arrays = [pa.array(x, t) for x, (_, t) in zip(rows, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *[n for n, _ in fields]])

    return source.mapInArrow(
        run,
        f"doc_id {key_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string",
    )

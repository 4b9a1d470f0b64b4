"""Operator 8: Netpbm and BMP columns decoded to numpy arrays, resized by integral images, cut into NPY tiles.

A payload is stored as a binary PPM or BMP, decoded again from its bytes alone, shrunk by exact area averages
(differences of a summed-area table), written as NPY tiles and hashed by horizontal differences. All of it is one
map over the rows. Work on an image is done in bands of rows, so that memory besides the image's own
bytes does not grow with it.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import map_rows
from kgloom.session import table

WIDTH = 64
ROW = 3 * WIDTH
BAND = 4096
_HEAD = re.compile(rb"(P[1-6])((?:\s|#[^\n]*\n)+)")
_NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def to_ppm(pixels: np.ndarray) -> bytes:
    """A height x width x 3 array of bytes as P6, or a height x width one as P5."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def to_bmp(pixels: np.ndarray) -> bytes:
    """A height x width x 3 array as an uncompressed 24-bit BMP, top row first (negative height)."""
    h, w = pixels.shape[:2]
    pad = -3 * w % 4
    rows = np.zeros((h, 3 * w + pad), np.uint8)
    rows[:, : 3 * w] = pixels[:, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(media: bytes) -> np.ndarray:
    """Array of uint8 (height, width[, 3]) or, above 255 grey levels, uint16. ValueError where the bytes are no image."""
    if media[:2] == b"BM":
        return _bmp(media)
    m = _HEAD.match(media)
    if not m:
        raise ValueError("neither Netpbm nor BMP")
    kind, at, numbers = m[1], m.end(1), []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        n = _NUMBER.match(media, at)
        if not n:
            raise ValueError("Netpbm header is cut off")
        numbers.append(int(n[1]))
        at = n.end()
    w, h, top = (*numbers, 1)[:3]
    deep, shape = 3 if kind in (b"P3", b"P6") else 1, (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    if not 0 < top < 65536:
        raise ValueError("Netpbm maximum out of range")
    if kind == b"P4":
        wide = (w + 7) // 8
        if len(media) < at + 1 + h * wide:
            raise ValueError("Netpbm data is cut off")
        bits = np.unpackbits(np.frombuffer(media, np.uint8, h * wide, at + 1).reshape(h, wide), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind == b"P1":
        bits = re.findall(rb"[01]", re.sub(rb"#[^\n]*\n", b"", media[at:]))
        if len(bits) < h * w:
            raise ValueError("Netpbm data is cut off")
        return (1 - np.array(bits[: h * w]).astype(np.uint8).reshape(shape)) * np.uint8(255)
    if kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*\n", b"", media[at:]).split()[: h * w * deep], dtype=np.int64)
        if len(values) < h * w * deep:
            raise ValueError("Netpbm data is cut off")
        return values.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)
    kind_of = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
    if len(media) < at + 1 + h * w * deep * kind_of.itemsize:
        raise ValueError("Netpbm data is cut off")
    out = np.frombuffer(media, kind_of, h * w * deep, at + 1).reshape(shape)
    return out.astype(np.uint16) if top > 255 else out


def _bmp(media: bytes) -> np.ndarray:
    try:
        start = struct.unpack_from("<I", media, 10)[0]
        _, w, h, _, bits, packed, _, _, _, used, _ = struct.unpack_from("<IiiHHIIiiII", media, 14)
    except struct.error:
        raise ValueError("BMP header is cut off") from None
    if packed or bits not in (8, 24, 32) or w <= 0 or not h:
        raise ValueError("this kind of BMP is not read")
    line = (w * bits + 31) // 32 * 4
    if len(media) < start + line * abs(h):
        raise ValueError("BMP data is cut off")
    rows = np.frombuffer(media, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    if bits == 8:
        colours = np.frombuffer(media, np.uint8, 4 * (used or 256), 14 + 40).reshape(-1, 4)[:, 2::-1]
        rows = colours[rows]
    else:
        rows = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return rows if h < 0 else rows[::-1]


def grey_of(band: np.ndarray) -> np.ndarray:
    """Means over the channels, as float64; sums of a long last axis' slices are faster than numpy's over a short one."""
    if band.ndim == 2:
        return band.astype(np.float64)
    total = band[:, :, 0].astype(np.float64)
    for c in range(1, band.shape[2]):
        total += band[:, :, c]
    return total / band.shape[2]


def area_resize(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Grey area averages (float64) on a high x wide grid, exact for fractional cells.

    The mean of a cell is a difference of the summed-area table at its corners, interpolated between whole
    pixels. The table is cumulated over columns and then, band by band, over rows.
    """
    h, w = pixels.shape[:2]
    x = np.arange(wide + 1) * (w / wide)
    y = np.arange(high + 1) * (h / high)
    xi, yi = np.minimum(x.astype(int), w - 1), np.minimum(y.astype(int), h - 1)
    whole = w % wide == 0
    at = np.zeros((high + 1, wide + 1))
    total = np.zeros(wide + 1)
    for top in range(0, h, BAND):
        band = pixels[top : top + BAND]
        grey = grey_of(band)
        across = np.zeros((len(grey), w + 1))
        np.cumsum(grey, axis=1, out=across[:, 1:])
        across = across[:, x.astype(int)] if whole else across[:, xi] + (x - xi) * (across[:, xi + 1] - across[:, xi])
        down = np.vstack([total, total + np.cumsum(across, axis=0)])
        k = np.flatnonzero((yi >= top) & (yi < top + len(grey)))
        i = yi[k] - top
        at[k] = down[i] + (y[k] - yi[k])[:, None] * (down[i + 1] - down[i])
        total = down[-1]
    return np.diff(np.diff(at, axis=0), axis=1) / ((h / high) * (w / wide))


def difference_hash(pixels: np.ndarray, size: int = 8) -> str:
    """64 bits as hex: whether each cell of an 8 x 9 shrink is brighter than its left neighbour."""
    cells = np.round(area_resize(pixels, size, size + 1), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


@lru_cache(256)
def _npy_head(dtype: str, shape: tuple[int, ...]) -> bytes:
    np.save(buffer := io.BytesIO(), np.empty(shape, dtype))
    head = buffer.getvalue()
    return head[: 10 + int.from_bytes(head[8:10], "little")]


@lru_cache(256)
def _npy_fields(head: bytes) -> tuple[tuple[int, ...], bool, np.dtype]:
    return np.lib.format.read_array_header_1_0(io.BytesIO(head[8:]))


def to_npy(array: np.ndarray) -> bytes:
    """An NPY file (version 1.0, C order)."""
    return _npy_head(array.dtype.str, array.shape) + array.tobytes()


def from_npy(data: bytes) -> np.ndarray:
    """The array of an NPY file of version 1.0; heads that were met before are not read again."""
    n = 10 + int.from_bytes(data[8:10], "little")
    shape, by_column, kind = _npy_fields(data[:n])
    return np.frombuffer(data, kind, offset=n).reshape(shape, order="F" if by_column else "C")


def npy_tiles(pixels: np.ndarray, side: int = WIDTH) -> list[bytes]:
    """NPY files of side x side tiles, row by row; tiles at the right and lower edges are smaller."""
    h, w = pixels.shape[:2]
    return [to_npy(pixels[top : top + side, left : left + side]) for top in range(0, h, side) for left in range(0, w, side)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and the bytes with spaces up to a positive multiple of a pixel row."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b" " * (-len(raw) % ROW if raw else ROW)


def shrunk(pixels: np.ndarray, high: int = WIDTH, wide: int = WIDTH) -> np.ndarray:
    """Grey area averages of an image, rounded to the image's own kind of integer."""
    return np.clip(np.round(area_resize(pixels, high, wide)), 0, 65535).astype(np.uint16 if pixels.dtype == np.uint16 else np.uint8)


def tile_table(df: DataFrame, media: str, key: str, high: int = WIDTH, wide: int = WIDTH) -> DataFrame:
    """(key, tile long, npy binary, dhash): images of binary column media, resized to high x wide grey and tiled.

    Rows with null, empty or unreadable media have no tile; repeated rows are tiled each; an empty table gives no rows.
    """

    def make():
        def work(x: dict) -> dict:
            out: dict[str, list] = {key: [], "tile": [], "npy": [], "dhash": []}
            for k, m in zip(x[key], x[media]):
                try:
                    pixels = decode(bytes(m)) if m is not None else None
                except ValueError:
                    pixels = None
                if pixels is None or not pixels.size:
                    continue
                for i, t in enumerate(npy_tiles(shrunk(pixels, high, wide))):
                    for c, v in zip(out, (k, i, t, difference_hash(pixels))):
                        out[c].append(v)
            return out

        return work

    return map_rows(df.select(key, media), make, f"{key} {df.schema[key].dataType.simpleString()}, tile long, npy binary, dhash string")


def stored(payload: bytes) -> bytes:
    """The payload as an image 64 pixels wide: BMP where its CRC-32 is odd, else P6. Both hold every byte."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return to_bmp(pixels) if zlib.crc32(payload) & 1 else to_ppm(pixels)


#: Columns of text_media().
MEDIA = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "media_kind": "string", "tiles": "long", "tiles_sha256": "string"}


def text_media(docs: DataFrame) -> DataFrame:
    """Columns MEDIA of every whole text stored as an image and read back from its bytes.

    The image is shrunk to 64 x 64 and written as NPY tiles, of which this is one; `tiles` counts them and tiles_sha256 is the
    digest of their bytes in order. feature is the difference hash of what is read back from the tile. Null and empty texts are one row of
    spaces; equal texts give equal values; repeated rows have a row each; a null doc_id stays null; an empty table gives no
    rows. Columns but doc_id and text are not read, so none can clash.
    """

    def make():
        def work(x: dict) -> dict:
            out: dict[str, list] = {c: [] for c in MEDIA}
            for i, t in zip(x["doc_id"], x["text"]):
                n, payload = payload_of(t)
                media = stored(payload)
                pixels = decode(media)
                back = pixels.tobytes()
                tiles = npy_tiles(shrunk(pixels))
                row = (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(from_npy(tiles[0])), "bmp" if media[:2] == b"BM" else "ppm", len(tiles), hashlib.sha256(b"".join(tiles)).hexdigest())
                for c, v in zip(MEDIA, row):
                    out[c].append(v)
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, ", ".join(f"{c} {t}" for c, t in MEDIA.items()))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEDIA of every row of documents; odd cases are those of text_media()."""
    return text_media(table(spark, sf_dir, "documents"))

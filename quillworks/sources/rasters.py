"""Uncompressed image files as rows of pixels; files that cannot be read are rows with an error."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

IMAGE = "image_id string, height int, width int, channels int, data binary, error string"
_HEAD = re.compile(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def bitmap(content: bytes) -> np.ndarray:
    """A BMP without compression: 24 or 32 bits, or 8 bits with a table of colours. Rows come from the top, colours as red, green, blue."""
    start, head, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", content)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"a bitmap of {bits} bits with compression {packed}")
    rows, line = abs(height), (width * bits // 8 + 3) // 4 * 4
    if width <= 0 or not rows or len(content) < start + line * rows:
        raise ValueError("the file ends before its pixels")
    pixels = np.frombuffer(content, np.uint8, line * rows, start).reshape(rows, line)[:, : width * bits // 8]
    pixels = pixels if height < 0 else pixels[::-1]
    if bits == 8:
        used = struct.unpack_from("<46xI", content)[0] or 256
        return np.frombuffer(content, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1][pixels]
    return pixels.reshape(rows, width, bits // 8)[:, :, 2::-1]


def netpbm(content: bytes) -> np.ndarray:
    """A binary PGM (grey) or PPM (red, green, blue) of one byte a value."""
    found = _HEAD.match(content)
    if not found or int(found[4]) > 255:
        raise ValueError("not a graymap or pixmap of single bytes")
    width, height, depth = int(found[2]), int(found[3]), 1 if found[1] == b"5" else 3
    if len(content) - found.end() < width * height * depth or not width * height:
        raise ValueError("the file ends before its pixels")
    return np.frombuffer(content, np.uint8, width * height * depth, found.end()).reshape(height, width, depth)


#: By what a file starts with.
READERS: dict[bytes, Callable[[bytes], np.ndarray]] = {b"BM": bitmap, b"P5": netpbm, b"P6": netpbm}


def decoded(files: DataFrame, key: str = "path", content: str = "content", readers: dict[bytes, Callable[[bytes], np.ndarray]] | None = None, swap: bool = False) -> DataFrame:
    """(image_id, height, width, channels, data, error) of each file, as scan_folder or a stream has them: pixels row by row, or why there are none.

    Files are told by their first bytes; ``readers`` adds decoders for others, which give (height, width, channels) arrays. ``swap`` gives colours as blue, green, red.
    Files without a reader, cut short, empty or null have an error and no pixels. A file has to fit a row, as Spark's own reader of files asks. No file moves between tasks.
    """
    known = {**READERS, **(readers or {})}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if not raw:
                        raise ValueError("an empty file")
                    reader = next((f for start, f in known.items() if raw.startswith(start)), None)
                    if reader is None:
                        raise ValueError("no reader for this kind of file")
                    pixels = reader(raw)
                    if swap and pixels.shape[2] == 3:
                        pixels = pixels[:, :, ::-1]
                    out.append((name, *pixels.shape, pixels.tobytes(), None))
                except Exception as e:  # an outside reader may raise anything; the row says what
                    out.append((name, None, None, None, None, str(e) or type(e).__name__))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["image_id", "height", "width", "channels", "data", "error"])

    return files.selectExpr(f"cast(`{key}` as string) as image_id", f"cast(`{content}` as binary) as content").mapInArrow(read, IMAGE)

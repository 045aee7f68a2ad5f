"""Picture formats by their first bytes, with width and height where the header tells them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: How each format starts.
_STARTS = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"\xd7\xcd\xc6\x9a", "wmf"), (b"\x01\0\x09\0", "wmf"), (b"\0\0\0\x0cjP  ", "jpeg2000"))


def sniff(data: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height)."""
    kind = next((k for start, k in _STARTS if data.startswith(start)), None)
    try:
        if kind == "png":
            return kind, *struct.unpack_from(">II", data, 16)
        if kind == "gif":
            return kind, *struct.unpack_from("<HH", data, 6)
        if kind == "bmp":
            if struct.unpack_from("<I", data, 14)[0] == 12:
                return kind, *struct.unpack_from("<HH", data, 18)
            width, height = struct.unpack_from("<ii", data, 18)
            return kind, width, abs(height)
        if kind == "jpeg":
            return kind, *_jpeg(data)
        if kind == "tiff":
            return kind, *_tiff(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return "webp", None, None
        if data[:4] == b"\1\0\0\0" and data[40:44] == b" EMF":
            x0, y0, x1, y1 = struct.unpack_from("<4i", data, 8)
            return "emf", x1 - x0 + 1, y1 - y0 + 1
    except (struct.error, IndexError):
        return kind, None, None
    if kind is None and data.lstrip()[:5] in (b"<?xml", b"<svg ") and b"<svg" in data[:1024]:
        return "svg", None, None
    return kind, None, None


def _jpeg(data: bytes) -> tuple[int | None, int | None]:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None, None
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + size
    return None, None


def _tiff(data: bytes) -> tuple[int | None, int | None]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", data, at + 2 + 12 * k)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0]
    return found.get(256), found.get(257)


def formats(files: DataFrame) -> DataFrame:
    """path, format, width, height of files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sniff(bytes(c or b"")) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "format": [f for f, _, _ in found], "width": pd.array([w for _, w, _ in found], "Int32"), "height": pd.array([h for _, _, h in found], "Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, format string, width int, height int")

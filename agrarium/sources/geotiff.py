"""Headers and windows of GeoTIFF files that aren't compressed, read in Arrow batches next to the data."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the format: sizes of field types, and the tags that are read.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, FORMAT, SCALE, TIEPOINT, KEYS = 256, 257, 258, 259, 273, 277, 278, 339, 33550, 33922, 34735
KINDS = {(1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (2, 16): "int16", (2, 32): "int32", (3, 32): "float32", (3, 64): "float64"}
METADATA = "path string, width int, height int, bands int, dtype string, compression int, crs string, left double, top double, pixel_x double, pixel_y double, error string"


def tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(f"{order}H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(f"{order}I", raw[4:8])
    (n,) = struct.unpack(f"{order}H", raw[at : at + 2])
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in CODES:
            continue
        size = SIZES[kind] * count
        start = at + 10 + 12 * i
        if size > 4:
            (start,) = struct.unpack(f"{order}I", raw[start : start + 4])
        found[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", raw[start : start + size])
    return order, found


def header(raw: bytes) -> dict:
    _, t = tags(raw)
    scale, tie, keys = t.get(SCALE, (0.0, 0.0, 0.0)), t.get(TIEPOINT, (0.0,) * 6), t.get(KEYS, ())
    # Keys come in fours: id, place, count, value; 2048 and 3072 name the system.
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = codes.get(3072) or codes.get(2048)
    kind = KINDS.get((t.get(FORMAT, (1,))[0], t.get(BITS, (8,))[0]))
    return {"width": t[WIDTH][0], "height": t[HEIGHT][0], "bands": t.get(SAMPLES, (1,))[0], "dtype": kind, "compression": t.get(COMPRESSION, (1,))[0], "crs": f"EPSG:{epsg}" if epsg else None, "left": float(tie[3]), "top": float(tie[4]), "pixel_x": float(scale[0]), "pixel_y": float(scale[1])}


def pixels(raw: bytes) -> np.ndarray:
    """(rows, columns, bands) of an image stored in plain strips."""
    order, t = tags(raw)
    h = header(raw)
    if h["compression"] != 1 or not h["dtype"] or STRIPS not in t:
        raise ValueError("only plain strips can be read")
    kind = np.dtype(h["dtype"]).newbyteorder(order)
    rows, width, bands = t.get(ROWS, (h["height"],))[0], h["width"], h["bands"]
    parts = [np.frombuffer(raw, kind, min(rows, h["height"] - i * rows) * width * bands, at) for i, at in enumerate(t[STRIPS])]
    return np.concatenate(parts).reshape(h["height"], width, bands)


def window(image: np.ndarray, row: int, col: int, size: int, band: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A square about a pixel, NaN outside the image, and the mask of valid cells."""
    out = np.full((size, size), np.nan, np.float32)
    top, left = row - size // 2, col - size // 2
    r0, r1, c0, c1 = max(top, 0), min(top + size, image.shape[0]), max(left, 0), min(left + size, image.shape[1])
    if r0 >= r1 or c0 >= c1:
        raise ValueError("the window is outside the image")
    out[r0 - top : r1 - top, c0 - left : c1 - left] = image[r0:r1, c0:c1, band]
    return out, np.isfinite(out)


def _mapped(files: DataFrame, columns: list[str], schema: str, of: Callable[[dict], dict]) -> DataFrame:
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    rows.append(of(r) | {"path": r["path"], "error": None})
                except (ValueError, KeyError, struct.error, IndexError) as e:
                    rows.append({"path": r["path"], "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(*columns).mapInArrow(run, schema)


def metadata(files: DataFrame) -> DataFrame:
    """Header fields of binary files (path, content); unreadable ones have an error."""
    return _mapped(files, ["path", "content"], METADATA, lambda r: header(r["content"]))


def patches(files: DataFrame, size: int) -> DataFrame:
    """Patches of files (path, content, lon, lat): values and mask about the pixel that holds the place."""

    def of(r: dict) -> dict:
        raw = r["content"]
        h = header(raw)
        row, col = int(np.floor((h["top"] - r["lat"]) / h["pixel_y"])), int(np.floor((r["lon"] - h["left"]) / h["pixel_x"]))
        values, mask = window(pixels(raw), row, col, size)
        return {"values": np.where(mask, values, 0).astype(float).tolist(), "mask": mask.tolist()}

    return _mapped(files, ["path", "content", "lon", "lat"], "path string, values array<array<double>>, mask array<array<boolean>>, error string", of)

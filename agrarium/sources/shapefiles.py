"""Shapefiles of polygons as a data source: read in parts by record offsets, written as one set of files a task.

Format ``shapefile``; rows are (record int, rings array<array<array<double>>>,
properties map<string,string>). A path is a ``.shp`` file or a folder of such;
any place that pyarrow's file systems reach.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "record int, rings array<array<array<double>>>, properties map<string,string>"

#: Fixed values of the format: file code, version, shape types of polygons (plain, with Z, with M), header's length, longest text and name of a field.
CODE, VERSION, POLYGONS, HEAD, LONGEST, NAME = 9994, 1000, (5, 15, 25), 100, 254, 10


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (arrow_fs.LocalFileSystem(), path)


def _bytes(files: arrow_fs.FileSystem, path: str, start: int = 0, length: int | None = None) -> bytes:
    with files.open_input_file(path) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


@dataclass
class Records(InputPartition):
    """Records ``first`` to ``last`` (exclusive) of the file ``stem``.shp, at these bytes of it."""

    stem: str
    first: int
    last: int
    start: int
    end: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, part: int) -> None:
        self.path, self.part = path, part

    def partitions(self) -> list[Records]:
        """Runs of records of some ``part`` bytes, by the index beside each file."""
        files, path = _place(self.path)
        info = files.get_file_info(path)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else files.get_file_info(arrow_fs.FileSelector(path, recursive=True))
        out = []
        for stem in sorted(f.path[:-4] for f in found if f.is_file and f.path.lower().endswith(".shp")):
            index = np.frombuffer(_bytes(files, f"{stem}.shx", HEAD), ">i4").reshape(-1, 2).astype(np.int64) * 2
            if not len(index):
                continue
            ends = index[:, 0] + index[:, 1] + 8
            run = (index[:, 0] - HEAD) // self.part
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(index)]
            out += [Records(stem, a, b, int(index[a, 0]), int(ends[b - 1])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out or [Records("", 0, 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        if partition.first == partition.last:
            return
        files, _ = _place(self.path)
        data = _bytes(files, f"{partition.stem}.shp", partition.start, partition.end - partition.start)
        at = 0
        for i, properties in enumerate(_fields(files, partition.stem, partition.first, partition.last)):
            _, words = struct.unpack_from(">ii", data, at)
            if properties is not None:
                yield partition.first + i, _rings(data[at + 8 : at + 8 + words * 2]), properties
            at += 8 + words * 2


def _rings(shape: bytes) -> list[list[list[float]]] | None:
    """The rings of a polygon; None for other shapes and for none."""
    if struct.unpack_from("<i", shape)[0] not in POLYGONS:
        return None
    parts, points = struct.unpack_from("<ii", shape, 36)
    starts = np.frombuffer(shape, "<i4", parts, 44)
    xy = np.frombuffer(shape, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return [r.tolist() for r in np.split(xy, starts[1:])]


def _fields(files: arrow_fs.FileSystem, stem: str, first: int, last: int) -> Iterator[dict[str, str] | None]:
    """The attributes of a run of records as text; None for a record that is marked as deleted, blanks are null."""
    if files.get_file_info(f"{stem}.dbf").type == arrow_fs.FileType.NotFound:
        yield from ({} for _ in range(first, last))
        return
    kind = "utf-8"
    if files.get_file_info(f"{stem}.cpg").is_file:
        kind = _bytes(files, f"{stem}.cpg").decode("ascii", "ignore").strip() or kind
    head, size = struct.unpack_from("<HH", _bytes(files, f"{stem}.dbf", 8, 4))
    about = _bytes(files, f"{stem}.dbf", 32, head - 33)
    fields = [(about[i : i + 11].split(b"\0")[0].decode(kind, "replace"), about[i + 16]) for i in range(0, len(about) // 32 * 32, 32)]
    rows = _bytes(files, f"{stem}.dbf", head + first * size, (last - first) * size)
    for at in range(0, (last - first) * size, size):
        if rows[at : at + 1] == b"*":
            yield None
            continue
        values, place = {}, at + 1
        for name, width in fields:
            values[name] = rows[place : place + width].decode(kind, "replace").strip(" \0") or None
            place += width
        yield values


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShapefileWriter(DataSourceWriter):
    """Each task writes its rows as one set of files beside the place, which the commit moves there; a task that runs again leaves nothing in it."""

    def __init__(self, path: str, columns: list[str]) -> None:
        if not {"rings", "properties"} <= set(columns):
            raise ValueError("rows must have rings and properties")
        self.path, self.staged = path, f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, path = _place(self.path)
        rows = list(iterator)  # a file is written from its lengths and box on
        if not rows:
            return Written([])
        files.create_dir(f"{path}/{self.staged}")
        stem = uuid.uuid4().hex
        made = {**dict(zip(("shp", "shx"), _shapes(rows), strict=True)), "dbf": _table(rows), "cpg": b"UTF-8"}
        for end, data in made.items():
            with files.open_output_stream(f"{path}/{self.staged}/{stem}.{end}") as f:
                f.write(data)
        return Written([f"{stem}.{end}" for end in made])

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _place(self.path)
        files.create_dir(path)
        for name in (n for m in messages if m for n in m.names):
            files.move(f"{path}/{self.staged}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, path = _place(self.path)
        if files.get_file_info(f"{path}/{self.staged}").type == arrow_fs.FileType.Directory:
            files.delete_dir(f"{path}/{self.staged}")


def _shapes(rows: list[Row]) -> tuple[bytes, bytes]:
    """The file of shapes and its index."""
    body, index, boxes = io.BytesIO(), io.BytesIO(), []
    for i, row in enumerate(rows):
        rings = [np.asarray(r, "<f8")[:, :2] for r in row["rings"] or [] if len(r)]
        if rings:
            xy = np.concatenate(rings)
            box = [*xy.min(axis=0), *xy.max(axis=0)]
            boxes.append(box)
            starts = np.cumsum([0, *(len(r) for r in rings[:-1])]).astype("<i4")
            shape = struct.pack("<i4dii", 5, *box, len(rings), len(xy)) + starts.tobytes() + xy.tobytes()
        else:
            shape = struct.pack("<i", 0)
        index.write(struct.pack(">ii", (HEAD + body.tell()) // 2, len(shape) // 2))
        body.write(struct.pack(">ii", i + 1, len(shape) // 2) + shape)
    whole = np.array(boxes) if boxes else np.zeros((1, 4))
    box = [*whole[:, :2].min(axis=0), *whole[:, 2:].max(axis=0)]
    head = lambda n: struct.pack(">7i", CODE, 0, 0, 0, 0, 0, (HEAD + n) // 2) + struct.pack("<ii8d", VERSION, 5, *box, 0, 0, 0, 0)
    return head(body.tell()) + body.getvalue(), head(index.tell()) + index.getvalue()


def _table(rows: list[Row]) -> bytes:
    """The attributes as a table of texts."""
    texts = [{k: (v or "").encode() for k, v in (row["properties"] or {}).items()} for row in rows]
    names = sorted({k for t in texts for k in t})
    widths = {n: max(1, *(len(t.get(n, b"")) for t in texts)) for n in names}
    if wrong := [n for n in names if widths[n] > LONGEST or len(n.encode()) > NAME]:
        raise ValueError(f"names of more than {NAME} bytes or texts of more than {LONGEST}: {wrong}")
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([widths[n], 0]) + bytes(14) for n in names)
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(fields), 1 + sum(widths.values()))
    return head + fields + b"\r" + b"".join(b" " + b"".join(t.get(n, b"").ljust(widths[n]) for n in names) for t in texts) + b"\x1a"


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], int(self.options.get("partBytes", 16 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapefileWriter:
        if overwrite:
            raise ValueError("shapefiles are appended to a folder, never overwritten")
        return ShapefileWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)

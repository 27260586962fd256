"""Row-wise Arrow functions, row keys and packed texts that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrarium.operators.lineage import saved  # noqa: F401


def flat_map(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, batch: int = 20_000) -> DataFrame:
    """Rows that a function yields for each row of ``df``.

    ``make()`` runs once per task and returns the function, which takes the
    row's columns in order. At most ``batch`` rows are held before they leave.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, held = make(), []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                held.extend(each(*row))
                if len(held) >= batch:
                    yield table_of(held, arrow)
                    held = []
        if held:
            yield table_of(held, arrow)

    return df.mapInArrow(run, schema)


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make()`` returned for ``key``, kept by a Python worker from task to task until another key is asked for: one thing at a time, as workers serve stage after stage."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Memo(dict):
    """``of(key)`` by key, remembered for up to ``most`` keys of up to ``longest`` characters or bytes; the older half goes when they are full."""

    def __init__(self, of: Callable[[Any], Any], most: int, longest: int) -> None:
        super().__init__()
        self.of, self.most, self.longest = of, most, longest

    def __missing__(self, key: Hashable) -> Any:
        found = self.of(key)
        if len(key) <= self.longest:
            self.trim()
            self[key] = found
        return found

    def trim(self) -> None:
        if len(self) >= self.most:
            for key in list(islice(self, (self.most + 1) // 2)):
                del self[key]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrays_of(columns: Iterable[Any], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of whole columns (NumPy arrays or lists)."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


KEY = ["row_key", "row_key2"]


def row_hashes() -> tuple[F.Column, F.Column]:
    """128 bits of (doc_id, text): equal rows share them, rows with null or repeated ids but other texts don't."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")


def with_row_key(docs: DataFrame) -> DataFrame:
    """(row_key, row_key2, doc_id, text)."""
    return docs.select(*(h.alias(k) for h, k in zip(row_hashes(), KEY, strict=True)), "doc_id", "text")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, underlined until ``docs`` has no such columns."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its row key in two more columns, and their names."""
    names = unused(docs, *KEY)
    return docs.withColumns(dict(zip(names, row_hashes(), strict=True))), names


def packed(keyed: DataFrame) -> DataFrame:
    """(row_key, row_key2, doc_id, packed): texts compressed one by one, for shuffles."""

    def make() -> Callable:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        return lambda key, key2, doc_id, text: [(key, key2, doc_id, None if text is None else compress(text.encode()))]

    return flat_map(keyed.select(*KEY, "doc_id", "text"), make, "row_key long, row_key2 long, doc_id long, packed binary", batch=2_000)


def unpacker() -> Callable[[bytes | None], str | None]:
    """Undoes ``packed`` for one text."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return lambda x: None if x is None else expand(x).decode()

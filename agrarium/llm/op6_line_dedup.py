"""Line deduplication across documents.

Hashes of long enough lines are range-partitioned with documents as secondary
sort, so that even a line of all documents spreads over partitions. Each
partition streams its rows: the first document of a line is its largest, and
all later ones lose the line once enough documents are seen. Lines that reach a
partition's edge are settled by sums over the edges, two a partition at most.
Text never moves with the hashes; the result is a compressed keep bitmap for
each document that loses lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrarium.llm.rows import KEY, flat_map, keyed, packed, saved, table_of, unpacker, unused, with_row_key

STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
LINES = "h1 long, h2 long, doc_id long, row_key long, row_key2 long, n_lines int, at array<int>"
SETTLED = "kind int, h1 long, h2 long, doc_id long, row_key long, row_key2 long, n_lines int, at array<int>, docs long"
DROP, OPEN, EDGE = 0, 1, 2


def long_lines(text: str | None, least: int) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and the places of each key of at least ``least`` code points."""
    lines = (text or "").encode().split(b"\n")
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        if len(line) < least:
            continue
        key = line.strip(STRIPPED).lower()
        if len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least:
            found.setdefault(key, []).append(i)
    return len(lines), found


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """A row for each document and key in it, with the key's 128-bit hash."""

    def make() -> Callable:
        from xxhash import xxh3_128_digest

        def each(row_key: int, row_key2: int, doc_id: int | None, text: str | None) -> list[tuple]:
            n, found = long_lines(text, least)
            return [(int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), doc_id, row_key, row_key2, n, at) for key, at in found.items() for h in (xxh3_128_digest(key),)]

        return each

    return flat_map(docs.select(*KEY, "doc_id", "text"), make, LINES)


class Stream:
    """Settles the lines of one sorted partition, row by row, holding fewer than ``docs`` documents."""

    def __init__(self, docs: int) -> None:
        self.most, self.key, self.runs, self.held = docs, None, 0, []

    def row(self, r: tuple) -> list[tuple]:
        out = []
        h1, h2, doc = r[0], r[1], r[2]
        if (h1, h2) != self.key:
            out = self.close(last=False)
            self.key, self.runs, self.seen, self.largest, self.now = (h1, h2), self.runs + 1, 0, doc, object()
        if doc != self.now:
            self.seen, self.now = self.seen + 1, doc
        if self.runs == 1:
            out.append((OPEN, *r, None))
        elif self.seen >= self.most:
            out += [(DROP, *x, None) for x in [*self.held, r] if x[2] != self.largest]
            self.held = []
        else:
            self.held.append(r)
        return out

    def close(self, last: bool) -> list[tuple]:
        """What the run leaves behind; runs at either edge leave their count."""
        out = []
        if self.key is not None and (last or self.runs == 1):
            out = [(OPEN, *x, None) for x in self.held] if last else []
            out.append((EDGE, *self.key, self.largest, None, None, None, None, self.seen))
        self.held = []
        return out


def dropped_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """(row_key, row_key2, n_lines, at) of lines to drop: those found in at least ``documents`` documents, save in the largest doc_id."""
    hashes = saved(line_hashes(docs, least))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    dealt = hashes.repartitionByRange(*order).sortWithinPartitions(*order, *KEY)
    arrow = to_arrow_schema(T._parse_datatype_string(SETTLED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(documents)
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                out += stream.row(r)
            if out:
                yield table_of(out, arrow)
        if out := stream.close(last=True):
            yield table_of(out, arrow)

    settled = saved(dealt.mapInArrow(run, SETTLED))
    edges = settled.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc_id").alias("largest")).where(F.col("docs") >= documents).drop("docs")
    # At most two edges a partition.
    late = settled.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    return settled.where(F.col("kind") == DROP).select(*KEY, "n_lines", "at").unionByName(late.select(*KEY, "n_lines", "at"))


def keep_bitmaps(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """(row_key, row_key2, keep): a compressed bitmap over its lines for each document that loses any."""

    def make() -> Callable:
        def each(row_key: int, row_key2: int, n: int, at: list[list[int]]) -> list[tuple]:
            keep = np.ones(n, bool)
            for x in at:
                keep[x] = False
            return [(row_key, row_key2, zlib.compress(np.packbits(keep).tobytes()))]

        return each

    dropped = dropped_lines(docs, least, documents).groupBy(*KEY).agg(F.first("n_lines").alias("n_lines"), F.collect_list("at").alias("at"))
    return flat_map(dropped, make, "row_key long, row_key2 long, keep binary", batch=5_000)


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the text that stays."""
    lines = (text or "").split("\n")
    if keep is None:
        return len(lines), 0, text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return len(lines), int(len(lines) - bits.sum()), "\n".join(x for x, k in zip(lines, bits.tolist(), strict=True) if k)


def digests(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): lines before dropping, lines dropped, digest of what stays.

    Null or empty text is one empty line. Null ids count as one document below
    all others. Repeated rows count as one document and keep or lose the same
    lines. Other columns are ignored; an empty table gives no rows. Very long
    texts and lines are taken whole.
    """

    def make() -> Callable:
        unpack = unpacker()

        def each(doc_id: int | None, pack: bytes | None, keep: bytes | None) -> list[tuple]:
            n, gone, kept = kept_lines(unpack(pack), keep)
            return [(doc_id, n, gone, hashlib.sha256(kept.encode()).hexdigest())]

        return each

    rows = with_row_key(docs)
    found = packed(rows).join(keep_bitmaps(rows, least, documents), KEY, "left")
    return flat_map(found.select("doc_id", "packed", "keep"), make, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", batch=5_000)


def deduplicated(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """``docs`` with the lines dropped from its text; all columns and rows stay, null texts too."""

    def kept(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else kept_lines(t, k)[2] for t, k in zip(text, keep, strict=True)])

    marked, names = keyed(docs)
    (keep,) = unused(docs, "keep")
    found = keep_bitmaps(with_row_key(docs), least, documents).toDF(*names, keep)
    marked = marked.join(found, names, "left")
    return marked.withColumn("text", F.when(F.col(keep).isNull(), F.col("text")).otherwise(F.pandas_udf(kept, "string")("text", keep))).select(*docs.columns)

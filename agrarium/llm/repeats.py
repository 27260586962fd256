"""Repeated windows of a corpus: sequences of ``window`` units that start more than once.

A window's anchor is the least hash among its grams, the leftmost of equals,
so equal windows share their anchor at the same place. Windows in a row with
one anchor form a segment; a document is the sequence of its segments.

Segments meet by anchor. An anchor that occurs once holds no repeat. A segment
whose whole context occurs again is repeated throughout. Only segments that
share an anchor but not their context, where a repeat begins or ends, have to
be looked into: one occurrence of each context goes to the block of its
anchor, where a function of the operator compares it with every other context.
Contexts of anchors that have too many for one block go to blocks of their own
by what stands around the anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrarium.llm.op4_simhash_dedup import whole_groups
from agrarium.llm.rows import KEY, arrays_of, flat_map, packed, saved, unpacker

BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
SEGMENTS = "row_key long, row_key2 long, anchor long, context long, start int, count int"
DETAILS = "anchor long, deal int, context long, row_key long, row_key2 long, start int, count int, place int, times long, detail binary"
BUCKET, CROWDED = 1 << 13, 8  # rows of a hash bucket on average, and how many times as many are a crowd
COMMON = 1 << 10  # occurrences beyond which a context is joined by itself
PART = 1 << 20  # window starts looked at together


def mix(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any range of a sequence of 64-bit units, by sums of units times powers of an odd base."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, units: np.ndarray, base: int, cache: dict) -> None:
        n = len(units) + 1
        if base not in cache or len(cache[base][0]) < n:
            size = max(n, 1 << 14)
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cache[base] = np.cumprod(up), np.cumprod(down)
        up, self.down = cache[base]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(units * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least, the leftmost of equals."""
    at, span = np.arange(len(values), dtype=np.int32), 1
    low = values

    def joined(shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[shift : shift + n] < low[:n]
        return np.where(right, low[shift : shift + n], low[:n]), np.where(right, at[shift : shift + n], at[:n])

    while 2 * span <= width:
        low, at = joined(span, len(low) - span)
        span *= 2
    if span < width:
        low, at = joined(width - span, len(values) - width + 1)
    return at


def segments(units: np.ndarray, window: int, gram: int, cache: dict) -> tuple[np.ndarray, ...]:
    """(anchor, context, start, count, place) of the segments of a sequence; place is the anchor's, from the segment's start."""
    n = len(units) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    one, two = (Rolling(units, b, cache) for b in BASES)
    grams = one.grams(gram)
    width = window - gram + 1
    parts = []
    for lo in range(0, n, PART):
        hi = min(n, lo + PART)
        at = least_places(grams[lo : hi + width - 1], width) + lo
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.append(start, hi - lo))
        parts.append((at[start], start + lo, count))
    at, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    place = at - start
    context = mix(two.of(start, start + count - 1 + window) ^ mix(place.astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)))
    return grams[at].view(np.int64), context.view(np.int64), start, count, place


def segment_rows(docs: DataFrame, units: Callable[[], Callable[[str | None], np.ndarray]], window: int, gram: int) -> DataFrame:
    arrow = to_arrow_schema(T._parse_datatype_string(SEGMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, cache = units(), {}
        for b in batches:
            held, n = [], 0
            for key, key2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = segments(of(text), window, gram, cache)[:4]
                if len(found[0]):
                    held.append((np.full(len(found[0]), key), np.full(len(found[0]), key2), *found))
                    n += len(found[0])
                if n >= 200_000:
                    yield arrays_of([np.concatenate(x) for x in zip(*held, strict=True)], arrow)
                    held, n = [], 0
            if held:
                yield arrays_of([np.concatenate(x) for x in zip(*held, strict=True)], arrow)

    return docs.select(*KEY, "text").mapInArrow(run, SEGMENTS)


def spans(docs: DataFrame, units: Callable, window: int, gram: int, detail: Callable, compare: Callable[[pa.Table], Iterator[tuple]], parts: Callable[[], tuple[Callable, Callable]], pieces: int, most: int = 1_024) -> DataFrame:
    """(row_key, row_key2, starts, ends): unit ranges that repeated windows cover, for each document that has any.

    ``detail()`` returns a function from (text, [(start, count), ...]) to the
    places of the anchors and binary details of those segments. ``compare``
    takes rows of DETAILS, whole blocks in order, and yields arrays (row_key,
    row_key2, first, last): windows of single contexts that another context of
    the block holds too. ``parts()`` returns functions from a detail to its
    units, and from (detail, start, end) to the detail of a part. At most
    ``most`` contexts meet in a block; an anchor with more is split by content,
    each segment into up to ``pieces``.
    """
    rows = saved(segment_rows(docs, units, window, gram))
    again = saved(_repeated_anchors(rows))
    open_ = again.where("mixed")
    contexts = saved(open_.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "start", "count")).alias("x")).select("anchor", "context", "times", "x.*"))
    # Rows of contexts that are very common don't meet in one task: their few keys are a join of its own, which Spark broadcasts while they are few.
    common = saved(contexts.where(F.col("times") > COMMON).select("anchor", "context", F.lit(True).alias("common")))
    marked = open_.join(common, ["anchor", "context"], "left")
    twice = contexts.where((F.col("times") > 1) & (F.col("times") <= COMMON)).select("anchor", "context")
    rest = marked.where("common IS NULL").join(twice, ["anchor", "context"])
    whole = again.where("NOT mixed").unionByName(marked.where("common").unionByName(rest).drop("common"))
    covered = whole.select(*KEY, F.col("start").alias("first"), (F.col("start") + F.col("count") - 1).alias("last"))
    looked = covered.unionByName(_blocks(docs, contexts, detail, compare, parts, window, gram, pieces, most))
    return looked.groupBy(*KEY).agg(F.collect_list("first").alias("starts"), F.collect_list(F.col("last") + window).alias("ends"))


def _repeated_anchors(rows: DataFrame) -> DataFrame:
    """``rows`` whose anchor occurs again, with ``mixed``: not all of its contexts are equal.

    One shuffle brings an anchor's rows together, but for those of hash buckets
    that hold more than CROWDED times their share of BUCKET rows: there, counts
    are combined before the shuffle and a join, which Spark can split, brings
    them back.
    """
    bits = max(1, min(48, math.ceil(math.log2(max(2, rows.count() / BUCKET)))))
    bucket = F.shiftrightunsigned("anchor", 64 - bits)
    loads = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # At most one bucket in CROWDED; Spark broadcasts the table where it is small.
    crowded = saved(loads.where(F.col("n") > BUCKET * CROWDED).select("bucket"))
    marked = rows.withColumn("bucket", bucket)
    by = Window.partitionBy("anchor")
    calm = marked.join(crowded, "bucket", "left_anti").drop("bucket")
    calm = calm.withColumn("n", F.count("*").over(by)).withColumn("mixed", F.min("context").over(by) != F.max("context").over(by)).where("n > 1").drop("n")
    rest = marked.join(crowded, "bucket", "left_semi").drop("bucket")
    anchors = saved(rest.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1").select("anchor", "mixed"))
    return calm.unionByName(rest.join(anchors, "anchor").select(*calm.columns))


def _blocks(docs: DataFrame, contexts: DataFrame, detail: Callable, compare: Callable, parts: Callable, window: int, gram: int, pieces: int, most: int) -> DataFrame:
    """(row_key, row_key2, first, last) of windows that two contexts of an anchor share.

    Contexts of an anchor with too many go in pieces to other blocks: the
    windows of a piece have a share of the possible places before the anchor,
    so that all hold the units around it that are in every one of them, and
    those units name the block. A block of one context is done; one with too many even so
    has its windows counted by hash, combined before the shuffle.
    """
    crowds = saved(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select("anchor", F.lit(1).alias("crowd")))
    wanted = contexts.join(crowds, "anchor", "left").groupBy(*KEY).agg(F.collect_list(F.struct("anchor", F.coalesce("crowd", F.lit(0)).alias("deal"), "context", "start", "count", "times")).alias("wanted"))

    def make() -> Callable:
        of, unpack, (units, cut) = detail(), unpacker(), parts()
        cache: dict = {}

        def each(key: int, key2: int, pack: bytes | None, wanted_: list) -> list[tuple]:
            out = []
            found = of(unpack(pack), [(w["start"], w["count"]) for w in wanted_])
            for w, (place, d) in zip(wanted_, found, strict=True):
                if not w["deal"]:
                    out.append((w["anchor"], 0, w["context"], key, key2, w["start"], w["count"], place, w["times"], d))
                    continue
                for name, lo, hi in split(units(d), w["anchor"], place, w["count"], window, gram, pieces, cache):
                    out.append((name, 1, w["context"], key, key2, w["start"] + lo, hi - lo, place - lo, w["times"], cut(d, lo, hi - 1 + window)))
            return out

        return each

    details = flat_map(packed(docs).join(wanted, KEY).select(*KEY, "packed", "wanted"), make, DETAILS, batch=10_000)
    if crowds.isEmpty():
        return _compared(details, compare)
    details = saved(details)
    pieced = details.where("deal > 0")
    sizes = saved(pieced.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    sized = pieced.join(sizes, "anchor")
    met = _compared(details.where("deal = 0").unionByName(sized.where(F.col("n") <= most).drop("n")), compare)
    hashed = saved(_window_rows(sized.where(F.col("n") > most), parts, window))
    shared = saved(hashed.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "hash"))
    return met.unionByName(hashed.join(shared, ["anchor", "hash"]).select(*KEY, "first", F.col("first").alias("last")))


def split(units: np.ndarray, anchor: int, place: int, count: int, window: int, gram: int, pieces: int, cache: dict) -> Iterator[tuple[int, int, int]]:
    """(name, first, end) of the pieces of a segment's windows: by shares of the places before the anchor, named by the units that all windows of a piece hold."""
    one, two = (Rolling(units, b, cache) for b in BASES)
    bounds = [q * (window - gram + 1) // pieces for q in range(pieces + 1)]
    for q, (least, end) in enumerate(pairwise(bounds)):
        lo, hi = max(0, place - end + 1), min(count, place - least + 1)
        if lo < hi:
            a, b = np.array([place - least]), np.array([place + window - end + 1])
            held = one.of(a, b) ^ (two.of(a, b) >> np.uint64(1)) ^ mix(np.array([anchor]).astype(np.uint64) + np.uint64(q))
            yield int(mix(held).view(np.int64)[0]), lo, hi


def _compared(details: DataFrame, compare: Callable) -> DataFrame:
    schema = "row_key long, row_key2 long, first int, last int"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1, 20_000):
            for found in compare(t):
                yield arrays_of(found, arrow)

    return details.repartition("anchor").sortWithinPartitions("anchor", "context", *KEY).mapInArrow(run, schema)


def _window_rows(details: DataFrame, parts: Callable, window: int) -> DataFrame:
    """(anchor, hash, row_key, row_key2, first) of each window of each context."""
    schema = "anchor long, hash long, row_key long, row_key2 long, first int"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (units, _), cache = parts(), {}
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                count = columns["count"].to_numpy()
                row = np.repeat(np.arange(len(count)), count)
                first = columns["start"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                own = np.concatenate([window_hashes(units(d), window, cache) for d in columns["detail"].to_pylist()]).view(np.int64)
                yield arrays_of([columns["anchor"].to_numpy()[row], own, *(columns[k].to_numpy()[row] for k in KEY), first], arrow)

    return details.select("anchor", "start", "count", *KEY, "detail").mapInArrow(run, schema)


def window_hashes(units: np.ndarray, window: int, cache: dict) -> np.ndarray:
    one, two = (Rolling(units, b, cache) for b in BASES)
    return mix(one.grams(window) ^ (two.grams(window) >> np.uint64(1)))


def blocks_of(t: pa.Table) -> np.ndarray:
    """A number for each row's block."""
    anchor = t.column("anchor").to_numpy()
    return np.cumsum(np.concatenate(([False], anchor[1:] != anchor[:-1])))


def covered(n: int, starts: list[int] | None, ends: list[int] | None) -> np.ndarray:
    """Which of ``n`` units lie in any of the ranges."""
    if not starts:
        return np.zeros(n, bool)
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, np.asarray(starts), 1)
    np.add.at(steps, np.asarray(ends), -1)
    return np.cumsum(steps[:n]) > 0

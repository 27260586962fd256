"""Hard negatives by threshold joins, as in L2AP.

Rows are packed into blocks of one length. A block's index lists, dimension by
dimension, the rows that are indexed there: a row leaves out its last
dimensions where the norm of what they hold, times the largest such norm of the
anchors, stays below the threshold, so that no pair reaches the threshold by
them alone. Partial scores are accumulated over the indexed dimensions; a pair
goes on only if its partial score and the product of the norms that remain
reach the anchor's threshold, and is then scored whole, in integers.

Thresholds start high, where the moments of the rows let a few times the wanted
number of rows be expected, and are lowered for the anchors whose windows
aren't full, at last to the windows' lower ends. Whatever the first guess was,
results are those of all pairs.

Anchors meet rows in a grid of block groups, grouped together by the grid's cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrarium.llm.rows import arrays_of, flat_map, saved, table_of

ROWS = "row long, size int, vec_id long, label long, vector binary"
BLOCK = "block long, size int, row binary, vec_id binary, known binary, label binary, vector binary, order binary, low binary, high binary, n int"
HITS = "anchor long, window int, row long, vec_id long, score long"
CELLS = 2**18  # components of a block of rows; an eighth of it of a block of anchors
STEP = 8  # dimensions by which indexed parts differ
SLACK, NONE = 1 + 1e-9, np.iinfo(np.int64).min
#: Further thresholds, in standard deviations below the first.
LOWER = (0.0, 1.5)


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(size, vec_id, label, whole): rows with a label and finite components, these as floor(256 x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    kept = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.size("embedding").alias("size"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("whole"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, each with a number of its own, as a written table: (row, size, vec_id, label, vector)."""

    def make() -> Callable:
        at = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))
        return lambda size, vec_id, label, whole: [(next(at), size, vec_id, label, np.array(whole, "<i8").tobytes())]

    return saved(flat_map(rows.select("size", "vec_id", "label", "whole"), make, ROWS, batch=4_000))


def moments(rows: DataFrame) -> DataFrame:
    """(size, n, mean, square): components' means and mean squares by length of vector, summed by each task before they meet."""
    schema = to_arrow_schema(T._parse_datatype_string("size int, d int, n long, x double, xx double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                v = np.frombuffer(b"".join(b.column("vector").filter(pa.array(sizes == size)).to_pylist()), "<i8").reshape(-1, size).astype(float) if size else np.zeros((0, 0))
                held = total.setdefault(size, np.zeros((3, size)))
                held += [np.full(size, len(v)), v.sum(0), (v**2).sum(0)]
        for size, (n, x, xx) in total.items():
            yield arrays_of([np.full(size, size, np.int32), np.arange(size, dtype=np.int32), n.astype(np.int64), x, xx], schema)

    sums = rows.select("size", "vector").mapInArrow(run, "size int, d int, n long, x double, xx double").groupBy("size", "d").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx")))
    ordered = F.array_sort(F.collect_list(F.struct("d", (F.col("x") / F.col("n")).alias("mean"), (F.col("xx") / F.col("n")).alias("square"))))
    return sums.groupBy("size").agg(F.max("n").alias("n"), ordered.alias("m")).select("size", "n", F.col("m.mean").alias("mean"), F.col("m.square").alias("square"))


def guessed(vector: np.ndarray, mean: np.ndarray, square: np.ndarray, share: float, below: float, deviations: float) -> float:
    """A score that about ``share`` of all rows should lie above, among those up to ``below``; less by ``deviations``."""
    middle, spread = float(vector @ mean), math.sqrt(max(1e-9, float(vector**2 @ np.maximum(0, square - mean**2))))
    normal = NormalDist(middle, spread)
    above = max(0.0, 1 - normal.cdf(below)) if math.isfinite(below) else 0.0
    tail = above + share
    return -math.inf if tail >= 1 else normal.inv_cdf(1 - tail) - deviations * spread if tail > 0 else middle


def packed_blocks(rows: DataFrame, cells: int) -> DataFrame:
    """Rows (row, size, vec_id, label, vector[, order, low, high]) in blocks of one length and about ``cells`` components."""
    names = rows.columns
    arrow = to_arrow_schema(T._parse_datatype_string(BLOCK))

    def block(number: int, size: int, held: list[tuple]) -> tuple:
        row, vec_id, label, vector, *more = zip(*held, strict=True)
        order, low, high = (more[0][0], b"".join(more[1]), b"".join(more[2])) if more else (None, None, None)
        ids = np.array([0 if v is None else v for v in vec_id], "<i8").tobytes()
        return number, size, np.array(row, "<i8").tobytes(), ids, np.array([v is not None for v in vec_id]).tobytes(), np.array(label, "<i8").tobytes(), b"".join(vector), order, low, high, len(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 40, {}
        for b in batches:
            for size, *rest in zip(*(b.column(c).to_pylist() for c in ("size", "row", "vec_id", "label", "vector", *names[5:])), strict=True):
                own = held.setdefault(size, [])
                own.append(tuple(rest))
                if len(own) * max(1, size) >= cells:
                    yield table_of([block(number, size, own)], arrow)
                    number, held[size] = number + 1, []
        for size, own in held.items():
            if own:
                yield table_of([block(number, size, own)], arrow)
                number += 1

    return saved(rows.select("row", "size", "vec_id", "label", "vector", *names[5:]).mapInArrow(run, BLOCK))


class Rows:
    """A block of rows or anchors as arrays, dimensions in the anchors' order."""

    def __init__(self, size: int, row: bytes, vec_id: bytes, known: bytes, label: bytes, vector: bytes, order: np.ndarray) -> None:
        self.row, self.vec_id, self.label = (np.frombuffer(x, "<i8") for x in (row, vec_id, label))
        self.known = np.frombuffer(known, bool)
        self.whole = np.frombuffer(vector, "<i8").reshape(len(self.row), size)[:, order]
        self.real = self.whole.astype(float)
        squares = np.cumsum(self.real[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate((squares, np.zeros((len(self.row), 1))), axis=1))  # norm from each dimension on


def reaching(anchors: Rows, rows: Rows, least: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (anchor, row, score) of the same or of different labels with a score of at least ``least[anchor]``, and how many pairs were scored whole."""
    size, bound = rows.whole.shape[1], float(least.min(initial=math.inf))
    live = np.flatnonzero(least < math.inf)
    none = np.zeros(0, np.int64)
    if not len(live):
        return none, none, none, 0
    # Dimensions that need no index: from there on, norms alone stay below the least threshold.
    outside = rows.rest * anchors.rest[live].max(0) * SLACK < bound
    indexed = np.where(outside.any(1), outside.argmax(1), size)
    indexed = np.minimum(-(-indexed // STEP) * STEP, size)
    found = []
    scored = 0
    for p in np.unique(indexed).tolist():
        own = np.flatnonzero(indexed == p)
        if p == 0 and size:
            continue
        partial = anchors.real[live][:, :p] @ rows.real[own][:, :p].T
        reach = partial + anchors.rest[live][:, p, None] * rows.rest[own][None, :, p]
        alike = anchors.label[live][:, None] == rows.label[own][None, :]
        other = anchors.row[live][:, None] != rows.row[own][None, :]
        a, r = np.nonzero((reach + np.abs(reach) * (SLACK - 1) >= least[live][:, None]) & (alike == same) & other)
        a, r = live[a], own[r]
        score = np.zeros(len(a), np.int64)
        pairs = max(1, CELLS * 4 // max(1, size))
        for lo in range(0, len(a), pairs):
            score[lo : lo + pairs] = (anchors.whole[a[lo : lo + pairs]] * rows.whole[r[lo : lo + pairs]]).sum(1)
        scored += len(a)
        good = score >= least[a]
        found.append((a[good], r[good], score[good]))
    return *((np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)), scored


def first_of(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group: by score, then by vec_id, null last."""
    order = np.lexsort((vec_id, ~known, -score, group))
    g = group[order]
    start = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1)) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def threshold_join(anchors: DataFrame, rows: DataFrame, same: bool, k: int, cells: tuple[int, int]) -> DataFrame:
    """(anchor, window, row, vec_id, score): for each window [low, high] of each anchor the ``k`` first rows of each cell of the grid that lie in it.

    Both sides are grouped by the cell and shuffled: a join could send the
    anchors, small in their file but repeated for each column of the grid,
    through the driver, and would repeat each block for each of the other side.
    """
    across, down = cells
    left = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), F.pmod(F.xxhash64("block"), F.lit(down)).cast("int").alias("y"), *("size", "row", "vec_id", "known", "label", "vector", "order", "low", "high"))
    right = rows.select(F.pmod(F.xxhash64("block"), F.lit(across)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"), *("size", "row", "vec_id", "known", "label", "vector"))
    arrow = to_arrow_schema(T._parse_datatype_string(HITS))

    def parts(t: pa.Table) -> Iterator[list]:
        for b in t.to_batches():
            for i in range(b.num_rows):
                yield [b.column(c)[i].as_py() for c in range(2, b.num_columns)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # By anchors' blocks: the first k of the blocks of rows seen so far, as (anchor's place, window, row, vec_id, known, score).
        kept: list[list[np.ndarray]] = []
        asked = []
        for size, *own in parts(left):
            order = np.frombuffer(own[5], "<i8")
            low, high = (np.frombuffer(x, "<f8").reshape(len(own[0]) // 8, -1) for x in own[6:8])
            asked.append((Rows(size, *own[:5], order), order, low, high))
            kept.append([np.zeros(0, kind) for kind in ("<i8", "<i8", "<i8", "<i8", bool, "<i8")])
        for size, *other in parts(right) if asked else ():
            r, of = None, None
            for i, (a, order, low, high) in enumerate(asked):
                if r is None or not np.array_equal(of, order):
                    r, of = Rows(size, *other, order), order
                own, at, score, _ = reaching(a, r, low.min(1), same)
                # Pair by pair all windows that hold it.
                p, w = np.nonzero((score[:, None] >= low[own]) & (score[:, None] <= high[own]))
                now = own[p], w, r.row[at[p]], r.vec_id[at[p]], r.known[at[p]], score[p]
                anchor, window, row, vec_id, known, score = (np.concatenate(x) for x in zip(kept[i], now, strict=True))
                first = first_of(anchor * low.shape[1] + window, score, vec_id, known, k)
                kept[i] = [x[first] for x in (anchor, window, row, vec_id, known, score)]
        found = [arrays_of([a.row[anchor], window.astype(np.int32), row, pa.array(vec_id, mask=~known), score], arrow) for (a, *_), (anchor, window, row, vec_id, known, score) in zip(asked, kept, strict=True)]
        return pa.Table.from_batches(found, schema=arrow)

    keys = ["x", "y", "size"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, HITS)


def with_thresholds(asked: DataFrame, stats: DataFrame, k: int, deviations: float | None) -> DataFrame:
    """Anchors (.., peers, lows, highs), peers being the rows that can be in their windows, with the dimensions' order and each window's bounds for this round, infinite ones for windows that are full."""

    def make() -> Callable:
        def each(row: int, size: int, vec_id: int | None, label: int, vector: bytes, lows: list, highs: list, full: list, peers: int, mean: list | None, square: list | None) -> list[tuple]:
            m, s = np.array(mean or [], float), np.array(square or [], float)
            v = np.frombuffer(vector, "<i8").astype(float)
            order = np.argsort(-s, kind="stable").astype("<i8").tobytes()
            bounds = []
            for low, high, done in zip(lows, highs, full, strict=True):
                if done:
                    bounds.append(math.inf)
                elif deviations is None or not size:
                    bounds.append(low)
                else:
                    bounds.append(max(low, math.floor(guess) if math.isfinite(guess := guessed(v, m, s, 4 * k / max(1, peers), high, deviations)) else -math.inf))
            return [(row, size, vec_id, label, vector, order, np.array(bounds, "<f8").tobytes(), np.array(highs, "<f8").tobytes())]

        return each

    return flat_map(asked.join(stats.drop("n"), "size", "left").select("row", "size", "vec_id", "label", "vector", "lows", "highs", "full", "peers", "mean", "square"), make, f"{ROWS}, order binary, low binary, high binary", batch=2_000)


def filled(asked: DataFrame, blocks: DataFrame, stats: DataFrame, same: bool, k: int, cells: int) -> DataFrame:
    """(anchor, window, rank, row, vec_id, score): the ``k`` first rows of each window of ``asked`` (.., peers, lows, highs), all if there are fewer."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    out: DataFrame | None = None
    asked = asked.withColumn("full", F.zip_with("lows", "highs", lambda lo, hi: lo > hi))
    across = _groups(blocks.count())
    for deviations in (*LOWER, None):
        anchors = packed_blocks(with_thresholds(asked, stats, k, deviations), cells // 8)
        hits = threshold_join(anchors, blocks, same, k, (across, max(1, anchors.count() // 64)))
        ranked = saved(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        counts = ranked.groupBy("anchor", "window").agg(F.count("*").alias("c"))
        if deviations is None:
            return ranked if out is None else out.unionByName(ranked)
        # Full windows are done; the others are asked again, and what they have so far is left.
        done = counts.where(F.col("c") >= k).select("anchor", "window")
        part = ranked.join(done, ["anchor", "window"], "left_semi")
        out = part if out is None else out.unionByName(part)
        windows = done.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("window").alias("now"))
        asked = asked.join(windows, "row", "left").withColumn("full", F.expr("transform(full, (x, i) -> x or coalesce(array_contains(now, i), false))")).drop("now")
        asked = saved(asked.where(F.exists("full", lambda x: ~x)))
        if asked.isEmpty():
            return out
    raise AssertionError


def _groups(blocks: int) -> int:
    """Columns of the grid: blocks apart while they are few, then 64 together, so that anchors travel to fewer places."""
    return max(1, min(blocks, 192), blocks // 64)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``vectors`` (vec_id, embedding, label).

    Components count as floor(256 x), scores are inner products, higher ones
    first, then smaller vec_id, null last. An anchor's ``positives`` are its
    first other rows of its label; for each, the first ``negatives`` rows of
    other labels with low * positive <= 100 * negative <= high * positive are
    returned; fewer where there are fewer, no row where there are none.

    Rows with a null label or vector or a null or non-finite component take no
    part. Repeated rows count each on its own, as anchors, positives and
    negatives. Vectors meet those of their own length. Rows with null vec_id
    are never anchors but may be found. Scores are exact up to 53 bits.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = numbered(usable(vectors, F.col("label") if label is None else label))
    stats, blocks = saved(moments(rows)), packed_blocks(rows, cells)
    anchors = rows.where(is_anchor)
    endless = lambda x: F.array(F.lit(x).cast("double"))
    peers = rows.groupBy("size", "label").agg(F.count("*").alias("peers"))
    asked = anchors.join(peers, ["size", "label"]).withColumns({"lows": endless("-Infinity"), "highs": endless("Infinity")})
    near = filled(asked, blocks, stats, True, positives, cells)
    near = saved(near.select("anchor", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    bounds = near.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("p", F.ceil(F.col("positive_score") * F.lit(low) / 100).cast("double").alias("l"), F.floor(F.col("positive_score") * F.lit(high) / 100).cast("double").alias("h")))).alias("w"))
    asked = anchors.join(bounds, "row").join(stats.select("size", F.col("n").alias("peers")), "size", "left").withColumns({"lows": F.col("w.l"), "highs": F.col("w.h")}).fillna({"peers": 1})
    # Windows are padded to one number, so that blocks of anchors are matrices; none reaches the padding.
    pad = lambda c, x: F.concat(c, F.array_repeat(F.lit(x).cast("double"), F.lit(positives) - F.size(c)))
    asked = saved(asked.select("row", "size", "vec_id", "label", "vector", "peers", pad(F.col("lows"), "Infinity").alias("lows"), pad(F.col("highs"), "-Infinity").alias("highs")))
    far = filled(asked, blocks, stats, False, negatives, cells)
    named = far.select("anchor", (F.col("window") + 1).alias("p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return named.join(near, ["anchor", "p"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most ``radius`` bits agree on at least one of
``radius + 1`` bit blocks, and of more blocks on more. Each choice of them leads
the fingerprint in turn; equal leading blocks form one trie, and Spark deals
the tries out. Leads grow with the number of fingerprints. Within a trie,
node pairs are traversed together from the root: each level adds a differing
bit where the branches part, and a pair is dropped once it exceeds the radius.
Tries with too many fingerprints are split into chunks that meet pairwise, so
no task holds an unbounded trie. A task returns a spanning forest of its links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrarium.llm.components import components
from agrarium.llm.rows import KEY, arrays_of, flat_map, keyed, saved

BITS = 64
SMALL = 64  # node pairs with as many candidate pairs at most are compared directly
AT_ONCE = 1 << 20  # candidate pairs or node pairs held at once
CHUNK = 1 << 20  # shingles hashed at once


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, len(words) - shingle + 1)
    starts, ends = starts[:m].tolist(), ends[-m:].tolist()
    counts = np.zeros(BITS, np.int64)
    for i in range(0, m, CHUNK):
        hashes = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m).view(">u8").astype(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text)."""

    def make() -> Callable:
        return lambda doc_id, text: [(doc_id, fingerprint(text, shingle))]

    return flat_map(docs.select("doc_id", "text"), make, "doc_id long, fp long")


class Forest:
    """Union by least index over 0..n-1, for arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            if not (apart := ra != rb).any():
                return
            np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo[i] .. lo[i] + n[i] - 1, one range after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def trie_join(fps: np.ndarray, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], depth: int, radius: int, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Index pairs within ``radius`` between the root ranges ``first[i]`` and ``second[i]`` of ``fps``.

    ``fps`` (uint64) is sorted within each range, and the ranges of a pair
    agree on the leading ``depth`` bits. A node is the range of fingerprints
    below it. Equal ranges are joined with themselves.
    """
    stack = [(depth, *first, *second, np.zeros(len(first[0]), np.int64))]
    while stack:
        bit, lo1, hi1, lo2, hi2, errors = stack.pop()
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = (n1 * n2 <= SMALL) | (bit >= BITS)
        if small.any():
            for i in _batches((n1 * n2)[small]):
                a, b, na, nb = lo1[small][i], lo2[small][i], n1[small][i], n2[small][i]
                left = _ranges(a, na)
                width = np.repeat(nb, na)
                right = _ranges(np.repeat(b, na), width)
                left = np.repeat(left, width)
                near = np.bitwise_count(fps[left] ^ fps[right]) <= radius
                emit(left[near], right[near])
            keep = ~small
            lo1, hi1, lo2, hi2, errors = lo1[keep], hi1[keep], lo2[keep], hi2[keep], errors[keep]
        if not len(lo1):
            continue
        if len(lo1) > AT_ONCE:
            half = len(lo1) // 2
            stack += [(bit, lo1[s], hi1[s], lo2[s], hi2[s], errors[s]) for s in (slice(None, half), slice(half, None))]
            continue
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(BITS - 1 - bit)) & np.uint64(1), dtype=np.int64)))
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        own = (lo1 == lo2) & (hi1 == hi2)
        sides = [(lo1, mid1, lo2, mid2, errors), (mid1, hi1, mid2, hi2, errors), (lo1, mid1, mid2, hi2, errors + 1), (mid1[~own], hi1[~own], lo2[~own], mid2[~own], errors[~own] + 1)]
        a1, b1, a2, b2, err = (np.concatenate(x) for x in zip(*sides, strict=True))
        live = (b1 > a1) & (b2 > a2) & (err <= radius)
        stack.append((bit + 1, a1[live], b1[live], a2[live], b2[live], err[live]))


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Index arrays whose sizes sum to about AT_ONCE."""
    at = np.cumsum(sizes) // AT_ONCE
    for k in np.unique(at):
        yield np.flatnonzero(at == k)


def deals(n: int, radius: int, most: int, blocks: int | None = None) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Orders of a fingerprint's bit blocks (start, width), and how many leading bits are shared within each order's tries.

    Of b blocks, b - radius are equal in fingerprints within the radius; each
    choice of so many leads in turn. There are radius + 1 blocks, and more where
    ``n`` fingerprints would make tries of more than ``most`` on average.
    """
    b = blocks or radius + 1
    while True:
        widths = [BITS // b + (i < BITS % b) for i in range(b)]
        cut = [(sum(widths[:i]), w) for i, w in enumerate(widths)]
        chosen = list(combinations(range(b), b - radius))
        leads = [sum(widths[i] for i in c) for c in chosen]
        if blocks or n <= most << min(leads) or b >= radius + 4:
            return [[cut[i] for i in c] + [cut[i] for i in range(b) if i not in c] for c in chosen], leads
        b += 1


def links(fps: DataFrame, radius: int = 4, most: int = 20_000, blocks: int | None = None) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp long) whose components equal those of all links within ``radius``.

    ``most`` fingerprints of a trie meet in one task at most twice over. How
    many ``blocks`` lead follows from the number of fingerprints unless given.
    """
    orders, leads = deals(fps.count() if blocks is None else 0, radius, most, blocks)
    turned = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), t.alias("turned"), F.shiftrightunsigned(t, BITS - lead).alias("lead")) for i, (order, lead) in enumerate(zip(orders, leads, strict=True)) for t in (_turned("fp", order),)))).alias("x")).select("x.*")
    sizes = saved(turned.groupBy("block", "lead").agg(F.count("*").alias("n")).where("n > 1"))
    rows = turned.join(sizes, ["block", "lead"]).withColumn("chunks", F.ceil(F.col("n") / most))
    own = F.pmod(F.xxhash64("turned"), F.col("chunks"))
    pairs = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = pairs.select("block", "lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "turned")
    group = ["block", "lead", "i", "j"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "side", F.shiftrightunsigned("turned", 1), F.col("turned").bitwiseAND(1))
    schema = "a long, b long"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 4, 4 * most):
            block, side, turned_ = (t.column(k).to_numpy() for k in ("block", "side", "turned"))
            values = turned_.astype(np.uint64)
            new = np.zeros(len(values), bool)
            for k in group:
                c = t.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            new[0] = True
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(values))
            i, j = (t.column(k).to_numpy()[lo] for k in ("i", "j"))
            mid = lo + np.add.reduceat(side == 0, lo)
            self_ = i == j
            forest = Forest(len(values))
            first = (lo, np.where(self_, hi, mid))
            second = (np.where(self_, lo, mid), hi)
            live = (first[1] > first[0]) & (second[1] > second[0])
            # A trie's leading bits are equal; those that all orders share are skipped.
            trie_join(values, (first[0][live], first[1][live]), (second[0][live], second[1][live]), min(leads), radius, forest.link)
            moved = np.flatnonzero(forest.root != np.arange(len(values)))
            whole = np.zeros(len(values), np.int64)
            for k in np.unique(block).tolist():
                own = block == k
                whole[own] = _returned(values[own], orders[k]).view(np.int64)
            yield arrays_of([whole[moved], whole[forest.root[moved]]], arrow)

    return dealt.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of the leading ``keys`` columns, of at least ``rows`` rows each but the last; input in the order of the keys."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        changed = np.zeros(n, bool)
        for k in range(keys):
            c = t.column(k).to_numpy()
            changed[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(changed)
        if len(cut):
            yield t.slice(0, int(cut[-1]))
            t = t.slice(int(cut[-1]))
        held, n = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _turned(fp: str, order: list[tuple[int, int]]) -> F.Column:
    """The fingerprint with its blocks in ``order``."""
    out, at = F.lit(0).cast("long"), BITS
    for start, width in order:
        at -= width
        piece = F.shiftrightunsigned(fp, BITS - start - width).bitwiseAND(F.lit((1 << width) - 1))
        out = out.bitwiseOR(F.shiftleft(piece, at))
    return out


def _returned(turned: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Undoes ``_turned``."""
    out, at = np.zeros(len(turned), np.uint64), BITS
    for start, width in order:
        at -= width
        piece = (turned >> np.uint64(at)) & np.uint64((1 << width) - 1)
        out |= piece << np.uint64(BITS - start - width)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, most: int = 20_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fingerprint (hex) and component_id.

    Fingerprints within ``radius`` bits link; component_id is the least doc_id
    reachable. Null, empty and blank texts have fingerprint 0, which links like
    any other; a component with null ids only has a null component_id; repeated
    rows are kept; other columns are ignored; an empty table gives no rows.
    Very long texts are hashed whole.
    """
    marked = saved(fingerprints(docs, shingle))
    rooted = saved(classes(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, most))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classes(distinct: DataFrame, radius: int, most: int) -> DataFrame:
    """``distinct`` (one row per fp) with the least fingerprint of each one's component as root."""
    distinct = saved(distinct)
    rooted = components(links(distinct.select("fp"), radius, most))
    return distinct.join(rooted, distinct.fp == rooted.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, shingle: int = 4, radius: int = 4, most: int = 20_000) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the least doc_id, null ids last."""
    rows, names = keyed(docs)

    def make() -> Callable:
        return lambda key, key2, doc_id, text: [(key, key2, doc_id, fingerprint(text, shingle))]

    marked = saved(flat_map(rows.select(*names, "doc_id", "text"), make, "row_key long, row_key2 long, doc_id long, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("first")
    rooted = classes(marked.groupBy("fp").agg(first), radius, most)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(*(F.col(f"first.{k}").alias(n) for k, n in zip(KEY, names, strict=True)))
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)

"""Suffix-array deduplication over bytes, by the common-prefix interval tree.

Where contexts of an anchor differ (module repeats), a block builds an enhanced
suffix array of the suffixes that begin at the anchors: sorted, with the
common-prefix lengths of neighbours. A stack scan visits the intervals of
suffixes that share a prefix. In each the occurrences are ordered by what
stands left of them: the repeat is maximal where left extensions differ, and
how far left extensions agree tells how far each occurrence's repeat reaches.
Every occurrence of an interval is judged, not only neighbours in the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agrarium.llm.repeats import BASES, Rolling, blocks_of, covered, least_places, mix, spans
from agrarium.llm.rows import KEY, flat_map, packed, unpacker, with_row_key

GRAM, PIECES = 32, 4  # bytes of a gram, and pieces of a crowded segment


def byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units() -> Callable[[str | None], np.ndarray]:
    table = byte_table()
    return lambda text: table[np.frombuffer((text or "").encode(), np.uint8)]


def segment_bytes(window: int) -> Callable:
    """Details: a segment's bytes, and where its anchor stands."""

    def make() -> Callable:
        units, cache = byte_units(), {}

        def of(text: str | None, wanted: list[tuple[int, int]]) -> list[tuple[int, bytes]]:
            raw = (text or "").encode()
            grams = Rolling(units(text), BASES[0], cache).grams(GRAM)
            width = window - GRAM + 1
            return [(int(least_places(grams[start : start + width], width)[0]), raw[start : start + count - 1 + window]) for start, count in wanted]

        return of

    return make


def _common(x: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows a[i] and b[i] of ``x``, which count up to ``n``."""
    differ = x[a] != x[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(first, np.minimum(n[a], n[b]))


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of all maximal runs of suffixes with a common prefix of at least ``least``; common[i] is that of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common, 0]):
        left = i
        while stack and stack[-1][0] > c:
            length, left = stack.pop()
            yield length, left, i
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, left))


def maximal_repeats(window: int) -> Callable[[pa.Table], Iterator[tuple]]:
    def compare(t: pa.Table) -> Iterator[tuple]:
        block = blocks_of(t)
        start, count, place, times, key, key2 = (t.column(c).to_numpy() for c in ("start", "count", "place", "times", *KEY))
        details = t.column("detail").to_pylist()
        for lo in _slices(block):
            yield from _compare(window, block[lo], start[lo], count[lo], place[lo], times[lo], (key[lo], key2[lo]), details[lo])

    return compare


def _slices(block: np.ndarray, rows: int = 20_000) -> Iterator[slice]:
    """Slices of whole blocks, of about ``rows`` rows."""
    cuts = np.append(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), len(block))
    lo = 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - lo > rows and a > lo:
            yield slice(lo, a)
            lo = a
    yield slice(lo, len(block))


def _compare(window: int, block: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray, times: np.ndarray, keys: tuple[np.ndarray, np.ndarray], details: list[bytes]) -> Iterator[tuple]:
    m = len(block)
    right, left = np.zeros((m, window), np.uint8), np.zeros((m, window), np.uint8)
    for r, (d, p) in enumerate(zip(details, place.tolist(), strict=True)):
        raw = np.frombuffer(d, np.uint8)
        after = raw[p : p + window]
        right[r, : len(after)] = after
        left[r, :p] = raw[:p][::-1]
    n_right = np.minimum(window, np.fromiter(map(len, details), np.int64, m) - place)
    n_left = place.astype(np.int64)
    suffix = np.lexsort((n_right, right.view(f"S{window}")[:, 0], block))
    rank_left = np.empty(m, np.int64)
    rank_left[np.lexsort((n_left, left.view(f"S{window}")[:, 0]))] = np.arange(m)
    common = _common(right, n_right, suffix[:-1], suffix[1:]) if m > 1 else np.zeros(0, np.int64)
    common[block[suffix[:-1]] != block[suffix[1:]]] = 0
    best: list[tuple[np.ndarray, ...]] = []
    # A window holds place bytes at most on the left, so shorter common prefixes than this hold none.
    shortest = max(GRAM, window - int(n_left.max(initial=0)))
    for length, first, last in intervals(common.tolist(), shortest):
        members = suffix[first : last + 1]
        members = members[np.argsort(rank_left[members])]
        agree = _common(left, n_left, members[:-1], members[1:])
        reach = np.maximum(np.append(agree, 0), np.append(0, agree))
        low = np.maximum(window - length, place[members] - count[members] + 1)
        high = np.minimum(reach, place[members])
        ok = (low <= high) & (times[members] == 1)
        if ok.any():
            best.append((members[ok], low[ok], high[ok]))
    if best:
        r, low, high = (np.concatenate(x) for x in zip(*best, strict=True))
        yield *(k[r] for k in keys), start[r] + place[r] - high, start[r] + place[r] - low


def byte_parts() -> tuple[Callable, Callable]:
    table = byte_table()
    return lambda d: table[np.frombuffer(d, np.uint8)], lambda d, lo, hi: d[lo:hi]


def repeated_bytes(docs: DataFrame, window: int = 200, most: int = 1_024) -> DataFrame:
    """(row_key, row_key2, starts, ends): ranges of UTF-8 bytes that repeated windows cover, from ``with_row_key`` rows."""
    return spans(docs, byte_units, window, GRAM, segment_bytes(window), maximal_repeats(window), byte_parts, PIECES, most)


def digests(docs: DataFrame, window: int = 200, most: int = 1_024) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): bytes, bytes removed, removed runs, digest of the rest.

    A byte goes if a string of ``window`` bytes covers it that starts anywhere
    else too, in the same or another row; repeated rows repeat each other. Null
    texts are empty; ids may be null; other columns are ignored; an empty table
    gives no rows. Very long texts are looked through in parts of a million
    window starts, and nothing is cut.
    """
    keyed = with_row_key(docs)

    def make() -> Callable:
        unpack = unpacker()

        def each(doc_id: int | None, pack: bytes | None, starts: list | None, ends: list | None) -> list[tuple]:
            raw = np.frombuffer((unpack(pack) or "").encode(), np.uint8)
            gone = covered(len(raw), starts, ends)
            runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            return [(doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest())]

        return each

    found = packed(keyed).join(repeated_bytes(keyed, window, most), KEY, "left").select("doc_id", "packed", "starts", "ends")
    return flat_map(found, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", batch=5_000)

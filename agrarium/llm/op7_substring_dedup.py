"""Substring deduplication over words, by relative Lempel-Ziv parsing.

A document is parsed greedily into factors found in reference blocks. The
corpus itself is the reference, and its blocks are its segments by anchor
(module repeats): a factor of a whole window can only lie in blocks that share
one of the document's anchors, so parsing against those is parsing against all.
A segment whose whole context stands in its block again is a factor at once.
Any other is parsed word by word: each factor is extended to its longest, and
where it ends the windows across its boundary are looked up in the block's
index. Factors of at least a window are repeats. Segments too many for one block
even by what stands around their anchor aren't parsed; their windows are
counted by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agrarium.llm.repeats import BASES, Rolling, blocks_of, covered, least_places, mix, spans, window_hashes
from agrarium.llm.rows import KEY, flat_map, packed, unpacker, with_row_key

GRAM, PIECES = 8, 2  # words of a gram, and pieces of a crowded segment


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def word_units() -> Callable[[str | None], np.ndarray]:
    return lambda text: _units(words_of(text))


def segment_words(window: int) -> Callable:
    """Details: a segment's words, and where its anchor stands."""

    def make() -> Callable:
        units, cache = word_units(), {}

        def of(text: str | None, wanted: list[tuple[int, int]]) -> list[tuple[int, bytes]]:
            words = words_of(text)
            grams = Rolling(units(text), BASES[0], cache).grams(GRAM)
            width = window - GRAM + 1
            return [(int(least_places(grams[start : start + width], width)[0]), b" ".join(words[start : start + count - 1 + window])) for start, count in wanted]

        return of

    return make


def word_parts() -> tuple[Callable, Callable]:
    return lambda d: _units(d.split(b" ")), lambda d, lo, hi: b" ".join(d.split(b" ")[lo:hi])


def _units(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class Reference:
    """Blocks of reference segments, indexed for the longest factor from any window on.

    Windows are sorted by block, by where they stand to the anchor, by their
    hash, and among equals by the words from the anchor on, so that the segment
    that agrees longest with another one is its neighbour.
    """

    def __init__(self, t: pa.Table, window: int) -> None:
        self.window = window
        self.words = [d.split(b" ") for d in t.column("detail").to_pylist()]
        count, place = t.column("count").to_numpy(), t.column("place").to_numpy()
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        begin = np.cumsum(lengths) - lengths
        hashes = window_hashes(_units(list(chain.from_iterable(self.words))), window, {})
        self.row = np.repeat(np.arange(len(count)), count)
        self.base = np.cumsum(count) - count
        self.inside = np.arange(len(self.row)) - self.base[self.row]
        stand = (place[self.row] - self.inside).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        block = blocks_of(t)[self.row].astype(np.uint64)
        full = mix(hashes[begin[self.row] + self.inside] ^ mix(block << np.uint64(32) | stand))
        self.order = np.lexsort((self._ranks(place)[self.row], full))
        self.at = np.empty(len(self.order), np.int64)
        self.at[self.order] = np.arange(len(self.order))
        #: same[i]: the i-th window in order equals the one before.
        self.same = np.concatenate(([False], full[self.order[1:]] == full[self.order[:-1]], [False]))
        self.shared = (self.same[:-1] | self.same[1:])[self.at]

    def _ranks(self, place: np.ndarray) -> np.ndarray:
        """The rank of each segment by its words from the anchor on."""
        tails = sorted(range(len(self.words)), key=lambda r: self.words[r][place[r] :])
        ranks = np.empty(len(tails), np.int64)
        ranks[tails] = np.arange(len(tails))
        return ranks

    def factor(self, r: int, i: int) -> int:
        """Where the longest factor that starts at window ``i`` of segment ``r`` ends; ``i`` if no other segment holds that window."""
        own, at, end = self.words[r], int(self.at[self.base[r] + i]), i
        for near, equal in ((at - 1, self.same[at]), (at + 1, self.same[at + 1])):
            if not equal:
                continue
            g = int(self.order[near])
            other, j = self.words[int(self.row[g])], int(self.inside[g])
            if other[j : j + self.window] != own[i : i + self.window]:
                continue
            e, shift = i + self.window, j - i
            most = min(len(own), len(other) - shift)
            while e < most and own[e] == other[e + shift]:
                e += 1
            end = max(end, e)
        return end


def greedy_factors(window: int) -> Callable[[pa.Table], Iterator[tuple]]:
    """Parses single segments against the other segments of their blocks.

    A factor is followed to its end; the windows that cross the end are looked
    up one after another, and the next factor starts at the first that another
    segment holds. Windows that none holds are literals.
    """

    def compare(t: pa.Table) -> Iterator[tuple]:
        index = Reference(t, window)
        count, times, start, key, key2 = (t.column(c).to_numpy() for c in ("count", "times", "start", *KEY))
        places = np.where(index.shared, np.arange(len(index.row)), len(index.row))
        # The next window, this one included, that another segment holds.
        after = np.append(np.minimum.accumulate(places[::-1])[::-1], len(index.row))
        first, last, rows = [], [], []
        for r in np.flatnonzero((times == 1) & (after[index.base] < index.base + count)).tolist():
            base, n, i = int(index.base[r]), int(count[r]), 0
            while i < n and (i := int(after[base + i]) - base) < n:
                end = index.factor(r, i)
                if end == i:
                    i += 1
                    continue
                rows.append(r)
                first.append(i)
                last.append(min(end - window, n - 1))
                i = end - window + 1
        if rows:
            yield key[rows], key2[rows], start[rows] + np.array(first), start[rows] + np.array(last)

    return compare


def repeated_words(docs: DataFrame, window: int = 35, most: int = 4_096) -> DataFrame:
    """(row_key, row_key2, starts, ends): ranges of words that repeated windows cover, from ``with_row_key`` rows."""
    return spans(docs, word_units, window, GRAM, segment_words(window), greedy_factors(window), word_parts, PIECES, most)


def digests(docs: DataFrame, window: int = 35, most: int = 4_096) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, words removed, digest of the words kept.

    A word goes if a window of ``window`` words covers it whose sequence starts
    anywhere else too, in the same or another row; repeated rows repeat each
    other. Null texts have no words; ids may be null; other columns are ignored;
    an empty table gives no rows. Very long texts are looked through in parts
    of a million window starts, and nothing is cut.
    """
    keyed = with_row_key(docs)

    def make() -> Callable:
        unpack = unpacker()

        def each(doc_id: int | None, pack: bytes | None, starts: list | None, ends: list | None) -> list[tuple]:
            words = words_of(unpack(pack))
            gone = covered(len(words), starts, ends)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            return [(doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())]

        return each

    found = packed(keyed).join(repeated_words(keyed, window, most), KEY, "left").select("doc_id", "packed", "starts", "ends")
    return flat_map(found, make, "doc_id long, n_words long, n_removed long, kept_sha256 string", batch=5_000)


def deduplicated(docs: DataFrame, window: int = 35, most: int = 4_096) -> DataFrame:
    """(doc_id, text) with the words kept, joined by one space."""
    keyed = with_row_key(docs)

    def make() -> Callable:
        unpack = unpacker()

        def each(doc_id: int | None, pack: bytes | None, starts: list | None, ends: list | None) -> list[tuple]:
            words = words_of(unpack(pack))
            gone = covered(len(words), starts, ends).tolist()
            return [(doc_id, b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())]

        return each

    found = packed(keyed).join(repeated_words(keyed, window, most), KEY, "left")
    return flat_map(found.select("doc_id", "packed", "starts", "ends"), make, "doc_id long, text string", batch=500)

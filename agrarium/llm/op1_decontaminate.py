"""Benchmark decontamination by SimHash windows.

A benchmark item of n word shingles is sought among all windows of n shingles
of a document. A multi-index over blocks of the items' fingerprints returns
every item within the Hamming radius of a window: with more blocks than the
radius divided by a block's own radius, one block must be near. Exact weighted
Jaccard similarity of the shingles then decides.

Windows that hold too few benchmark shingles to reach the similarity are never
fingerprinted; that bound is exact. Items come in blocks of bounded size, each
broadcast in turn and held against all documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrarium.llm.rows import KEY, flat_map, held, keyed, with_row_key

WORD = re.compile(r"\w+")
SCHEMA = "row_key long, row_key2 long, doc_id long, item_id long, similarity double, start_word long, n_windows long"
BYTES = 8


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingle_codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for each run of ``size`` words; the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    m = max(1, n - size + 1)
    code = np.zeros(m, np.uint64)
    for i in range(min(size, n)):
        code = (code ^ hashes[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def window_fingerprints(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the windows of ``n`` codes at ``starts``; repeats weigh as often as they occur."""
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits(2 * (sums[starts + n] - sums[starts]) > n, axis=1).view(">u8")[:, 0].astype(np.uint64)


class HammingIndex:
    """Fingerprints by each of their bytes; ``near`` returns all within ``radius``."""

    def __init__(self, fps: np.ndarray, radius: int) -> None:
        self.fps, self.radius = fps, radius
        own = fps.astype(">u8").view(np.uint8).reshape(-1, BYTES)
        values = np.arange(256, dtype=np.uint8)
        # Eight blocks: within the radius, one block differs in radius // 8 bits at most.
        self.tables = [[np.flatnonzero(np.bitwise_count(own[:, b] ^ v) <= radius // BYTES) for v in values] for b in range(BYTES)]

    def near(self, fp: np.uint64) -> np.ndarray:
        found = np.unique(np.concatenate([self.tables[b][(int(fp) >> (8 * (BYTES - 1 - b))) & 255] for b in range(BYTES)]))
        return found[np.bitwise_count(self.fps[found] ^ fp) <= self.radius]


class _ShortItems:
    """Items of fewer words than a shingle: all their words, as they stand."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.by_words: dict[tuple[str, ...], list[int]] = {}
        for i, w in items:
            self.by_words.setdefault(tuple(w), []).append(i)
        self.lengths = sorted({len(w) for w in self.by_words})
        self.first = {w[0] for w in self.by_words}

    def find(self, words: list[str]) -> list[tuple[int, float, int, int]]:
        """Items within ``words``; one that is all of them is a shingle of its own and found as such."""
        found: dict[tuple[str, ...], tuple[int, int]] = {}
        for at in [i for i, w in enumerate(words) if w in self.first] if self.first else []:
            for n in self.lengths:
                run = tuple(words[at : at + n])
                if len(run) == n < len(words) and run in self.by_words:
                    first, times = found.get(run, (at, 0))
                    found[run] = first, times + 1
        return [(i, 1.0, *found[run]) for run in found for i in self.by_words[run]]


class Items:
    """A block of benchmark items, ready to be sought in documents."""

    def __init__(self, rows: list[tuple[int, str]], size: int, similarity: float, radius: int, short: bool) -> None:
        self.size, self.similarity = size, similarity
        words = [words_of(text) for _, text in rows]
        self.short = _ShortItems([(i, w) for (i, _), w in zip(rows, words, strict=True) if short and 0 < len(w) < size])
        self.ids = [i for (i, _), w in zip(rows, words, strict=True) if w]
        codes = [shingle_codes(word_hashes(w), size) for w in words if w]
        self.weights = [Counter(c.tolist()) for c in codes]
        vocabulary = sorted({x for w in words for x in w})
        self.vocabulary = dict(zip(vocabulary, word_hashes(vocabulary).tolist(), strict=True))
        self.known = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        lengths = np.array([len(c) for c in codes], np.int64)
        self.by_length = {}
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            self.by_length[n] = own, HammingIndex(np.concatenate([window_fingerprints(codes[k], np.zeros(1, np.int64), n) for k in own]), radius)

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word of the best window, matching windows) of each item in the text."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        return self.find_long(words) + self.short.find(words)

    def find_long(self, words: list[str]) -> list[tuple[int, float, int, int]]:
        # Words that no item has are 0; runs without them may be shingles of an item.
        known = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        outside = np.concatenate(([0], np.cumsum(known == 0)))
        width = min(self.size, len(words))
        runs = np.flatnonzero(outside[width:] == outside[:-width])
        if not len(runs):
            return []
        codes = shingle_codes(known, self.size)[runs]
        at = np.searchsorted(self.known, codes)
        runs = runs[self.known[np.minimum(at, len(self.known) - 1)] == codes]
        if not len(runs):
            return []
        codes = shingle_codes(word_hashes(words), self.size)
        hits = np.zeros(len(codes) + 1, np.int64)
        hits[runs + 1] = 1
        hits = np.cumsum(hits)
        m = len(codes)
        found: dict[int, tuple[float, int, int]] = {}
        for n, (own, index) in self.by_length.items():
            w = min(n, m)
            # s shared shingles give at most s / (n + w - s).
            need = math.ceil(self.similarity * (n + w) / (1 + self.similarity) - 1e-9)
            if need > w:
                continue
            starts = np.flatnonzero(hits[w:] - hits[: m - w + 1] >= need)
            if not len(starts):
                continue
            for start, fp in zip(starts.tolist(), window_fingerprints(codes, starts, w), strict=True):
                near = index.near(fp)
                if not len(near):
                    continue
                window = Counter(codes[start : start + w].tolist())
                for k in own[near].tolist():
                    shared = (window & self.weights[k]).total()
                    exact = shared / (n + w - shared)
                    if exact >= self.similarity:
                        best, at, times = found.get(k, (0.0, start, 0))
                        found[k] = (exact, start, times + 1) if exact > best else (best, at, times + 1)
        return [(self.ids[k], *x) for k, x in sorted(found.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 23, short: bool = False, block_chars: int = 20_000_000) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) and each item of ``benchmark`` (item_id, text) found in it.

    Words are ``\\w+`` of the lower-cased text, shingles have ``size`` words
    (shorter sequences are one shingle, found in equally short texts only;
    with ``short``, all their words as they stand are found in longer texts
    too). Texts that are null or have no words match nothing; very long ones
    are looked through whole; an empty table on either side gives no rows. Repeated rows and
    repeated items give a row each; null ids are kept; other columns are
    ignored. ``row_key`` tells rows of ``docs`` apart.
    """
    spark = docs.sparkSession
    rows = with_row_key(docs)
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])

        def make(shared=shared, token=uuid.uuid4().hex) -> Callable:  # noqa: ANN001
            index = held(("items", token), lambda: Items(shared.value, size, similarity, radius, short))
            return lambda row_key, row_key2, doc_id, text: [(row_key, row_key2, doc_id, *x) for x in index.find(text)]

        found.append(flat_map(rows, make, SCHEMA))
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    rows, names = keyed(docs)
    bad = leaks(docs, benchmark, **options).select(*KEY).distinct().toDF(*names)
    return rows.join(bad, names, "left_anti").select(*docs.columns)

"""Ranked lexical search: the best documents for each item, by integer scores.

A document is a vector of impacts over the items' terms, an item a vector of
term weights, and a score is their inner product. As in LEMP, vectors are put
in order of length (a range partitioning by norm) and searched in buckets.
Cauchy-Schwarz prunes whole buckets: norm of item times largest norm of bucket.
Inside a bucket, an item's heaviest terms (its focus coordinates) are taken
exactly and the rest is bounded, by the norms that are left over and by the
bucket's largest coordinates. Survivors are scored in 64-bit integers.

The longest vectors are searched first, which gives each item a score that its
answers must reach; the other buckets begin with it and raise it as they go.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrarium.llm.rows import arrays_of, flat_map, held, saved

#: The constants of the score, fixed values.
SCALE, TF, LENGTH, BASE, SLOPE = 1_000_000_000, 1_000, 12, 75, 25
SLACK = 1 + 1e-9  # for rounding, where bounds are compared
VECTOR = "doc_id long, n long, at binary, tf binary"
FOUND = "item int, doc_id long, score long"
#: ASCII letters in lower case, digits, and all bytes of other characters; a space for the rest.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


class Block(NamedTuple):
    """Items that share a narrow vocabulary: terms (their numbers, sorted), and the items' terms (columns) and weights, padded by zero weights."""

    items: np.ndarray
    terms: np.ndarray
    columns: np.ndarray
    weights: np.ndarray


def blocks_of(weighted: dict[int, dict[int, int]], width: int, most: int) -> list[Block]:
    """Items with their terms' weights, in blocks of up to ``most`` items and about ``width`` different terms."""
    groups: list[tuple[list[int], set[int]]] = []
    for i, own in weighted.items():
        if not groups or len(groups[-1][0]) >= most or len(groups[-1][1] | own.keys()) > max(width, len(own)):
            groups.append(([], set()))
        groups[-1][0].append(i)
        groups[-1][1].update(own)
    out = []
    for items, terms in groups:
        order = np.array(sorted(terms), np.int64)
        column = {t: c for c, t in enumerate(order.tolist())}
        longest = max(len(weighted[i]) for i in items)
        columns, weights = np.zeros((len(items), longest), np.int64), np.zeros((len(items), longest), np.int64)
        for r, i in enumerate(items):
            # Heaviest first: the leading ones are the focus.
            own = sorted(weighted[i].items(), key=lambda x: (-x[1], x[0]))
            columns[r, : len(own)], weights[r, : len(own)] = [column[t] for t, _ in own], [w for _, w in own]
        out.append(Block(np.array(items, np.int64), order, columns, weights))
    return out


class Best:
    """The ``k`` best answers of each item met so far: by score, then by doc_id, null last."""

    def __init__(self, k: int, least: dict[int, int]) -> None:
        self.k, self.least = k, dict(least)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def floor(self, items: np.ndarray) -> np.ndarray:
        return np.array([self.least.get(i, 1) for i in items.tolist()], np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        for i in np.unique(item).tolist():
            own = np.flatnonzero(item == i)
            new = score[own], doc[own], null[own]
            score_, doc_, null_ = (np.concatenate(x) for x in zip(self.rows[i], new, strict=True)) if i in self.rows else new
            order = np.lexsort((doc_, null_, -score_))[: self.k]
            self.rows[i] = score_[order], doc_[order], null_[order]
            if len(order) == self.k:
                self.least[i] = max(self.least.get(i, 1), int(score_[order[-1]]))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        parts = [(np.full(len(s), i, np.int32), d, n, s) for i, (s, d, n) in self.rows.items()]
        item, doc, null, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int32, np.int64, bool, np.int64))
        return arrays_of([item, pa.array(doc, mask=null), score], schema)


class Bucket(NamedTuple):
    """Document vectors of about one length: ids, and their entries as (row, term, impact)."""

    doc: np.ndarray
    null: np.ndarray
    row: np.ndarray
    term: np.ndarray
    impact: np.ndarray


def impacts(n: np.ndarray, tf: np.ndarray, row: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = BASE + (SLOPE * n * documents) // max(1, length)
    return (SCALE * tf) // (TF * tf + LENGTH * m[row])


def search(bucket: Bucket, block: Block, best: Best, focus: int = 8, pairs: int = 20_000) -> int:
    """Adds the bucket's answers for a block's items; returns how many pairs were scored."""
    size = len(block.terms)
    at = np.searchsorted(block.terms, bucket.term)
    kept = block.terms[np.minimum(at, size - 1)] == bucket.term
    vectors = np.zeros((len(bucket.doc), size))
    vectors[bucket.row[kept], at[kept]] = bucket.impact[kept]
    squares = (vectors**2).sum(1)
    weights = block.weights.astype(float)
    floor = best.floor(block.items)
    # Cauchy-Schwarz: items that no vector of the bucket can reach.
    live = np.flatnonzero(np.sqrt((weights**2).sum(1) * squares.max(initial=0)) * SLACK >= floor)
    if not len(live):
        return 0
    f = min(focus, weights.shape[1])
    taken = vectors[:, block.columns[live, :f]]  # documents x items x focus
    # Padding repeats a column with weight zero; its square must not count.
    real = weights[live, :f] > 0
    exact = np.einsum("daf,af->da", taken, weights[live, :f])
    left = np.sqrt(np.maximum(0, squares[:, None] - np.einsum("daf,daf,af->da", taken, taken, real.astype(float))))
    by_norm = left * np.sqrt((weights[live, f:] ** 2).sum(1))
    by_coordinate = (weights[live, f:] * vectors.max(0)[block.columns[live, f:]]).sum(1)
    bound = exact + np.minimum(by_norm, by_coordinate)
    doc, own = np.nonzero((bound * SLACK >= floor[live]) & (bound > 0))
    for lo in range(0, len(doc), pairs):
        d, a = doc[lo : lo + pairs], live[own[lo : lo + pairs]]
        score = (vectors[d[:, None], block.columns[a]].astype(np.int64) * block.weights[a]).sum(1)
        good = score >= best.floor(block.items)[a]
        best.add(block.items[a[good]], score[good], bucket.doc[d[good]], bucket.null[d[good]])
    return len(doc)


def document_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf) for each row with a term: the number of its terms, and numbers and occurrences of those in the vocabulary, as packed integers."""
    shared, token = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def make() -> Callable:
        number = held(("vocabulary", token), lambda: shared.value)

        def each(doc_id: int | None, text: str | None) -> list[tuple]:
            terms = terms_of(text)
            if not terms:
                return []
            found = sorted(Counter(filter(None.__ne__, map(number.get, terms))).items())
            return [(doc_id, len(terms), np.array([t for t, _ in found], "<i4").tobytes(), np.array([c for _, c in found], "<i8").tobytes())]

        return each

    return flat_map(docs.select("doc_id", "text"), make, VECTOR, batch=2_000)


def entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of vectors: n, and (row, term, tf) of all entries."""
    at = [np.frombuffer(x, "<i4") for x in b.column("at").to_pylist()]
    tf = [np.frombuffer(x, "<i8") for x in b.column("tf").to_pylist()]
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    return b.column("n").to_numpy(), row, np.concatenate([*at, np.zeros(0, "<i4")]).astype(np.int64), np.concatenate([*tf, np.zeros(0, "<i8")]).astype(np.int64)


def document_counts(vectors: DataFrame, terms: int) -> dict[int, int]:
    """Documents that hold each term: summed by each task, then by term; as many numbers as the items have terms."""
    schema = to_arrow_schema(T._parse_datatype_string("term int, df long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for b in batches:
            total += np.bincount(entries(b)[2], minlength=terms)
        found = np.flatnonzero(total)
        yield arrays_of([found.astype(np.int32), total[found]], schema)

    return dict(map(tuple, vectors.mapInArrow(run, schema_text(schema)).groupBy("term").agg(F.sum("df").alias("df")).collect()))


def schema_text(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def by_norm(vectors: DataFrame, documents: int, length: int) -> DataFrame:
    """Vectors that aren't empty, with their norm, range-partitioned and sorted by it, the longest first; rows of one norm are split by id and content."""
    schema = f"{VECTOR}, norm double"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, row, _, tf = entries(b)
            square = np.bincount(row, impacts(n, tf, row, documents, length).astype(float) ** 2, minlength=len(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.sqrt(square))], schema=arrow).filter(pa.array(square > 0))

    order = [F.desc("norm"), F.xxhash64("doc_id", "at", "tf").asc()]
    return vectors.select("doc_id", "n", "at", "tf").mapInArrow(run, schema).repartitionByRange(*order).sortWithinPartitions(*order)


def searched(vectors: DataFrame, blocks: list[Block], k: int, least: dict[int, int], documents: int, length: int, bucket: int) -> DataFrame:
    """(item, doc_id, score): each task's ``k`` best for each item, none below ``least``."""
    arrow, shared = to_arrow_schema(T._parse_datatype_string(FOUND)), vectors.sparkSession.sparkContext.broadcast((blocks, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = shared.value
        best = Best(k, floor)
        for whole in batches:
            for lo in range(0, whole.num_rows, bucket):
                b = whole.slice(lo, bucket)
                n, row, term, tf = entries(b)
                doc = b.column("doc_id")
                found = Bucket(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), row, term, impacts(n, tf, row, documents, length))
                for block in own:
                    search(found, block, best)
        yield best.batch(arrow)

    return vectors.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, bucket: int = 256, head: int = 20_000, block_items: int = 128, width: int = 4_096, pass_chars: int = 20_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each row of ``items`` (item_id, text).

    Null and empty texts on either side have no terms and match nothing; equal
    scores go by doc_id, null last; repeated documents and repeated items count
    as often as they stand there; null item_ids are kept. Very long texts count
    whole, other columns are ignored, and an empty table on either side gives
    no rows. Items are searched together up to ``pass_chars`` characters; more
    take further passes over the documents, so that what tasks share is bounded.
    """
    spark = docs.sparkSession
    parts, chars = [], items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(chars / pass_chars))
    for p in range(passes):
        own = items.select("item_id", "text").where(F.col("text").isNotNull())
        rows = [tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).toLocalIterator()]
        parts.append(_pass(spark, docs, rows, k, bucket, head, block_items, width))
    return reduce(DataFrame.unionByName, parts)


def _pass(spark: SparkSession, docs: DataFrame, rows: list[tuple], k: int, bucket: int, head: int, block_items: int, width: int) -> DataFrame:
    counted = {i: Counter(terms_of(text)) for i, (_, text) in enumerate(rows)}
    vocabulary = {t: j for j, t in enumerate(sorted({t for own in counted.values() for t in own}))}
    if not vocabulary:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    vectors = saved(document_vectors(docs, vocabulary))
    documents, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(vectors, len(vocabulary))
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[j] + 1))) for t, j in vocabulary.items() if j in df}
    weighted = {i: {vocabulary[t]: c * weight[t] for t, c in own.items() if weight.get(t)} for i, own in counted.items()}
    blocks = blocks_of({i: own for i, own in sorted(weighted.items(), key=lambda x: min(x[1], default=0)) if own}, width, block_items)
    ordered = saved(by_norm(vectors, documents, length))
    # The longest vectors, about ``head`` of them, give each item the score to reach.
    cut = ordered.agg(F.percentile_approx("norm", max(0.0, 1 - head / max(1, documents)), 10_000)).first()[0] or 0.0
    first = saved(_ranked(searched(ordered.where(F.col("norm") >= cut), blocks, k, {}, documents, length, bucket), k))
    least = dict(map(tuple, first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).select("item", "s").collect()))
    # No vector below this norm reaches any item: the scan skips them by the files' statistics.
    norms = {i: math.sqrt(sum(w * w for w in own.values())) for i, own in weighted.items() if own}
    reach = min((least.get(i, 1) / (norms[i] * SLACK) for i in norms), default=0.0)
    rest = searched(ordered.where((F.col("norm") < cut) & (F.col("norm") >= reach)), blocks, k, least, documents, length, bucket)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(rows)], "item int, item_id long")
    return _ranked(first.drop("rank").unionByName(rest), k).join(names, "item").select("item_id", "rank", "doc_id", "score")

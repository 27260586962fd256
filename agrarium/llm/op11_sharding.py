"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards, each with the weight of the shards below
it. A row descends level by level: every child draws -ln(u) / weight, u being
the hash of the row's key and the child's path, and the least draw wins. A
child's draw depends on its own path and weight alone. So where weights change,
rows move only into subtrees that gained and out of subtrees that lost; within
a subtree whose weights are as before, no row moves from one child to another.

A further shard opens a region of its own (``grown``): nothing below the older
regions changes, and all rows that move land in that shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.llm.rows import saved, unused

Rack = Mapping[int, float]
Region = Mapping[str, Rack]
Tree = Mapping[str, Region]


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> dict[str, dict[str, dict[int, float]]]:
    """Shards 0 to ``shards`` - 1 of equal weight, ``per_rack`` a rack and ``racks`` a region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack % racks}", {})[s] = 1.0
    return tree


def shards_of(tree: Tree) -> list[int]:
    return [s for racks in tree.values() for rack in racks.values() for s in rack]


def grown(tree: Tree, weight: float = 1.0) -> dict[str, Region]:
    """The tree with one more shard, numbered next, in a region of its own."""
    shard = max(shards_of(tree), default=-1) + 1
    return {**tree, f"shard{shard}": {"rack0": {shard: weight}}}


def reweighted(tree: Tree, shard: int, weight: float) -> dict[str, dict[str, dict[int, float]]]:
    """The tree with another weight of one shard."""
    return {r: {k: {s: weight if s == shard else w for s, w in rack.items()} for k, rack in racks.items()} for r, racks in tree.items()}


def _checked(tree: Tree) -> None:
    shards, weights = shards_of(tree), [w for racks in tree.values() for rack in racks.values() for w in rack.values()]
    if len(set(shards)) < len(shards):
        raise ValueError("a shard stands in the tree twice")
    if not all(math.isfinite(w) and w >= 0 for w in weights) or not sum(weights) > 0:
        raise ValueError("weights must be finite, at least zero, and not all zero")


def draw(path: str, key: Column, weight: float) -> Column:
    """An exponential draw with rate ``weight``, from 53 bits of the hash of path and key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11)
    return -F.ln((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def winner(key: Column, children: Iterable[tuple[int, str, float]]) -> Column:
    """The number of the child (number, path, weight) with the least draw; children of no weight draw nothing."""
    live = [c for c in children if c[2] > 0]
    if not live:
        return F.lit(None).cast("int")
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.array_min(F.array(*(F.struct(draw(path, key, w).alias("d"), F.lit(n).alias("n")) for n, path, w in live)))["n"]


def assigned(docs: DataFrame, tree: Tree, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``docs`` with the shard that each row's key comes to: three expressions, no shuffle.

    Rows with equal keys share a shard; null is a key like any other, other
    columns play no part. A column of ``docs`` named as ``shard`` is replaced.
    """
    _checked(tree)
    racks = [(r, k, rack) for r, found in tree.items() for k, rack in found.items()]
    region_at, rack_at = unused(docs, "region_", "rack_")
    k = F.col(key)

    def switch(on: str, cases: list[tuple[int, Column]]) -> Column:
        out = F.lit(None).cast("int")
        for n, value in reversed(cases):
            out = F.when(F.col(on) == n, value).otherwise(out)
        return out

    total = lambda found: sum(w for rack in found.values() for w in rack.values())
    regions = winner(k, [(i, r, total(found)) for i, (r, found) in enumerate(tree.items())])
    by_region = [(i, winner(k, [(j, f"{r}/{name}", sum(rack.values())) for j, (own, name, rack) in enumerate(racks) if own == r])) for i, r in enumerate(tree)]
    by_rack = [(j, winner(k, [(s, f"{r}/{name}/{s}", w) for s, w in rack.items()])) for j, (r, name, rack) in enumerate(racks)]
    return docs.withColumn(region_at, regions).withColumn(rack_at, switch(region_at, by_region)).withColumn(shard, switch(rack_at, by_rack)).drop(region_at, rack_at)


def slotted(rows: DataFrame, shard: str = "shard", slot: str = "slot", bucket_rows: int = 10_000) -> DataFrame:
    """``rows`` with a gapless place from 0 within each shard.

    The rows are written once with a number each; buckets of that number hold
    about ``bucket_rows`` rows of a shard whatever the keys are, are numbered
    within, and start where the buckets before them end. No task holds a shard.
    """
    number, bucket, before, n = unused(rows, "number_", "bucket_", "before_", "n_")
    table = saved(rows.withColumn(number, F.monotonically_increasing_id()))
    totals = table.groupBy(shard).agg(F.count("*").alias(n)).agg(F.max(n).alias(n)).first()
    buckets = max(1, math.ceil((totals[0] or 0) / bucket_rows))
    dealt = table.withColumn(bucket, F.pmod(F.xxhash64(number), F.lit(buckets)))
    counts = dealt.groupBy(shard, bucket).agg(F.count("*").alias(n))
    starts = counts.select(shard, bucket, F.coalesce(F.sum(n).over(Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(number)) - 1
    return dealt.withColumn(slot, place.cast("long")).join(starts, [shard, bucket]).withColumn(slot, F.col(slot) + F.col(before)).select(*(c for c in rows.columns if c != slot), slot)


def sharded(docs: DataFrame, tree: Tree, key: str = "doc_id", bucket_rows: int = 10_000) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``."""
    return slotted(assigned(docs, tree, key), bucket_rows=bucket_rows)


def moves(docs: DataFrame, before: Tree, after: Tree, key: str = "doc_id") -> DataFrame:
    """(source_shard, target_shard, n_rows, n_bytes): what a change of the tree moves; a map-side sum, keys of both stay where they are."""
    a, b = unused(docs, "source_shard", "target_shard")
    both = assigned(assigned(docs, before, key, a), after, key, b).where(F.col(a) != F.col(b))
    return both.groupBy(F.col(a).alias("source_shard"), F.col(b).alias("target_shard")).agg(F.count("*").alias("n_rows"), F.sum(size_of("text")).alias("n_bytes"))


def write_shards(docs: DataFrame, tree: Tree, path: str, key: str = "doc_id", file_rows: int = 1_000_000) -> None:
    """Writes ``docs`` as Parquet in a folder per shard, in files of up to ``file_rows`` rows; shuffled by shard and a part of it, so that large shards have many writers."""
    (part,) = unused(docs, "part_")
    shuffled = assigned(docs, tree, key).withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    shuffled.repartition("shard", part).drop(part).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def size_of(text: str) -> Column:
    """UTF-8 bytes of a text, none for null, and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def digests(docs: DataFrame, shards: int = 16, bucket_rows: int = 10_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): where it goes by ``key`` among ``shards`` shards, and among one more.

    Null text has size 1 and the checksum of no bytes. Null ids share a shard,
    repeated rows too, each with a slot of its own; other columns are ignored;
    an empty table gives no rows. Very long texts count by their bytes.
    """
    tree = even_tree(shards)
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size_of("text").alias("size"), checksum.cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    rows = assigned(assigned(rows, tree), grown(tree), shard="grown_shard")
    found = slotted(rows, bucket_rows=bucket_rows)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

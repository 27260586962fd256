"""Ordered records: first per key, gaps, padded sequences, pages, top rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.functions.arrays import pad_mask, padded
from agrarium.operators.lineage import saved


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def gaps(df: DataFrame, key: str, date: str) -> DataFrame:
    """(key, date, gap): days since the key's date before, over distinct dates."""
    days = df.select(key, F.col(date)).where(F.col(date).isNotNull()).distinct()
    before = F.lag(date).over(Window.partitionBy(key).orderBy(date))
    return days.withColumn("gap", F.datediff(date, before)).where("gap IS NOT NULL")


def largest_gaps(df: DataFrame, key: str, date: str) -> DataFrame:
    days = df.select(key).distinct()
    return days.join(gaps(df, key, date).groupBy(key).agg(F.max("gap").alias("max_gap")), key, "left").na.fill(0, ["max_gap"])


def sequences(df: DataFrame, key: str, order: str, value: str, size: int, keep_last: bool = False, pad_left: bool = False) -> DataFrame:
    """(key, values, mask): exactly ``size`` values by ``order``.

    Only the ``size`` rows that stay are gathered, however many a key has.
    """
    by = F.desc(order) if keep_last else F.asc(order)
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by))).where(F.col("_r") <= size)
    kept = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("_v"))
    return kept.select(key, padded(F.col("_v"), size, keep_last, pad_left).alias("values"), pad_mask(F.col("_v"), size, pad_left).alias("mask"))


def ordered(order: Sequence[str]) -> list[Column]:
    """Sort columns of names, of which those with a minus before them go down; nulls come first going up and last going down."""
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _same(x: Column, v: Any) -> Column:
    """Equal, as null and null or NaN and NaN are; NaN is asked for by name, since a cached table's bounds leave it out."""
    return F.isnan(x) if v != v else x.eqNullSafe(F.lit(v))


def _after(x: Column, v: Any, down: bool) -> Column:
    """Values behind ``v``: nulls are the least, NaN, asked for by name again, the greatest."""
    if v is None:
        return F.lit(False) if down else x.isNotNull()
    if v != v:
        return ~F.isnan(x) | x.isNull() if down else F.lit(False)
    if down:
        return (x < F.lit(v)) | x.isNull()
    return (x > F.lit(v)) | F.isnan(x) if isinstance(v, float) else x > F.lit(v)


def _beyond(order: Sequence[str], last: Sequence[Any], same: bool) -> Column:
    """Rows that come after ``last`` in order, with those equal to it if ``same``; the first column's bound stands by itself, so that a scan can use it."""
    found, equal, lead = F.lit(False), F.lit(True), None
    for name, v in zip(order, last, strict=True):
        down = name.startswith("-")
        x = F.col(name.lstrip("-"))
        if lead is None:
            plain = v is not None and v == v and (down or not isinstance(v, float))
            lead = ((x <= F.lit(v)) | x.isNull() if down else x >= F.lit(v)) if plain else _same(x, v) | _after(x, v, down)
        found = found | (equal & _after(x, v, down))
        equal = equal & _same(x, v)
    return lead & (found | equal if same else found)


def next_page(df: DataFrame, order: Sequence[str], last: Sequence[Any] | None, size: int) -> DataFrame:
    """The page after the row whose order columns are ``last`` (the first page for None).

    However far in, a page costs one scan of what lies behind ``last`` and a
    top-k of ``size`` rows. ``order`` should end in a key, else rows that are
    equal to ``last`` in all of its columns are passed over.
    """
    rest = df if last is None else df.where(_beyond(order, last, same=False))
    return rest.orderBy(*ordered(order)).limit(size)


def row_at(df: DataFrame, order: Sequence[str], rank: int) -> tuple[tuple[Any, ...], int] | None:
    """(values, behind): the order columns of the row of this rank (from 1), and how many rows equal to it in all of them come before it; None beyond the end.

    Column by column: rows are counted by value, the values range-partitioned
    in order, the ranges' sums tell the range that has the rank, and only that
    range's values are summed up one by one. Neither rows before the rank nor
    ties of a value are gathered anywhere.
    """
    held, left = [], rank
    for name in order:
        column = name.lstrip("-")
        counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).orderBy(*ordered(["-v" if name.startswith("-") else "v"]))
        counts = saved(counts.withColumn("part", F.spark_partition_id()))
        sums = counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one number a partition
        for part in sums:
            if left <= part["n"]:
                break
            left -= part["n"]
        else:
            return None
        upto = Window.orderBy(*ordered(["-v" if name.startswith("-") else "v"]))
        inside = counts.where(F.col("part") == part["part"]).withColumn("upto", F.sum("n").over(upto))
        found = inside.where(F.col("upto") >= left).orderBy("upto").limit(1).select("v", (F.col("upto") - F.col("n")).alias("before")).first()
        held.append(found["v"])
        left -= found["before"]
        df = df.where(_same(F.col(column), found["v"]))
    return tuple(held), left - 1


def page(df: DataFrame, order: Sequence[str], number: int, size: int, near: int = 10_000) -> DataFrame:
    """One page in order (from 1), each row with the total, which is one row joined to the page.

    Pages that end within the first ``near`` rows are a top-k. For those
    farther in the row that begins the page is found by counts (``row_at``),
    and the page is the ``size`` rows from there on; so neither takes more rows
    to one place than ``near``, or ``size`` and the ties of the page's first row.
    """
    total = df.agg(F.count("*").alias("total"))
    if number * size <= near:
        rows = df.orderBy(*ordered(order)).offset((number - 1) * size).limit(size)
    elif (start := row_at(df, order, (number - 1) * size + 1)) is None:
        rows = df.limit(0)
    else:
        rows = df.where(_beyond(order, start[0], same=True)).orderBy(*ordered(order)).offset(start[1]).limit(size)
    return rows.crossJoin(F.broadcast(total))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def best_row(df: DataFrame, key: str, metric: str, carry: list[str], smallest: bool = False) -> DataFrame:
    """(key, carry): the row of the best metric of each key, without a sort."""
    by = F.min_by if smallest else F.max_by
    return df.groupBy(key).agg(by(F.struct(*carry), F.struct(metric, *carry)).alias("_x")).select(key, "_x.*")

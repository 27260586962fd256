"""Exact ranks and quantiles by sums within ranges of values.

No task sorts or holds a whole column. Values of one key are cut into ranges at
quantiles of a sketch, and sums are taken for each range. Running sums over all
values stay within a range, with the sums of the ranges before added; where only
some ranks matter, only the ranges that hold them are counted value by value, in
a second pass over the rows. The sketch decides where ranges end and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.operators.lineage import saved

#: Ranges of a key's values, and how many rows a range has at least, more or less; keys of fewer have one.
RANGES, SMALL = 1_024, 1_000
#: Items that a sketch keeps, and how far apart the values of two keys lie where a range is looked for; logarithms of doubles stay within a third of it.
SKETCH, STRETCH = 4_096, 2_048


def _spread(key: Column, x: Column) -> Column:
    """A number in the stretch of its key (from 0) that keeps the order of the key's values; some that are close may share it, NaN stays."""
    size = F.least(F.log1p(F.abs(x)), F.lit(STRETCH / 2 - 1))
    return F.when(F.isnan(x), x).otherwise(key * F.lit(float(STRETCH)) + F.signum(x) * size)


def ranged(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``_p``, which orders the ranges that a key's values are in; nulls are in the first. Edges reach the driver: RANGES, or one for SMALL rows of a key at most.

    Sketch and search stay in the JVM: a Bucketizer looks for a value by halving, among the edges of all keys at once.
    """
    x = F.col(value).cast("double") + F.lit(0.0)  # zero has no sign
    step = F.greatest(F.ceil(F.lit(RANGES * SMALL) / F.col("_m")), F.lit(1)) if keys else F.lit(1)
    sketch = rows.groupBy(*keys).agg(F.count(x).alias("_m"), F.kll_sketch_agg_double(F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x), F.lit(SKETCH)).alias("_s")).where(F.col("_m") > (SMALL if keys else 0))
    cuts = F.array_distinct(F.kll_sketch_get_quantile_double("_s", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))))
    found = sketch.select(*keys, step.alias("_step"), cuts.alias("_e")).select(*keys, F.filter("_e", lambda e, i: i % F.col("_step") == 0).alias("_e")).collect()
    edges = [np.array([e for e in r["_e"] if np.isfinite(e)], dtype="float64") for r in found]
    if keys:
        edges = [i * STRETCH + np.sign(e) * np.log1p(np.abs(e)) for i, e in enumerate(edges)]
    splits = np.unique(np.concatenate(edges)).tolist() if edges else []
    if not splits:
        return rows.withColumn("_p", F.lit(0))
    if keys:
        numbers = rows.sparkSession.createDataFrame([(*(r[k] for k in keys), i) for i, r in enumerate(found)], rows.select(*keys, F.lit(0).alias("_k")).schema)
        rows = rows.join(F.broadcast(numbers), keys, "left")
    near = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_y", outputCol="_p", handleInvalid="keep")
    placed = near.transform(rows.withColumn("_y", _spread(F.col("_k"), x) if keys else x))
    return placed.withColumn("_p", F.coalesce(F.col("_p").cast("int"), F.lit(0))).drop("_k", "_y")


def running(counts: DataFrame, keys: list[str], value: str, sums: Sequence[str]) -> DataFrame:
    """``counts`` (keys, value, sums) with ``_before_x`` for each sum x: the sum over the key's smaller values."""
    part = ranged(counts, keys, value)
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = part.groupBy(*keys, "_p").agg(*(F.sum(s).alias(f"_s_{s}") for s in sums))
    whole = whole.select(*keys, "_p", *(F.coalesce(F.sum(f"_s_{s}").over(earlier), F.lit(0)).alias(f"_w_{s}") for s in sums))
    inside = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return part.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(whole, [*keys, "_p"]).withColumns({f"_before_{s}": F.col(f"_i_{s}") + F.col(f"_w_{s}") for s in sums}).drop("_p", *(f"_{k}_{s}" for s in sums for k in "iw"))


def condensed(rows: DataFrame, keys: list[str], value: str, sums: Sequence[str], wanted: Column, total: str | None = None) -> DataFrame:
    """(keys, value, sums, _before_x for each sum x): what ``running`` gives, but value by value only where it is wanted.

    A range that isn't wanted is one row with its least value. ``wanted`` tells
    this by a range's sums x, ``_before_x`` and ``_total_x``, the key's sum; the
    first sum's is called ``total`` if given.
    Values are not null; ranges of one value are whole in any case.
    """
    part = ranged(rows, keys, value)
    earlier, every = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    ranges = part.groupBy(*keys, "_p").agg(*(F.sum(s).alias(s) for s in sums), F.min(value).alias(value), F.max(value).alias("_last"))
    ranges = ranges.select("*", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums), *(F.sum(s).over(every).alias(f"_total_{s}") for s in sums))
    ranges = ranges.withColumn(total, F.col(f"_total_{sums[0]}")) if total else ranges
    ranges = saved(ranges.withColumn("_open", F.coalesce(wanted, F.lit(False)) & (F.col(value) != F.col("_last"))))
    names = [*keys, value, *sums, *(f"_before_{s}" for s in sums)]
    opened = ranges.where("_open").select(*keys, "_p", *(F.col(f"_before_{s}").alias(f"_w_{s}") for s in sums))
    inside = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    held = part.join(opened.select(*keys, "_p"), [*keys, "_p"]).groupBy(*keys, "_p", value).agg(*(F.sum(s).alias(s) for s in sums))
    held = held.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(opened, [*keys, "_p"])
    held = held.withColumns({f"_before_{s}": F.col(f"_i_{s}") + F.col(f"_w_{s}") for s in sums})
    return saved(ranges.where("NOT _open").select(*names).unionByName(held.select(*names)))


def holds(rank: Column, n: str) -> Column:
    """Whether a row of (n, _before_n) holds a rank from 0."""
    return (F.col(f"_before_{n}") <= rank) & (rank < F.col(f"_before_{n}") + F.col(n))


def holds_quantiles(shares: Sequence[float], n: str = "n") -> Column:
    """Whether a row of (n, _before_n, _total_n) holds a value that a quantile needs."""
    at = [(F.col(f"_total_{n}") - 1) * F.lit(float(s)) for s in shares]
    return reduce(Column.__or__, (holds(f(p), n) for p in at for f in (F.floor, F.ceil)))


def _with(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their key's totals, which are one row without keys."""
    return rows.join(totals, keys) if keys else rows.crossJoin(F.broadcast(totals))


def quantiles_by(df: DataFrame, keys: list[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(keys, n, q): the exact quantiles of each key's values, interpolated between ranks; nulls don't count."""
    rows = df.select(*keys, value.cast("double").alias("_v"), F.lit(1).alias("n")).where("_v IS NOT NULL")
    return quantiles_of(condensed(rows, keys, "_v", ["n"], holds_quantiles(shares)), keys, "_v", shares)


def quantiles_of(runs: DataFrame, keys: list[str], value: str, shares: Sequence[float]) -> DataFrame:
    """The same from values that are counted and summed already (keys, value, n, _before_n)."""
    totals = runs.groupBy(*keys).agg(F.sum("n").alias("_n"))
    ranks = _with(runs, totals, keys)
    at = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    ends = [F.max(F.when(holds(f(p), "n"), F.col(value))).alias(f"_{name}{i}") for i, p in enumerate(at) for name, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranks.groupBy(*keys, "_n").agg(*ends)
    # Equal ends give that very value.
    mixed = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p)) for i, p in enumerate(at)]
    return found.select(*keys, F.col("_n").alias("n"), F.array(*mixed).alias("q"))


def values_at(df: DataFrame, keys: list[str], value: Column, ranks: dict[str, Column]) -> DataFrame:
    """(keys, names): the values at whole ranks from 0, which may use ``n``, the key's rows."""
    given = df.select(*keys, value.alias("_v"), F.lit(1).alias("_c")).where("_v IS NOT NULL")
    runs = condensed(given, keys, "_v", ["_c"], reduce(Column.__or__, (holds(r, "_c") for r in ranks.values())), total="n")
    totals = runs.groupBy(*keys).agg(F.sum("_c").alias("n"))
    return _with(runs, totals, keys).groupBy(*keys).agg(*(F.max(F.when(holds(r, "_c"), F.col("_v"))).alias(name) for name, r in ranks.items()))


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of several columns by name; a column without values is missing. One row a column reaches the driver."""
    if not columns:
        return {}
    if len(columns) == 1:
        return {name: r["q"] for name, c in columns.items() for r in quantiles_by(df, [], c, shares).collect()}
    long = df.select(F.inline(F.array(*(F.struct(F.lit(name).alias("_name"), c.cast("double").alias("_value")) for name, c in columns.items()))))
    return {r["_name"]: r["q"] for r in quantiles_by(long, ["_name"], F.col("_value"), shares).collect()}

"""Grouped counts, balances, pivots, quantiles by rank, and what a range misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from agrarium.operators import ranks


def whole() -> WindowSpec:
    """All rows: for tables that an aggregation has made small."""
    return Window.partitionBy()


def grouped(df: DataFrame, key: str, means: dict[str, str], digits: int = 4) -> DataFrame:
    """Count and rounded means by a key that isn't null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.avg(c), digits).alias(name) for name, c in means.items()))


def histogram(df: DataFrame, value: Column, buckets: int = 10) -> DataFrame:
    """Counts by value rounded to a number of buckets from 0 to 1."""
    return df.groupBy(F.round(value * buckets).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def recent_counts(df: DataFrame, at: str, now: Column, hours: dict[str, int]) -> DataFrame:
    """The total, and counts of the last hours before ``now``."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(at) >= now - F.expr(f"INTERVAL {h} HOURS")).alias(name) for name, h in hours.items()))


def slices(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """(dimension, key, measures): one group-by for each key, all in one pass over grouping sets."""
    own = df.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys))
    ids = {k: F.grouping(k) for k in keys}
    grouped_ = own.agg(*(m.alias(n) for n, m in measures.items()), *(g.alias(f"_g_{k}") for k, g in ids.items()))
    which = F.coalesce(*(F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys))
    value = F.coalesce(*(F.when(F.col(f"_g_{k}") == 0, F.coalesce(F.col(k).cast("string"), F.lit("unknown"))) for k in keys))
    return grouped_.select(which.alias("dimension"), value.alias("key"), *measures)


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def class_balance(df: DataFrame, label: str, moderate: float = 2.0, severe: float = 5.0) -> DataFrame:
    """(label, n, share, imbalance, role, strategy) of a bounded number of classes."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total, mean = F.sum("n").over(whole()), F.avg("n").over(whole())
    ratio = F.max("n").over(whole()) / F.min("n").over(whole())
    role = F.when(F.col("n") < mean, "minority").otherwise("majority")
    strategy = F.when(ratio >= severe, "resample").when(ratio >= moderate, "class_weights").otherwise("none")
    return counts.select(label, "n", F.round(F.col("n") / total, 4).alias("share"), F.round(ratio, 4).alias("imbalance"), role.alias("role"), strategy.alias("strategy"))


def class_weights(df: DataFrame, label: str, kind: str = "balanced", beta: float = 0.999) -> DataFrame:
    """(label, weight): ``sum_one`` weights add up to 1; ``balanced``, ``sqrt_inv`` and ``effective_num`` have mean 1."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    n = F.greatest(F.col("n").cast("double"), F.lit(1e-12))
    total, classes = F.sum("n").over(whole()), F.count("*").over(whole())
    raw = {"sum_one": total / (n * classes), "balanced": total / (n * classes), "sqrt_inv": 1 / F.sqrt(n), "effective_num": (1 - beta) / (1 - F.pow(F.lit(beta), n))}[kind]
    weighed = counts.withColumn("raw", raw)
    norm = F.sum("raw").over(whole()) if kind == "sum_one" else F.avg("raw").over(whole())
    return weighed.select(label, F.round(F.col("raw") / norm, 6).alias("weight"))


def dense_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n) for 0 to the largest label, zeros too."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = counts.agg(F.max(label).alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias(label))
    return every.join(counts.withColumn(label, F.col(label).cast("long")), label, "left").na.fill(0, ["n"])


def ranked_quantiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """Least, largest, mean, median, population deviation, and the values at ranks n/4 and 3n/4 (not interpolated)."""
    rows = df.where(F.col(value).isNotNull())
    plain = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"))
    at = {name: F.least(F.floor(F.col("n") * f), F.col("n") - 1) for name, f in (("q25", 0.25), ("q75", 0.75))}
    return plain.join(ranks.values_at(rows, [key], F.col(value), at), key)


def repeated(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Keys held by two rows or more, with the count and the least member."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1")


def off_majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value isn't the most frequent one of their key (ties to the lower value), with that value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    top = counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("majority"))
    return df.join(top, key).where(~F.col(value).eqNullSafe(F.col("majority")))


def missing_in_range(df: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number): whole numbers between a key's least and largest that it doesn't have."""
    held = df.select(key, number).distinct()
    ends = held.groupBy(key).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    return ends.select(key, F.explode(F.sequence("lo", "hi")).alias(number)).join(held, [key, number], "left_anti")


def compared_with_history(df: DataFrame, group: str, value: str, wanted: str) -> DataFrame:
    """Mean and population deviation of one group's past, else of all."""
    own = F.when(F.col(group) == wanted, F.col(value))
    return df.agg(F.count(own).alias("n_own"), F.coalesce(F.avg(own), F.avg(value)).alias("mean"), F.coalesce(F.stddev_pop(own), F.stddev_pop(value)).alias("std"))


def dominant(columns: dict[str, tuple[str, str]]) -> Column:
    """struct(name, area, value): the name with the largest positive area (first of equals), else the largest value."""
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.col(a).alias("area"), F.col(v).alias("value"), F.lit(-i).alias("at")) for i, (name, (a, v)) in enumerate(columns.items())))
    best = lambda by: F.array_max(F.transform(F.filter(rows, lambda r: r[by] > 0), lambda r: F.struct(r[by].alias("k"), r["at"].alias("at"), r["name"].alias("name"), r["area"].alias("area"), r["value"].alias("value"))))
    return F.coalesce(best("area"), best("value"))

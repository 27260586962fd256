"""Profiles, schemas and columns that carry nothing."""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, missing, mean, std, min, max) in one scan and one aggregation; std is the population's."""
    columns = columns or numeric_columns(df, booleans=False)
    one = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing) of nulls."""
    one = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing")) for c in columns or df.columns]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def schema_fingerprint(df: DataFrame) -> str:
    return hashlib.sha256("|".join(sorted(f"{c}:{kind}" for c, kind in df.dtypes)).encode()).hexdigest()


def schema_changes(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    a, b = dict(old.dtypes), dict(new.dtypes)
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "retyped": sorted(c for c in a.keys() & b.keys() if a[c] != b[c])}


def schema_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, change, kind_old, kind_new, n_old, n_new): every column of either side as same, added, removed or retyped, with its values that aren't null."""
    kinds = {"old": dict(old.dtypes), "new": dict(new.dtypes)}
    counted = []
    for side, df in (("old", old), ("new", new)):
        one = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias(f"kind_{side}"), F.count(F.col(f"`{c}`")).alias(f"n_{side}")) for c, kind in kinds[side].items()]
        counted.append(df.agg(F.array(*one).alias("x")).select(F.inline("x")))
    a, b = F.col("kind_old"), F.col("kind_new")
    change = F.when(a.isNull(), "added").when(b.isNull(), "removed").when(a != b, "retyped").otherwise("same")
    return counted[0].join(counted[1], "column", "full").select("column", change.alias("change"), "kind_old", "kind_new", "n_old", "n_new")


def schema_issues(df: DataFrame, most_missing: float = 0.95) -> DataFrame:
    """(severity, code, column): repeated names are errors, columns almost without values warnings."""
    spark = df.sparkSession
    names = [c.lower() for c in df.columns]
    errors = [("error", "no_columns", None)] * (not names) + [("error", "duplicate_column", c) for c in sorted({c for c in names if names.count(c) > 1})]
    found = spark.createDataFrame(errors, "severity string, code string, column string")
    if not names or errors:
        return found
    shares = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("int")).alias("share")) for c in df.columns)).alias("x")).select(F.inline("x"))
    return found.unionByName(shares.where(F.col("share") > most_missing).select(F.lit("warning").alias("severity"), F.lit("mostly_missing").alias("code"), "column"))


def numeric_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, is_numeric): every value is a number, a number's text, blank or null."""
    fine = {c: F.bool_and(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") | F.col(c).try_cast("double").isNotNull()) for c in columns}
    return df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(x, F.lit(True)).alias("is_numeric")) for c, x in fine.items())).alias("x")).select(F.inline("x"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, is_constant, is_missing) without counting distinct values: least and largest tell."""
    one = [F.struct(F.lit(c).alias("column"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("is_constant"), (F.count(c) == 0).alias("is_missing")) for c in columns]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all column pairs, in one aggregation."""
    one = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def drop_correlated(df: DataFrame, columns: list[str], most: float = 0.95) -> DataFrame:
    """``df`` without columns that follow an earlier kept one; the greedy choice runs over the few pairs."""
    strong = {(r["a"], r["b"]) for r in correlations(df, columns).where(F.abs("corr") > most).collect()}
    gone: set[str] = set()
    for b in columns:
        if any((a, b) in strong and a not in gone for a in columns[: columns.index(b)]):
            gone.add(b)
    return df.drop(*gone)


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(validator, failed, checked, passed) of named conditions that hold where something is wrong, in one aggregation."""
    one = [F.struct(F.lit(name).alias("validator"), F.count_if(rule).alias("failed"), F.count("*").alias("checked"), (F.count_if(rule) == 0).alias("passed")) for name, rule in rules.items()]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))

"""Searches, quality rules and retention."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, equal: dict[str, Any] | None = None, least: dict[str, Any] | None = None, most: dict[str, Any] | None = None) -> DataFrame:
    """Rows that meet every given predicate; None, 0 and blank values are skipped; unknown columns are errors."""
    unknown = [c for x in (equal, least, most) for c in x or {} if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown filter columns: {unknown}")
    terms = [F.col(c) == v for c, v in (equal or {}).items() if v] + [F.col(c) >= v for c, v in (least or {}).items() if v] + [F.col(c) <= v for c, v in (most or {}).items() if v]
    return df.where(reduce(Column.__and__, terms)) if terms else df


def federated(tables: dict[str, tuple[DataFrame, str]], text: str, most: int) -> DataFrame:
    """(kind, name) of the tables' names that hold ``text`` in either case, in the order of the tables and then the names."""
    found = [df.where(F.lower(name).contains(text.lower())).select(F.lit(i).alias("_order"), F.lit(kind).alias("kind"), F.col(name).alias("name")) for i, (kind, (df, name)) in enumerate(tables.items())]
    return reduce(DataFrame.unionByName, found).orderBy("_order", "name").limit(most).drop("_order")


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``reasons``: the names of the rules that hold; ``accepted``: none does."""
    reasons = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


#: What an issue of a severity costs.
PENALTIES = {"critical": 40, "error": 25, "warning": 10, "info": 2}


def quality_score(severities: Column) -> Column:
    """100 less the penalties of an array of severities, at least 0."""
    cost = F.create_map(*(F.lit(x) for kv in PENALTIES.items() for x in kv))
    return F.greatest(F.lit(100) - F.aggregate(severities, F.lit(0), lambda s, x: s + F.coalesce(cost[x], F.lit(0))), F.lit(0))


def passes(severities: Column, score: Column, least: int) -> Column:
    return ~F.exists(severities, lambda s: s.isin("critical", "error")) & (score >= least)


def retained(df: DataFrame, created: str, cutoff: Any) -> tuple[DataFrame, DataFrame]:
    """The rows from ``cutoff`` on, and a one-row table of how many go."""
    return df.where(F.col(created) >= F.lit(cutoff)), df.agg(F.count_if(F.col(created) < F.lit(cutoff)).alias("purged"))

"""Drift between a reference and a current table: shares of pooled bins, divergences, distances, categories, time and place."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.functions.geo import cell
from agrarium.operators import ranks
from agrarium.operators.lineage import saved

FLOOR = 1e-4
#: Where low, moderate and high begin.
PSI_LEVELS, JS_LEVELS = (0.10, 0.25), (0.05, 0.10)


def severity(value: Column, levels: tuple[float, float]) -> Column:
    return F.when(value >= levels[1], "high").when(value >= levels[0], "moderate").otherwise("low")


def both(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """(x, side): values of both tables, without nulls."""
    take = lambda df, side: df.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), F.lit(side).alias("side"))
    return take(reference, "ref").unionByName(take(current, "cur"))


def _bin(x: Column, edges: list[float]) -> Column:
    """The bin of a value from 1, by plain comparisons with the edges."""
    reached = reduce(Column.__add__, ((x >= F.lit(e)).cast("int") for e in edges))
    return F.greatest(F.least(reached, F.lit(len(edges) - 1)), F.lit(1))


def binned_shares(sides: DataFrame, bins: int = 10, approximate: int | None = None) -> DataFrame:
    """(bin, ref, cur): shares of both sides in bins of pooled quantiles, at least ``FLOOR`` each.

    Edges are exact quantiles, or with ``approximate`` those of a sketch of
    that accuracy, which needs no shuffle of the values. The edges are one row
    of ``bins`` + 1 numbers.
    """
    at = [i / bins for i in range(bins + 1)]
    rows = sides.select("x", F.lit(1).alias("n"), (F.col("side") == "ref").cast("int").alias("r"), (F.col("side") == "cur").cast("int").alias("c"))
    if approximate is None:
        # Counts of ranges that no edge lies in stand for their values.
        rows = ranks.condensed(rows.withColumn("x", F.col("x").cast("double")), [], "x", ["n", "r", "c"], ranks.holds_quantiles(at))
        found = sorted({q for row in ranks.quantiles_of(rows, [], "x", at).collect() for q in row["q"] or () if q is not None})
    else:
        found = sides.agg(F.array_distinct(F.percentile_approx("x", at, approximate)).alias("e")).first()["e"] or []
    if len(found) < 2:
        return sides.sparkSession.createDataFrame([], "bin int, ref double, cur double")
    counts = rows.groupBy(_bin(F.col("x"), found).alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    every = sides.sparkSession.range(1, len(found)).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    whole = Window.partitionBy()
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(whole), F.lit(FLOOR))
    return every.select("bin", share("r").alias("ref"), share("c").alias("cur"))


def divergences(shares: DataFrame) -> DataFrame:
    """(psi, kl, js) of a table of shares (ref, cur)."""
    r, c = F.col("ref"), F.col("cur")
    m = (r + c) / 2
    return shares.agg(F.sum((c - r) * F.log(c / r)).alias("psi"), F.sum(c * F.log(c / r)).alias("kl"), F.sum((r * F.log(r / m) + c * F.log(c / m)) / 2).alias("js"))


def _steps(sides: DataFrame) -> DataFrame:
    """(x, r, c, dr, dc): distinct values in order with both sides' cumulative shares.

    Values are first counted; the running sums go over ranges of values at
    quantiles of the distinct ones, with the sums of the ranges before added.
    """
    counts = saved(sides.groupBy("x").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c")))
    ends = counts.agg(F.sum("r").alias("r"), F.sum("c").alias("c")).first()
    part = ranks.ranged(counts, [], "x")
    before = part.groupBy("_p").agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"), F.min("x").alias("_first"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_p", F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("_br"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_bc"), F.lead("_first").over(Window.orderBy("_p")).alias("_after"))
    run = Window.partitionBy("_p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    summed = part.withColumn("_sr", F.sum("r").over(run)).withColumn("_sc", F.sum("c").over(run)).withColumn("_next", F.lead("x").over(Window.partitionBy("_p").orderBy("x"))).join(before, "_p")
    return summed.select("x", F.coalesce("_next", "_after").alias("next"), ((F.col("_sr") + F.col("_br")) / F.lit(ends["r"] or 1)).alias("fr"), ((F.col("_sc") + F.col("_bc")) / F.lit(ends["c"] or 1)).alias("fc"))


def ks_and_wasserstein(sides: DataFrame) -> DataFrame:
    """(ks, wasserstein): largest distance of the two distribution functions, and the area between them."""
    gap = F.abs(F.col("fr") - F.col("fc"))
    return _steps(sides).agg(F.max(gap).alias("ks"), F.sum(F.when(F.col("next").isNotNull(), gap * (F.col("next") - F.col("x")))).alias("wasserstein"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic p of a two-sample Kolmogorov-Smirnov distance."""
    if not n or not m:
        return 1.0
    t = math.sqrt(n * m / (n + m)) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def exact_ks_p(d: float, n: int, m: int) -> float:
    """Exact p of a two-sample Kolmogorov-Smirnov distance of samples without ties.

    Drawn in random order, the two samples are a path on a lattice; p is the
    chance that it comes to a distance of at least ``d``. All points of a
    diagonal are one step of a vector, so the cost is n + m vectors of n.
    """
    if not n or not m:
        return 1.0
    n, m = sorted((n, m))
    least = round(d * n * m)  # distances are multiples of 1 / (n m)
    if least <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for step in range(n + m):
        left = n + m - step
        move = inside * np.clip(n - i, 0, None) / left
        inside = inside - move
        inside[1:] += move[:-1]
        j = step + 1 - i
        inside[(j < 0) | (j > m) | (np.abs(i * m - j * n) >= least)] = 0.0
    return float(min(1.0, max(0.0, 1 - inside.sum())))


def ks_test_p(d: Column, n: Column, m: Column, most: int = 10_000) -> Column:
    """p of a distance: exact where neither sample has more than ``most`` values, else by the limiting distribution. For reports of few rows."""

    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else exact_ks_p(a, int(b), int(c)) if max(b, c) <= most else ks_p_value(a, int(b), int(c)) for a, b, c in zip(d, n, m, strict=True)], dtype="float64")

    return p(d, n.cast("double"), m.cast("double"))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_p_value(statistic: float, dof: int) -> float:
    return gamma_q(dof / 2, statistic / 2) if dof > 0 else 1.0


def category_shares(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(column, n_ref, n_cur, ref, cur, shift) of all categories of either side."""
    sides = reference.select(F.col(column), F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(current.select(F.col(column), F.lit(0).alias("_r"), F.lit(1).alias("_c")))
    counts = sides.groupBy(column).agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur"))
    totals = sides.agg(F.sum("_r").alias("_tr"), F.sum("_c").alias("_tc"))  # one row
    share = lambda c, t: F.coalesce(F.col(c) / F.nullif(F.col(t), F.lit(0)), F.lit(0.0))
    shares = counts.crossJoin(F.broadcast(totals)).withColumn("ref", share("n_ref", "_tr")).withColumn("cur", share("n_cur", "_tc")).drop("_tr", "_tc")
    return shares.withColumn("shift", F.col("cur") - F.col("ref"))


def categorical_drift(shares: DataFrame) -> DataFrame:
    """(chi2, dof, js): chi-squared with Yates' correction at one degree of freedom, JS with shares clipped inside the logarithm only."""
    n, r, c = F.col("n_ref") + F.col("n_cur"), F.col("_tr"), F.col("_tc")
    totals = shares.agg(F.sum("n_ref").alias("_tr"), F.sum("n_cur").alias("_tc"), F.count("*").alias("_k"))  # one row
    rows = shares.crossJoin(F.broadcast(totals)).withColumn("_er", n * r / (r + c)).withColumn("_ec", n * c / (r + c))
    off = lambda o, e: F.greatest(F.abs(F.col(o) - F.col(e)) - F.when(F.col("_k") == 2, 0.5).otherwise(0.0), F.lit(0.0))
    chi = off("n_ref", "_er") ** 2 / F.col("_er") + off("n_cur", "_ec") ** 2 / F.col("_ec")
    clip = lambda x: F.greatest(x, F.lit(1e-12))
    m = (F.col("ref") + F.col("cur")) / 2
    js = (F.col("ref") * F.log(clip(F.col("ref")) / clip(m)) + F.col("cur") * F.log(clip(F.col("cur")) / clip(m))) / 2
    return rows.agg(F.sum(chi).alias("chi2"), (F.count("*") - 1).alias("dof"), F.sum(js).alias("js"))


def temporal_psi(df: DataFrame, period: Column, value: str, reference: DataFrame, bins: int = 10) -> DataFrame:
    """(period, n, psi) of each period of ``df`` against the reference's quantile bins; no rows if the reference has fewer than two values."""
    found = sorted(set(ranks.quantiles(reference, {"x": F.col(value)}, [i / bins for i in range(bins + 1)]).get("x", [])))
    if len(found) < 2:
        return df.select(period.alias("period"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("psi")).limit(0)
    number = lambda x: _bin(x, found)
    whole = Window.partitionBy()
    ref = reference.where(F.col(value).isNotNull()).groupBy(number(F.col(value)).alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("n") / F.sum("n").over(whole)).alias("ref"))
    cur = df.where(F.col(value).isNotNull()).groupBy(period.alias("period"), number(F.col(value)).alias("bin")).agg(F.count("*").alias("k"))
    every = cur.groupBy("period").agg(F.sum("k").alias("n")).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(len(found) - 1))))
    rows = every.join(cur, ["period", "bin"], "left").join(ref, "bin", "left")
    r, c = F.greatest(F.coalesce("ref", F.lit(0.0)), F.lit(FLOOR)), F.greatest(F.coalesce("k", F.lit(0)) / F.col("n"), F.lit(FLOOR))
    return rows.groupBy("period").agg(F.first("n").alias("n"), F.sum((c - r) * F.log(c / r)).alias("psi"))


def trend(df: DataFrame, order: str, value: str) -> DataFrame:
    """(slope, r2, direction) of a value over whole-number steps."""
    fitted = df.agg(F.regr_slope(value, order).alias("slope"), F.regr_r2(value, order).alias("r2"))
    return fitted.withColumn("direction", F.when(F.col("slope") > 0, "rising").when(F.col("slope") < 0, "falling").otherwise("flat"))


def novel_cells(reference: DataFrame, current: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    """(cells, novel, share): occupied grid cells of the current table, and those that the reference lacks."""
    cells = lambda df: df.select(cell(F.col(lon), size).alias("x"), cell(F.col(lat), size).alias("y")).distinct()
    known = cells(reference).withColumn("known", F.lit(True))
    rows = cells(current).join(known, ["x", "y"], "left")
    return rows.agg(F.count("*").alias("cells"), F.count_if(F.col("known").isNull()).alias("novel")).withColumn("share", F.col("novel") / F.col("cells"))


def gate(accuracy: Column, incumbent: Column, latency: Column, incumbent_latency: Column, drift: Column, fairness: Column) -> Column:
    """The names of the promotion checks that fail."""
    checks = {
        "accuracy": (accuracy >= 0.80) & (incumbent.isNull() | (accuracy >= incumbent)),
        "latency": incumbent_latency.isNull() | ((latency - incumbent_latency) / incumbent_latency * 100 <= 10),
        "drift": drift != "high",
        "fairness": fairness == "compliant",
    }
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))

"""Drift from mergeable state: KLL sketches and bin counts with Poisson bootstrap weights, gathered in one pass.

A state has a row for each feature and bin: how many values, the same under
``reps`` bootstrap draws, and a sketch of the values. States add up: those of
micro-batches, files or days give that of all their rows. A bootstrap weight is
Poisson(1) by a hash of the row's key, so a row weighs the same whenever and
wherever it is counted, and no draw needs a pass of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrarium.operators.drift import FLOOR, PSI_LEVELS, severity
from agrarium.operators.lineage import saved

STATE = "feature string, bin int, n long, weights array<long>, sketch binary"
#: Where Poisson(1) passes 1, 2, ... in 65,536 equal parts.
CUTS = [round(65_536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(7)]


def rank_error(k: int) -> float:
    """Error of any rank that a KLL sketch of this size tells, with 99 % confidence (a published fit, fixed values)."""
    return 2.446 / k**0.9433


def unpivoted(rows: DataFrame, features: list[str], key: Column) -> DataFrame:
    """(feature, x, key): a row for each value; NaN counts as null."""
    pair = lambda c: F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x"))
    return rows.select(key.alias("key"), F.explode(F.array(*map(pair, features))).alias("v")).select("v.feature", "v.x", "key")


def weights(key: Column, reps: int) -> list[Column]:
    """``reps`` Poisson(1) weights of a row, four from each 64-bit hash."""
    out = []
    for r in range(reps):
        part = F.shiftrightunsigned(F.xxhash64(key, F.lit(r // 4)), 16 * (r % 4)).bitwiseAND(F.lit(65_535))
        out.append(sum((F.when(part >= c, 1).otherwise(0) for c in CUTS[1:]), F.when(part >= CUTS[0], 1).otherwise(0)))
    return out


def bin_of(edges: dict[str, list[float]]) -> Column:
    """The bin, from 1, that x of a feature falls into; beyond the edges the first or last; 1 if it has no edges, 0 for null."""
    out = F.lit(1)
    for name, e in edges.items():
        # Sums of comparisons: few edges, and no search in an array for each row.
        inner = sum((F.when(F.col("x") >= v, 1).otherwise(0) for v in e[1:-1]), F.lit(1))
        out = F.when(F.col("feature") == name, inner).otherwise(out)
    return F.when(F.col("x").isNull(), 0).otherwise(out).cast("int")


def state(rows: DataFrame, features: list[str], key: Column, edges: dict[str, list[float]], reps: int = 40, k: int = 2_000) -> DataFrame:
    """The state of a table: one aggregation, combined by each task before it is shuffled."""
    long = unpivoted(rows, features, key).withColumn("bin", bin_of(edges))
    sums = [F.sum(w).alias(f"w{i}") for i, w in enumerate(weights(F.col("key"), reps))]
    found = long.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"), *sums)
    return found.select("feature", "bin", "n", F.array(*(f"w{i}" for i in range(reps))).cast("array<long>").alias("weights"), "sketch")


def merged(states: DataFrame, reps: int = 40) -> DataFrame:
    """The state of all rows of several states."""
    sums = F.array(*(F.sum(F.col("weights")[i]) for i in range(reps)))
    return states.groupBy("feature", "bin").agg(F.sum("n").alias("n"), sums.alias("weights"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(states: DataFrame, at: list[float]) -> dict[str, list[float]]:
    """Quantiles of each feature by its sketch; as many numbers reach the driver as are asked for. Features without values have none."""
    whole = states.where("bin > 0").groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("s")).where(F.kll_sketch_get_n_double("s") > 0)
    return dict(map(tuple, whole.select("feature", F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, at)))).collect()))


class Reference:
    """What current tables are held against: edges, shares and a grid of ranks of a reference table."""

    def __init__(self, rows: DataFrame, features: list[str], key: Column, bins: int = 10, grid: int = 100, reps: int = 40, k: int = 2_000) -> None:
        self.features, self.key, self.reps, self.k, self.grid = features, key, reps, k, grid
        spark = rows.sparkSession
        first = saved(state(rows, features, key, {f: [0.0, 0.0] for f in features}, 0, k).withColumn("weights", F.lit(None).cast("array<long>")))
        cuts = quantiles(first, [i / bins for i in range(bins + 1)])
        self.edges = {f: e for f, v in cuts.items() if len(e := sorted(set(v))) > 1}
        points = {f: sorted(set(v)) for f, v in quantiles(first, [i / grid for i in range(grid + 1)]).items()}
        # A distance can be largest at a value or just below it.
        self.points = {f: sorted({p for x in v for p in (x, math.nextafter(x, -math.inf))}) for f, v in points.items()}
        counts = state(rows, features, key, self.edges, 0, k).where("bin > 0")
        self.counts = saved(counts.select("feature", "bin", "n"))
        every = spark.createDataFrame([(f, b) for f, e in self.edges.items() for b in range(1, len(e))], "feature string, bin int")
        totals = self.counts.groupBy("feature").agg(F.sum("n").alias("n_ref"))
        shares = every.join(self.counts, ["feature", "bin"], "left").join(totals, "feature").select("feature", "bin", "n_ref", F.greatest(F.coalesce("n", F.lit(0)) / F.col("n_ref"), F.lit(FLOOR)).alias("ref"))
        self.shares = saved(shares)
        self.ranks = dict(map(tuple, self._ranks(first).collect()))

    def _ranks(self, states: DataFrame) -> DataFrame:
        """(feature, ranks): how much of each feature lies at or below the points of the grid."""
        whole = states.where("bin > 0").groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("s")).where(F.kll_sketch_get_n_double("s") > 0)
        out = F.lit(None).cast("array<double>")
        for f, points in self.points.items():
            out = F.when(F.col("feature") == f, F.kll_sketch_get_rank_double("s", F.array(*map(F.lit, points)))).otherwise(out)
        return whole.select("feature", out.alias("ranks"))

    def state(self, rows: DataFrame) -> DataFrame:
        return state(rows, self.features, self.key, self.edges, self.reps, self.k)

    def report(self, states: DataFrame) -> DataFrame:
        """(feature, n, nulls, psi, psi_low, psi_high, ks, ks_error, severity) of the rows of some states.

        psi is exact for the reference's edges, psi_low and psi_high are its 2.5
        and 97.5 % bootstrap bounds; ks is within ks_error of the exact
        distance, with the sketches' 99 % confidence. Features without values on
        either side have nulls.
        """
        spark, whole = states.sparkSession, saved(merged(states, self.reps))
        one = whole.where("bin > 0").select("feature", "bin", F.posexplode(F.concat(F.array("n"), "weights")).alias("r", "w"))
        totals = one.groupBy("feature", "r").agg(F.sum("w").alias("t")).where("t > 0")
        rows = self.shares.join(totals, "feature").join(one, ["feature", "bin", "r"], "left")
        c, ref = F.greatest(F.coalesce("w", F.lit(0)) / F.col("t"), F.lit(FLOOR)), F.col("ref")
        psis = rows.groupBy("feature", "r").agg(F.sum((c - ref) * F.log(c / ref)).alias("psi"))
        draws = F.when(F.col("r") > 0, F.col("psi"))
        psi = psis.groupBy("feature").agg(F.max(F.when(F.col("r") == 0, F.col("psi"))).alias("psi"), F.percentile(draws, 0.025).alias("psi_low"), F.percentile(draws, 0.975).alias("psi_high"))
        held = spark.createDataFrame([(f, r) for f, r in self.ranks.items() if r], "feature string, own array<double>")
        gap = F.array_max(F.zip_with("own", "ranks", lambda a, b: F.abs(a - b)))
        ks = self._ranks(whole).join(held, "feature").select("feature", gap.alias("ks"), F.lit(4 * rank_error(self.k) + 1 / self.grid).alias("ks_error"))
        counts = whole.groupBy("feature").agg(F.sum(F.when(F.col("bin") > 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)).alias("nulls"))
        return counts.join(psi, "feature", "left").join(ks, "feature", "left").withColumn("severity", F.when(F.col("psi").isNotNull(), severity(F.col("psi"), PSI_LEVELS)))

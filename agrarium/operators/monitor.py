"""Drift of many columns at once, of predictions and of places, and what a monitor makes of it.

All columns go through the same few aggregations as (feature, side, x) rows;
results are tidy tables (section, key, severity, drifted, metric, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.operators import drift, ranks
from agrarium.operators.lineage import saved

LEVELS = ("low", "moderate", "high")
TIDY = ("section", "key", "severity", "drifted", "metric", "value")
#: Rows a side needs, the significance of a test, and the JS beyond which categories have drifted.
LEAST_ROWS, ALPHA, JS_LIMIT = 30, 0.05, 0.05


def sides_of(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, side, x) of numeric columns of both tables, without nulls."""
    one = lambda df, side: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(side).alias("side"), F.col(c).cast("double").alias("x")) for c in columns)))).where("x IS NOT NULL")
    return one(reference, "ref").unionByName(one(current, "cur"))


def worst(*severities: Column) -> Column:
    """The highest of some severities; null if all are."""
    rank = F.greatest(*(F.array_position(F.array(*map(F.lit, LEVELS)), s) for s in severities)) if len(severities) > 1 else F.array_position(F.array(*map(F.lit, LEVELS)), severities[0])
    return F.try_element_at(F.array(*map(F.lit, LEVELS)), rank.cast("int"))


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p of a two-sample Kolmogorov-Smirnov distance."""
    t = F.sqrt(n * m / (n + m)) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * t * t))
    p = 2.0 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def numeric(sides: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, n_ref, n_cur, psi, kl, js, ks, p, severity, drifted) of (feature, side, x).

    Bins are pooled quantiles of each feature. A side of fewer than LEAST_ROWS
    rows gives neither severity nor drift.
    """
    at, n_ref, n_cur = [i / bins for i in range(bins + 1)], F.nullif(F.col("_total_r"), F.lit(0)), F.nullif(F.col("_total_c"), F.lit(0))
    ref, cur = ((F.col(f"_before_{k}") / n, (F.col(f"_before_{k}") + F.col(k)) / n) for k, n in (("r", n_ref), ("c", n_cur)))
    # Inside a range the distance is at most ``most``; where the end of some range has as much, its values can't change the largest.
    most = F.greatest(ref[1] - cur[0], cur[1] - ref[0])
    wanted = ranks.holds_quantiles(at) | F.coalesce(most > F.max(F.abs(ref[1] - cur[1])).over(Window.partitionBy("feature")), F.lit(False))
    # Where sides are alike nearly every value counts for the distance; equal ones are one row from here on, so that rows are read once.
    rows = saved(sides.groupBy("feature", "x").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c")))
    # Quantiles, bins and distances are read off the same running sums; no edge of a bin lies inside a range that is one row.
    runs = ranks.condensed(rows, ["feature"], "x", ["n", "r", "c"], wanted)
    totals = saved(runs.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur")))
    edges = ranks.quantiles_of(runs.withColumn("x", F.col("x").cast("double")), ["feature"], "x", at).select("feature", F.array_sort(F.array_distinct("q")).alias("e"))
    edges = saved(edges.where(F.size("e") > 1))
    place = F.greatest(F.least(F.size(F.filter("e", lambda e: e <= F.col("x"))), F.size("e") - 1), F.lit(1))
    held = runs.join(F.broadcast(edges), "feature").groupBy("feature", place.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    every = edges.select("feature", F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("bin")).join(held, ["feature", "bin"], "left").na.fill(0).join(totals, "feature")
    ref, cur = (F.greatest(F.col(k) / F.nullif(F.col(n), F.lit(0)), F.lit(drift.FLOOR)) for k, n in (("r", "n_ref"), ("c", "n_cur")))
    shares = every.select("feature", ref.alias("ref"), cur.alias("cur"))
    r, c = F.col("ref"), F.col("cur")
    m = (r + c) / 2
    found = shares.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"), F.sum(c * F.log(c / r)).alias("kl"), F.sum((r * F.log(r / m) + c * F.log(c / m)) / 2).alias("js"))
    runs = runs.join(F.broadcast(totals), "feature")
    gap = F.abs((F.col("_before_r") + F.col("r")) / F.nullif(F.col("n_ref"), F.lit(0)) - (F.col("_before_c") + F.col("c")) / F.nullif(F.col("n_cur"), F.lit(0)))
    rows = totals.join(found, "feature", "left").join(runs.groupBy("feature").agg(F.max(gap).alias("ks")), "feature", "left")
    rows = rows.withColumn("p", ks_p(F.col("ks"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double")))
    enough = (F.col("n_ref") >= LEAST_ROWS) & (F.col("n_cur") >= LEAST_ROWS)
    severity = worst(drift.severity(F.col("psi"), drift.PSI_LEVELS), drift.severity(F.col("js"), drift.JS_LEVELS))
    return rows.withColumn("severity", F.when(enough, severity)).withColumn("drifted", F.coalesce(enough & (F.col("p") < ALPHA), F.lit(False)))


def categorical(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(feature, chi2, dof, p, js, novel, vanished, severity, drifted) of one column; the test's p is taken on the driver."""
    shares = saved(drift.category_shares(reference, current, column))
    found = drift.categorical_drift(shares).crossJoin(shares.agg(F.count_if(F.col("n_ref") == 0).alias("novel"), F.count_if(F.col("n_cur") == 0).alias("vanished")))
    row = found.first()
    p = drift.chi2_p_value(row["chi2"] or 0.0, row["dof"])
    return found.select(F.lit(column).alias("feature"), "chi2", "dof", F.lit(p).alias("p"), "js", "novel", "vanished", drift.severity(F.col("js"), drift.JS_LEVELS).alias("severity"), ((F.lit(p) < ALPHA) | (F.col("js") > JS_LIMIT)).alias("drifted"))


def predictions(reference: DataFrame, current: DataFrame, probabilities: str) -> DataFrame:
    """(js, chi2, dof, entropy_shift, confidence_shift, severity, drifted) of two tables of class probabilities.

    JS is that of the mean probabilities, chi-squared that of the likeliest classes.
    """
    from agrarium.functions.arrays import entropy, top_classes

    p = F.col(probabilities)
    one = lambda df, side: df.select(F.lit(side).alias("side"), p.alias("p"), top_classes(p, 1)[0]["i"].alias("top"), entropy(p).alias("bits"), F.array_max(p).alias("most"))
    both = saved(one(reference, "ref").unionByName(one(current, "cur")))
    means = both.select("side", F.posexplode("p").alias("k", "v")).groupBy("k").agg(F.avg(F.when(F.col("side") == "ref", F.col("v"))).alias("ref"), F.avg(F.when(F.col("side") == "cur", F.col("v"))).alias("cur"))
    m = (F.col("ref") + F.col("cur")) / 2
    clip = lambda x: F.greatest(x, F.lit(1e-12))
    js = means.agg(F.sum((F.col("ref") * F.log(clip(F.col("ref")) / clip(m)) + F.col("cur") * F.log(clip(F.col("cur")) / clip(m))) / 2).alias("js"))
    tops = drift.categorical_drift(drift.category_shares(both.where("side = 'ref'"), both.where("side = 'cur'"), "top")).select("chi2", "dof")
    shift = lambda c: F.avg(F.when(F.col("side") == "cur", F.col(c))) - F.avg(F.when(F.col("side") == "ref", F.col(c)))
    found = js.crossJoin(tops).crossJoin(both.agg(shift("bits").alias("entropy_shift"), shift("most").alias("confidence_shift")))
    row = found.first()
    p_value = drift.chi2_p_value(row["chi2"] or 0.0, row["dof"])
    return found.withColumn("severity", drift.severity(F.col("js"), drift.JS_LEVELS)).withColumn("drifted", (F.lit(p_value) < ALPHA) | (F.col("js") > JS_LIMIT))


def places(reference: DataFrame, current: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    """(cells, novel, share, mean_km, severity, drifted): cells that only the current side occupies, and how far its places are from the nearest reference on average."""
    from agrarium.operators.spatial import nearest

    cells = drift.novel_cells(reference, current, lon, lat, size)
    # Each spot is asked once and has its rows' number beside it; keys are numbers, which rows are ordered by far faster than by coordinates.
    asked = saved(current.groupBy(F.col(lon).alias("lon"), F.col(lat).alias("lat")).agg(F.count("*").alias("_n")).withColumn("_a", F.monotonically_increasing_id()))
    held = saved(reference.select(F.col(lon).alias("place_lon"), F.col(lat).alias("place_lat")).distinct().withColumn("_b", F.monotonically_increasing_id()))
    mean = nearest(asked, held, "_a", "_b", 1).agg((F.sum(F.col("_n") * F.col("distance_km")) / F.sum("_n")).alias("mean_km"))
    severity = drift.severity(F.col("share"), drift.PSI_LEVELS)
    return cells.crossJoin(mean).withColumn("severity", severity).withColumn("drifted", F.col("severity") == "high")


def tidy(rows: DataFrame, section: str, key: str | None, metrics: list[str]) -> DataFrame:
    """One row for each metric of a result with severity and drifted."""
    named = rows.select(F.lit(section).alias("section"), (F.col(key) if key else F.lit(section)).alias("key"), "severity", "drifted", *(F.col(m).cast("double").alias(m) for m in metrics))
    return named.unpivot(["section", "key", "severity", "drifted"], metrics, "metric", "value")


def monitor(*sections: DataFrame) -> DataFrame:
    """Tidy sections with an overall row: the worst severity, and whether anything has drifted."""
    every = saved(reduce(DataFrame.unionByName, sections))  # sections are taken once for their rows and the overall one
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))
    overall = every.agg(F.max(rank).alias("r"), F.bool_or("drifted").alias("drifted"))
    top = F.coalesce(F.try_element_at(F.array(*map(F.lit, LEVELS)), F.col("r").cast("int")), F.lit("low"))
    return every.unionByName(overall.select(F.lit("overall").alias("section"), F.lit("overall").alias("key"), top.alias("severity"), F.coalesce("drifted", F.lit(False)).alias("drifted"), F.lit("severity").alias("metric"), F.coalesce(F.col("r") - 1, F.lit(0)).cast("double").alias("value")))


def gauges(report: DataFrame) -> DataFrame:
    """(section, gauge): the worst severity of each section as a number from 0."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.coalesce("severity", F.lit("low"))) - 1
    return report.groupBy("section").agg(F.max(rank).cast("int").alias("gauge"))

"""Drift, fairness, calibration and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrarium.functions import arrays
from agrarium.operators import drift, evaluation, ranks
from agrarium.plans.alignment import place, place_sql
from agrarium.plans.registry import query
from agrarium.sources.tables import table


def _sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return drift.both(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), "l_extendedprice")


BINS = """WITH u AS (SELECT l_extendedprice AS x, l_returnflag = 'R' AS ref FROM lineitem),
e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM u),
b AS (SELECT least(len(list_filter(e, lambda v: v <= x)), len(e) - 1) AS bin, ref FROM u, e),
c AS (SELECT bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM b GROUP BY 1),
s AS (SELECT bin, greatest(r / sum(r) OVER (), 1e-4) AS r, greatest(c / sum(c) OVER (), 1e-4) AS c FROM c)"""


@query(BINS + " SELECT CAST(bin AS INT) AS bin, round(r, 6) AS ref, round(c, 6) AS cur FROM s")
def drift_bins(spark: SparkSession, d: str) -> DataFrame:
    return drift.binned_shares(_sides(spark, d)).withColumns({"ref": F.round("ref", 6), "cur": F.round("cur", 6)})


@query(BINS + " SELECT round(sum((c - r) * ln(c / r)), 8) AS psi, round(sum(c * ln(c / r)), 8) AS kl, round(sum((r * ln(r / ((r + c) / 2)) + c * ln(c / ((r + c) / 2))) / 2), 8) AS js FROM s")
def psi_kl_js(spark: SparkSession, d: str) -> DataFrame:
    found = drift.divergences(drift.binned_shares(_sides(spark, d)))
    return found.select(*(F.round(c, 8).alias(c) for c in ("psi", "kl", "js")))


@query("""WITH u AS (SELECT l_extendedprice AS x, l_returnflag = 'R' AS ref FROM lineitem), v AS (SELECT x, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM u GROUP BY 1),
f AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, abs(sum(r) OVER (ORDER BY x) / sum(r) OVER () - sum(c) OVER (ORDER BY x) / sum(c) OVER ()) AS g FROM v) SELECT round(max(g), 8) AS ks, round(sum(g * (nx - x)), 4) AS wasserstein FROM f""")
def ks_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return drift.ks_and_wasserstein(_sides(spark, d)).select(F.round("ks", 8).alias("ks"), F.round("wasserstein", 4).alias("wasserstein"))


CATS = "WITH c AS (SELECT o_orderpriority AS k, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS r, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS c FROM orders GROUP BY 1), s AS (SELECT *, r / sum(r) OVER () AS p, c / sum(c) OVER () AS q, (r + c) * sum(r) OVER () / (sum(r) OVER () + sum(c) OVER ()) AS er, (r + c) * sum(c) OVER () / (sum(r) OVER () + sum(c) OVER ()) AS ec FROM c)"


def _categories(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return drift.category_shares(rows.where(F.col("o_orderdate") < cut), rows.where(F.col("o_orderdate") >= cut), "o_orderpriority")


@query(CATS + " SELECT k AS o_orderpriority, r AS n_ref, c AS n_cur, round(q - p, 8) AS shift FROM s")
def category_shifts(spark: SparkSession, d: str) -> DataFrame:
    return _categories(spark, d).select("o_orderpriority", "n_ref", "n_cur", F.round("shift", 8).alias("shift"))


@query(CATS + " SELECT round(sum(pow(r - er, 2) / er + pow(c - ec, 2) / ec), 6) AS chi2, count(*) - 1 AS dof, round(sum((p * ln(greatest(p, 1e-12) / greatest((p + q) / 2, 1e-12)) + q * ln(greatest(q, 1e-12) / greatest((p + q) / 2, 1e-12))) / 2), 8) AS js FROM s")
def categorical_drift(spark: SparkSession, d: str) -> DataFrame:
    found = drift.categorical_drift(_categories(spark, d))
    return found.select(F.round("chi2", 6).alias("chi2"), "dof", F.round("js", 8).alias("js"))


@query("""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM events),
b AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, least(len(list_filter(e, lambda v: v <= value)), len(e) - 1) AS bin FROM events, e),
r AS (SELECT bin, count(*) / sum(count(*)) OVER () AS r FROM b GROUP BY 1), n AS (SELECT period, count(*) AS n FROM b GROUP BY 1), c AS (SELECT period, bin, count(*) AS k FROM b GROUP BY ALL)
SELECT period, n, round(sum((greatest(coalesce(k, 0) / n, 1e-4) - greatest(r, 1e-4)) * ln(greatest(coalesce(k, 0) / n, 1e-4) / greatest(r, 1e-4))), 6) AS psi FROM n CROSS JOIN r LEFT JOIN c USING (period, bin) GROUP BY ALL""")
def temporal_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    found = drift.temporal_psi(rows, F.to_date(F.date_trunc("week", "ts")), "value", rows)
    return found.select("period", "n", F.round("psi", 6).alias("psi"))


@query("WITH w AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, avg(value) AS v FROM events GROUP BY 1) SELECT round(regr_slope(v, i), 6) AS slope, round(regr_r2(v, i), 6) AS r2, CASE WHEN regr_slope(v, i) > 0 THEN 'rising' WHEN regr_slope(v, i) < 0 THEN 'falling' ELSE 'flat' END AS direction FROM w")
def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("i")).agg(F.avg("value").alias("v"))
    return drift.trend(days, "i", "v").select(F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "direction")


@query(f"WITH c AS (SELECT DISTINCT floor(lon / 10) AS x, floor(lat / 10) AS y FROM (SELECT {place_sql('c_custkey')} FROM customer)), s AS (SELECT DISTINCT floor(lon / 10) AS x, floor(lat / 10) AS y FROM (SELECT {place_sql('s_suppkey')} FROM supplier)) SELECT count(*) AS cells, count(*) FILTER (s.x IS NULL) AS novel, round(count(*) FILTER (s.x IS NULL) / count(*), 6) AS share FROM c LEFT JOIN s ON c.x = s.x AND c.y = s.y")
def spatial_drift(spark: SparkSession, d: str) -> DataFrame:
    places = lambda name, key: table(spark, d, name).select(*(v.alias(k) for k, v in place(key).items()))
    return drift.novel_cells(places("supplier", "s_suppkey"), places("customer", "c_custkey"), "lon", "lat", 10.0).withColumn("share", F.round("share", 6))


SCORED = "(SELECT l_linestatus AS g, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS p, least(l_discount * 10, 1) AS score FROM lineitem)"
RATES = f"(SELECT g, count(*) AS support, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM {SCORED} GROUP BY 1)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("p"), F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("score"))


@query(f"SELECT g, support, tp, fp, tn, fn, round((tp + fn) / support, 6) AS base_rate, round((tp + tn) / support, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round(tn / (fp + tn), 6) AS tnr, round(fn / (tp + fn), 6) AS fnr FROM {RATES}")
def fairness_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluation.group_rates(_scored(spark, d), "g", "y", "p")
    return rates.select("g", "support", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("base_rate", "accuracy", "precision", "recall", "fpr", "tnr", "fnr")))


@query(f"WITH r AS (SELECT (tp + fn) / support AS base_rate, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, (tp + tn) / support AS accuracy FROM {RATES}), v AS (SELECT 'base_rate' AS metric, max(base_rate) - min(base_rate) AS spread, min(base_rate) / max(base_rate) AS ratio, 0.1 AS a, 0.2 AS b FROM r UNION ALL SELECT 'tpr', max(tpr) - min(tpr), min(tpr) / max(tpr), 0.1, 0.2 FROM r UNION ALL SELECT 'fpr', max(fpr) - min(fpr), min(fpr) / max(fpr), 0.1, 0.2 FROM r UNION ALL SELECT 'accuracy', max(accuracy) - min(accuracy), min(accuracy) / max(accuracy), 0.05, 0.1 FROM r) SELECT metric, round(spread, 6) AS spread, round(ratio, 6) AS ratio, CASE WHEN spread <= a THEN 'compliant' WHEN spread <= b THEN 'at_risk' ELSE 'violating' END AS status FROM v")
def fairness_verdicts(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.verdicts(evaluation.group_rates(_scored(spark, d), "g", "y", "p"))
    return found.select("metric", F.round("spread", 6).alias("spread"), F.round("ratio", 6).alias("ratio"), "status")


@query(f"SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(y), 6) AS accuracy FROM {SCORED} GROUP BY 1")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration(_scored(spark, d), F.col("score"), F.col("y") == 1).withColumns({"confidence": F.round("confidence", 6), "accuracy": F.round("accuracy", 6)})


@query(f"WITH b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(score) - avg(y)) AS gap FROM {SCORED} GROUP BY 1) SELECT round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.calibration_error(evaluation.calibration(_scored(spark, d), F.col("score"), F.col("y") == 1))
    return found.select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query(f"WITH s AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {SCORED} GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) SELECT round(sum(p * (b + n / 2)) / (sum(p) * sum(n)), 8) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM b")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc_auc(_scored(spark, d), "score", "y").withColumn("auc", F.round("auc", 8))


@query(f"WITH s AS (SELECT CAST(floor(score * 100) AS INT) AS b, count(*) FILTER (y = 1) AS p, count(*) AS n FROM {SCORED} GROUP BY 1) SELECT b / 100 AS threshold, round(sum(p) OVER w / sum(n) OVER w, 6) AS precision, round(sum(p) OVER w / sum(p) OVER (), 6) AS recall FROM s WINDOW w AS (ORDER BY b DESC)")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pr_curve(_scored(spark, d), "score", "y").withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def _classes(spark: SparkSession, d: str) -> DataFrame:
    guess = F.when(F.col("o_orderkey") % 4 == 0, F.lit("5-LOW")).otherwise(F.col("o_orderpriority"))
    return evaluation.confusion(table(spark, d, "orders").withColumn("guess", guess), "o_orderpriority", "guess")


CLASSES = "(SELECT o_orderpriority AS truth, CASE WHEN o_orderkey % 4 = 0 THEN '5-LOW' ELSE o_orderpriority END AS predicted FROM orders)"


@query(f"SELECT truth, predicted, count(*) AS n FROM {CLASSES} GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


PRF = f"WITH c AS (SELECT * FROM {CLASSES}), t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = predicted) AS tp FROM c GROUP BY 1), g AS (SELECT predicted AS label, count(*) AS guessed FROM c GROUP BY 1), m AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp / nullif(guessed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM t FULL JOIN g USING (label)), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)"


@query(PRF + " SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def multiclass_prf(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_class(_classes(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(PRF + f" SELECT round(avg(r), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round((SELECT avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END) FROM {CLASSES}), 6) AS accuracy FROM f")
def multiclass_averages(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.averages(_classes(spark, d))
    return found.select(*(F.round(c, 6).alias(c) for c in ("balanced_accuracy", "macro_f1", "weighted_f1", "accuracy")))


@query("WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), k AS (SELECT label, list_transform(list_sort(list_transform(range(1, len(v) + 1), lambda i: {'n': -v[i], 'i': i - 1}))[1:3], lambda s: s.i) AS top FROM r) SELECT round(avg(CASE WHEN list_contains(top, label) THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM k")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", arrays.softmax(F.col("embedding")).alias("p"))
    return evaluation.top_k_accuracy(rows, "p", "label", 3).withColumn("accuracy", F.round("accuracy", 6))


@query("WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS v FROM embeddings), s AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM r) SELECT vec_id, round(list_sum(list_transform(p, lambda x: -x * log2(x))), 6) AS bits, round(list_max(p), 6) AS top FROM s")
def entropy_and_top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", arrays.softmax(F.col("embedding")).alias("p"))
    return rows.select("vec_id", F.round(arrays.entropy(F.col("p")), 6).alias("bits"), F.round(arrays.top_classes(F.col("p"), 3)[0]["p"], 6).alias("top"))


GUESS = "(SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"), "l_returnflag")


@query(f"SELECT count(*) AS n, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(quantile_disc(abs(y - p), 0.5), 4) AS median_ae, round(avg(y - p), 4) AS bias, round(max(abs(y - p)), 4) AS max_error, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs((y - p) / y)), 6) AS mape, round(avg(CASE WHEN abs(y - p) <= 0.1 * abs(y) THEN 1 ELSE 0 END), 6) AS within FROM {GUESS}")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.regression_metrics(_guessed(spark, d), "y", "p")
    return found.select("n", *(F.round(c, 4).alias(c) for c in ("rmse", "mae", "median_ae", "bias", "max_error")), *(F.round(c, 6).alias(c) for c in ("r2", "mape", "within")))


@query(f"SELECT l_orderkey, l_linenumber, round(abs(y - p), 4) AS abs_error FROM {GUESS} WHERE abs(y - p) > (SELECT quantile_cont(abs(y - p), 0.95) FROM {GUESS})")
def error_outliers(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.outliers(_guessed(spark, d), "y", "p").select("l_orderkey", "l_linenumber", F.round("abs_error", 4).alias("abs_error"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 4) AS mae, round(avg(l_quantity * 1500 - l_extendedprice), 4) AS bias FROM lineitem GROUP BY 1")
def group_errors(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.group_errors(_guessed(spark, d), "l_returnflag", "y", "p")
    return found.select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("bias", 4).alias("bias"))


@query("SELECT round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(min(value), 4) AS min FROM events")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.latency(table(spark, d, "events"), "value")
    return found.select(*(F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "p99", "min")))


@query("""WITH RECURSIVE u AS (SELECT n_nationkey AS k, s_suppkey, s_acctbal AS x, s_nationkey = n_nationkey AS own FROM supplier, nation), t AS (SELECT k, count(*) FILTER (own) AS n, count(*) FILTER (NOT own) AS m FROM u GROUP BY 1 HAVING count(*) FILTER (own) > 0),
v AS (SELECT k, x, count(*) FILTER (own) AS r, count(*) FILTER (NOT own) AS c FROM u GROUP BY ALL), w AS (SELECT k, sum(r) OVER o AS r, sum(c) OVER o AS c FROM v WINDOW o AS (PARTITION BY k ORDER BY x)),
d AS (SELECT k, n, m, max(abs(r * m - c * n))::BIGINT AS d FROM w JOIN t USING (k) GROUP BY ALL),
p AS (SELECT k, n, m, d, 0 AS step, 0 AS i, 1.0::DOUBLE AS w FROM d UNION ALL SELECT k, n, m, d, step, i, sum(w) FROM (SELECT k, n, m, d, step + 1 AS step, i + s AS i, w * CASE WHEN s = 1 THEN (n - i) / (n + m - step)::DOUBLE ELSE (m - step + i) / (n + m - step)::DOUBLE END AS w FROM p, (SELECT unnest([0, 1]) AS s) WHERE step < n + m) WHERE w > 0 AND abs(i * m - (step - i) * n) < d GROUP BY ALL)
SELECT d.k AS nation, d.n, round(d.d / (d.n * d.m)::DOUBLE, 6) AS ks, round(1 - coalesce(w, 0), 6) AS p FROM d LEFT JOIN p ON p.k = d.k AND p.step = d.n + d.m""")
def small_sample_drift(spark: SparkSession, d: str) -> DataFrame:
    """Balances of each nation's few suppliers against those of all others: the distance, and its exact p."""
    rows = table(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("x"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    every = rows.groupBy("x").agg(F.count("*").alias("c"))
    own = rows.groupBy(F.col("s_nationkey").alias("nation"), "x").agg(F.count("*").alias("r"))
    total = every.agg(F.sum("c").alias("total"))
    sizes = own.groupBy("nation").agg(F.sum("r").alias("n")).join(nations, "nation").crossJoin(F.broadcast(total)).withColumn("m", F.col("total") - F.col("n"))
    # The distance is largest at a value of the few, or just below one: only these need the others' shares.
    ranked = ranks.running(every.withColumn("g", F.lit(0)), ["g"], "x", ["c"]).select("x", (F.col("_before_c") + F.col("c")).alias("upto"), F.col("_before_c").alias("below"))
    steps = own.join(ranked, "x").join(sizes, "nation")
    order = Window.partitionBy("nation").orderBy("x")
    at = F.sum("r").over(order)
    below = at - F.col("r")
    gap = lambda mine, all_: F.abs(mine * F.col("m") - (all_ - mine) * F.col("n"))
    found = steps.withColumn("d", F.greatest(gap(at, F.col("upto")), gap(below, F.col("below")))).groupBy("nation", "n", "m").agg((F.max("d") / (F.col("n") * F.col("m"))).alias("ks"))
    return found.select("nation", "n", F.round("ks", 6).alias("ks"), F.round(drift.ks_test_p(F.col("ks"), F.col("n"), F.col("m")), 6).alias("p"))

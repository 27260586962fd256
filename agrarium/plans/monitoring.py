"""Drift monitors, fairness over attributes, curves and reports over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.functions import arrays
from agrarium.operators import drift, evaluation, monitor
from agrarium.plans.alignment import KM, place, place_sql
from agrarium.plans.registry import query
from agrarium.sources.tables import table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TENTHS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def level_sql(x: str, a: float, b: float) -> str:
    return f"CASE WHEN {x} >= {b} THEN 2 WHEN {x} >= {a} THEN 1 ELSE 0 END"


def numeric_sql(rows: str) -> str:
    """SQL of monitor.numeric over (feature, x, ref)."""
    t = "sqrt(n_ref * n_cur / (n_ref + n_cur)) * ks"
    p = f"CASE WHEN {t} < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * pow({t}, 2)))), 0), 1) END"
    return f"""WITH u AS ({rows}), e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {TENTHS}))) AS e FROM u GROUP BY 1),
b AS (SELECT feature, greatest(least(len(list_filter(e, lambda v: v <= x)), len(e) - 1), 1) AS bin, ref FROM u JOIN e USING (feature)), k AS (SELECT feature, unnest(range(1, len(e))) AS bin FROM e),
t AS (SELECT feature, count(*) FILTER (ref) AS n_ref, count(*) FILTER (NOT ref) AS n_cur FROM u GROUP BY 1), c AS (SELECT feature, bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM b GROUP BY ALL),
s AS (SELECT feature, greatest(coalesce(r, 0) / n_ref, 1e-4) AS r, greatest(coalesce(c, 0) / n_cur, 1e-4) AS c FROM k LEFT JOIN c USING (feature, bin) JOIN t USING (feature)),
d AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi, sum(c * ln(c / r)) AS kl, sum((r * ln(r / ((r + c) / 2)) + c * ln(c / ((r + c) / 2))) / 2) AS js FROM s GROUP BY 1),
v AS (SELECT feature, x, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM u GROUP BY ALL), w AS (SELECT feature, sum(r) OVER o AS r, sum(c) OVER o AS c FROM v WINDOW o AS (PARTITION BY feature ORDER BY x)),
g AS (SELECT feature, max(abs(r / n_ref - c / n_cur)) AS ks FROM w JOIN t USING (feature) GROUP BY 1), f AS (SELECT *, {p} AS p FROM t JOIN d USING (feature) JOIN g USING (feature))
SELECT feature, n_ref, n_cur, round(psi, 6) AS psi, round(kl, 6) AS kl, round(js, 6) AS js, round(ks, 6) AS ks, ['low', 'moderate', 'high'][1 + greatest({level_sql('psi', 0.1, 0.25)}, {level_sql('js', 0.05, 0.1)})] AS severity, p < 0.05 AS drifted FROM f"""


def _numbers(found: DataFrame) -> DataFrame:
    return found.select("feature", "n_ref", "n_cur", *(F.round(c, 6).alias(c) for c in ("psi", "kl", "js", "ks")), "severity", "drifted")


FEATURES_SQL = numeric_sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, l_returnflag = 'R' AS ref FROM lineitem" for c in COLUMNS))


def _feature_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return monitor.numeric(monitor.sides_of(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), COLUMNS))


@query(FEATURES_SQL)
def feature_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of all numeric columns at once."""
    return _numbers(_feature_drift(spark, d))


CUT = "TIMESTAMP '1998-01-01'"
LABEL_SQL = numeric_sql(f"SELECT 'o_totalprice' AS feature, o_totalprice AS x, o_orderdate < {CUT} AS ref FROM orders")


def _label_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return monitor.numeric(monitor.sides_of(rows.where(F.col("o_orderdate") < cut), rows.where(F.col("o_orderdate") >= cut), ["o_totalprice"]))


@query(LABEL_SQL)
def label_drift_regression(spark: SparkSession, d: str) -> DataFrame:
    """Drift of a number that is predicted."""
    return _numbers(_label_drift(spark, d))


CLASS_SQL = f"""WITH c AS (SELECT o_orderpriority AS k, count(*) FILTER (o_orderdate < {CUT}) AS r, count(*) FILTER (o_orderdate >= {CUT}) AS c FROM orders GROUP BY 1),
s AS (SELECT *, r / sum(r) OVER () AS p, c / sum(c) OVER () AS q, (r + c) * sum(r) OVER () / (sum(r) OVER () + sum(c) OVER ()) AS er, (r + c) * sum(c) OVER () / (sum(r) OVER () + sum(c) OVER ()) AS ec FROM c),
t AS (SELECT sum(pow(r - er, 2) / er + pow(c - ec, 2) / ec) AS chi2, sum((p * ln(greatest(p, 1e-12) / greatest((p + q) / 2, 1e-12)) + q * ln(greatest(q, 1e-12) / greatest((p + q) / 2, 1e-12))) / 2) AS js, count(*) FILTER (r = 0) AS novel, count(*) FILTER (c = 0) AS vanished FROM s)
SELECT 'o_orderpriority' AS feature, round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p, round(js, 8) AS js, novel, vanished, ['low', 'moderate', 'high'][1 + {level_sql('js', 0.05, 0.1)}] AS severity, exp(-chi2 / 2) * (1 + chi2 / 2) < 0.05 OR js > 0.05 AS drifted FROM t"""


def _class_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return monitor.categorical(rows.where(F.col("o_orderdate") < cut), rows.where(F.col("o_orderdate") >= cut), "o_orderpriority")


@query(CLASS_SQL)
def label_drift_classes(spark: SparkSession, d: str) -> DataFrame:
    """Drift of classes that are predicted: test, divergence, classes of one side only."""
    return _class_drift(spark, d).select("feature", F.round("chi2", 6).alias("chi2"), F.round("p", 6).alias("p"), F.round("js", 8).alias("js"), "novel", "vanished", "severity", "drifted")


@query("""WITH e AS (SELECT vec_id % 2 = 0 AS ref, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings), p AS (SELECT ref, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
m AS (SELECT k, avg(v) FILTER (ref) AS r, avg(v) FILTER (NOT ref) AS c FROM (SELECT ref, unnest(range(0, 64)) AS k, unnest(p) AS v FROM p) GROUP BY 1), j AS (SELECT sum((r * ln(r / ((r + c) / 2)) + c * ln(c / ((r + c) / 2))) / 2) AS js FROM m),
c AS (SELECT list_position(p, list_max(p)) AS k, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM p GROUP BY 1), s AS (SELECT *, (r + c) * sum(r) OVER () / (sum(r) OVER () + sum(c) OVER ()) AS er, (r + c) * sum(c) OVER () / (sum(r) OVER () + sum(c) OVER ()) AS ec FROM c),
x AS (SELECT sum(pow(r - er, 2) / er + pow(c - ec, 2) / ec) AS chi2, count(*) - 1 AS dof FROM s), b AS (SELECT ref, -list_sum(list_transform(p, lambda v: v * log2(greatest(v, 1e-12)))) AS bits, list_max(p) AS most FROM p),
h AS (SELECT avg(bits) FILTER (NOT ref) - avg(bits) FILTER (ref) AS entropy_shift, avg(most) FILTER (NOT ref) - avg(most) FILTER (ref) AS confidence_shift FROM b)
SELECT round(js, 8) AS js, round(chi2, 6) AS chi2, dof, round(entropy_shift, 6) AS entropy_shift, round(confidence_shift, 6) AS confidence_shift, CASE WHEN js >= 0.1 THEN 'high' WHEN js >= 0.05 THEN 'moderate' ELSE 'low' END AS severity FROM j, x, h""")
def prediction_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of class probabilities between two halves."""
    rows = table(spark, d, "embeddings").select("vec_id", arrays.softmax(F.col("embedding")).alias("p"))
    found = monitor.predictions(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 <> 0"), "p")
    return found.select(F.round("js", 8).alias("js"), F.round("chi2", 6).alias("chi2"), "dof", F.round("entropy_shift", 6).alias("entropy_shift"), F.round("confidence_shift", 6).alias("confidence_shift"), "severity")


PLACES_SQL = f"""WITH a AS (SELECT {place_sql('c_custkey')} FROM customer), b AS (SELECT {place_sql('s_suppkey')} FROM supplier), c AS (SELECT DISTINCT floor(lon / 10) AS x, floor(lat / 10) AS y FROM a), s AS (SELECT DISTINCT floor(lon / 10) AS x, floor(lat / 10) AS y FROM b),
n AS (SELECT count(*) AS cells, count(*) FILTER (s.x IS NULL) AS novel FROM c LEFT JOIN s ON c.x = s.x AND c.y = s.y), k AS (SELECT avg(km) AS mean_km FROM (SELECT a.lon, a.lat, any_value(m), min({KM.format(a='a', b='b')}) AS km FROM (SELECT *, row_number() OVER () AS m FROM a) a, b GROUP BY a.lon, a.lat, m))
SELECT cells, novel, round(novel / cells, 6) AS share, round(mean_km, 4) AS mean_km, ['low', 'moderate', 'high'][1 + {level_sql('novel / cells', 0.1, 0.25)}] AS severity, novel / cells >= 0.25 AS drifted FROM n, k"""


def _place_drift(spark: SparkSession, d: str) -> DataFrame:
    at = lambda name, key: table(spark, d, name).select(*(v.alias(k) for k, v in place(key).items()))
    return monitor.places(at("supplier", "s_suppkey"), at("customer", "c_custkey"), "lon", "lat", 10.0)


@query(PLACES_SQL)
def place_drift(spark: SparkSession, d: str) -> DataFrame:
    """Cells that only customers occupy, and their mean distance to the nearest supplier."""
    return _place_drift(spark, d).select("cells", "novel", F.round("share", 6).alias("share"), F.round("mean_km", 4).alias("mean_km"), "severity", "drifted")


def _tidy_sql(sql: str, section: str, key: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS key, severity, drifted, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM ({sql})" for m in metrics)


REPORT_SQL = " UNION ALL ".join([_tidy_sql(FEATURES_SQL, "features", "feature", ["psi", "js", "ks"]), _tidy_sql(LABEL_SQL, "label", "feature", ["psi", "js", "ks"]), _tidy_sql(CLASS_SQL, "classes", "feature", ["chi2", "js"]), _tidy_sql(PLACES_SQL, "places", "'places'", ["share", "mean_km"])])
RANK_SQL = "list_position(['low', 'moderate', 'high'], severity) - 1"
MONITOR_SQL = f"WITH report AS ({REPORT_SQL}) SELECT * FROM report UNION ALL SELECT 'overall', 'overall', ['low', 'moderate', 'high'][max({RANK_SQL}) + 1], bool_or(drifted), 'severity', CAST(max({RANK_SQL}) AS DOUBLE) FROM report"


def _report(spark: SparkSession, d: str) -> DataFrame:
    sections = [
        monitor.tidy(_feature_drift(spark, d), "features", "feature", ["psi", "js", "ks"]), monitor.tidy(_label_drift(spark, d), "label", "feature", ["psi", "js", "ks"]),
        monitor.tidy(_class_drift(spark, d), "classes", "feature", ["chi2", "js"]), monitor.tidy(_place_drift(spark, d), "places", None, ["share", "mean_km"]),
    ]
    return monitor.monitor(*sections).withColumn("value", F.round("value", 6))


@query(MONITOR_SQL.replace("round(CAST(mean_km AS DOUBLE), 6)", "CAST(mean_km AS DOUBLE)"))
def drift_monitor(spark: SparkSession, d: str) -> DataFrame:
    """All analyzers' results as tidy rows, and the overall verdict."""
    return _report(spark, d).withColumn("value", F.when(F.col("metric") == "mean_km", F.round("value", 4)).otherwise(F.col("value")))


@query(f"SELECT section, CAST(max({RANK_SQL}) AS INT) AS gauge FROM ({MONITOR_SQL}) GROUP BY 1")
def drift_gauges(spark: SparkSession, d: str) -> DataFrame:
    """The worst severity of each section as a number, as a metrics endpoint shows it."""
    return monitor.gauges(_report(spark, d))


FAIR = "(SELECT CAST(l_linestatus AS VARCHAR) AS s, CAST(l_linenumber AS VARCHAR) AS n, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS p FROM lineitem)"
FAIR_RATES = f"WITH f AS (SELECT 'l_linestatus' AS attribute, s AS g, y, p FROM {FAIR} UNION ALL SELECT 'l_linenumber', n, y, p FROM {FAIR}), r AS (SELECT attribute, g, count(*) AS support, (count(*) FILTER (y = 1)) / count(*) AS base_rate, (count(*) FILTER (y = p)) / count(*) AS accuracy, coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0), 0) AS tpr, coalesce(count(*) FILTER (y = 0 AND p = 1) / nullif(count(*) FILTER (y = 0), 0), 0) AS fpr FROM f GROUP BY ALL)"
SPREAD_SQL = " UNION ALL ".join(f"SELECT attribute, '{m}' AS metric, max({m}) - min({m}) AS spread, coalesce(min({m}) / nullif(max({m}), 0), 0) AS ratio, CASE WHEN max({m}) - min({m}) <= {a} THEN 1 WHEN max({m}) - min({m}) <= {b} THEN 2 ELSE 3 END AS l FROM r WHERE support >= 30 GROUP BY 1" for m, (a, b) in evaluation.SPREADS.items())
STATUS_SQL = "['compliant', 'at_risk', 'violating']"


@query(f"{FAIR_RATES}, v AS ({SPREAD_SQL}) SELECT attribute, metric, round(spread, 6) AS spread, round(ratio, 6) AS ratio, {STATUS_SQL}[l] AS status, {STATUS_SQL}[max(l) OVER (PARTITION BY attribute)] AS worst FROM v")
def fairness_by_attribute(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts over several attributes, with each one's worst status."""
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("p"))
    found = evaluation.verdicts_by(evaluation.rates_by_attribute(rows, ["l_linestatus", "l_linenumber"], "y", "p"), "attribute")
    return found.withColumns({"spread": F.round("spread", 6), "ratio": F.round("ratio", 6)})


@query(f"WITH s AS (SELECT n_name, n_nationkey, y, p FROM (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS p FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT n_name, n_nationkey, count(*) AS support, count(*) FILTER (y = p) / count(*) AS accuracy, count(*) FILTER (y = 1) / count(*) AS base_rate FROM s GROUP BY ALL) SELECT n_name AS region, support, round(accuracy, 6) AS accuracy, round(base_rate, 6) AS base_rate, round(lon, 4) AS lon, round(lat, 4) AS lat FROM r JOIN (SELECT n_nationkey, {place_sql('n_nationkey')} FROM nation) USING (n_nationkey)")
def regional_fairness(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each region with its centre."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("n_nationkey"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("p"))
    rates = evaluation.group_rates(rows, "n_nationkey", "y", "p")
    centres = table(spark, d, "nation").select("n_nationkey", "n_name", *(F.round(v, 4).alias(k) for k, v in place("n_nationkey").items()))
    return rates.join(centres, "n_nationkey").select(F.col("n_name").alias("region"), "support", F.round("accuracy", 6).alias("accuracy"), F.round("base_rate", 6).alias("base_rate"), "lon", "lat")


@query("""WITH s AS (SELECT label AS y, unnest(range(0, 64)) AS label, round(unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS score FROM embeddings), c AS (SELECT label, score, count(*) FILTER (y = label) AS p, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT label, score, sum(p) OVER w AS tp, sum(n) OVER w AS got, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY label) AS m, sum(p) OVER (PARTITION BY label) AS every FROM c WINDOW w AS (PARTITION BY label ORDER BY score DESC))
SELECT CAST(label AS INT) AS label, score AS threshold, ((2000000 * tp + got) // (2 * got)) / 1000000 AS precision, coalesce(((2000000 * tp + every) // nullif(2 * every, 0)) / 1000000, 0) AS recall FROM r WHERE place % greatest(m // 100, 1) = 0 OR place = m - 1""")
def class_pr_curves(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each class against the rest, at about 100 points; halves of the sixth decimal go up, and zero has no sign."""
    scores = table(spark, d, "embeddings").select(F.col("label").alias("y"), F.posexplode("embedding").alias("label", "x"))
    scores = scores.select("label", F.round(F.col("x").cast("double"), 6).alias("score"), (F.col("y") == F.col("label")).alias("hit"))
    return evaluation.class_curves(scores).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("WITH r AS (SELECT l_discount * 10 AS image, l_tax * 10 AS tabular, (l_returnflag = 'R') = (l_discount > 0.05) AS ok FROM lineitem) SELECT gate, round(avg(v), 6) AS overall, round(avg(v) FILTER (ok), 6) AS correct, round(avg(v) FILTER (NOT ok), 6) AS error FROM (SELECT 'image' AS gate, image AS v, ok FROM r UNION ALL SELECT 'tabular', tabular, ok FROM r) GROUP BY 1")
def gate_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Mean gates of all, right and wrong predictions."""
    ok = (F.col("l_returnflag") == "R") == (F.col("l_discount") > 0.05)
    rows = table(spark, d, "lineitem").select(ok.alias("ok"), F.inline(F.array(F.struct(F.lit("image").alias("gate"), (F.col("l_discount") * 10).alias("v")), F.struct(F.lit("tabular").alias("gate"), (F.col("l_tax") * 10).alias("v")))))
    return rows.groupBy("gate").agg(F.round(F.avg("v"), 6).alias("overall"), F.round(F.avg(F.when(F.col("ok"), F.col("v"))), 6).alias("correct"), F.round(F.avg(F.when(~F.col("ok"), F.col("v"))), 6).alias("error"))


@query("SELECT count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(sqrt(avg(pow(l_extendedprice - l_quantity * 1500, 2))), 4) AS rmse, count(DISTINCT l_orderkey % 16) AS batches FROM lineitem")
def merged_batches(spark: SparkSession, d: str) -> DataFrame:
    """Metrics from the sums of batches, merged at the end."""
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1500
    batches = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 16).alias("batch")).agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("s"))
    return batches.agg(F.sum("n").alias("n"), F.round(F.sum("a") / F.sum("n"), 4).alias("mae"), F.round(F.sqrt(F.sum("s") / F.sum("n")), 4).alias("rmse"), F.count("*").alias("batches"))



@query("SELECT 'crop' AS task, 'accuracy' AS metric, round(avg(CASE WHEN (l_returnflag = 'R') = (l_discount > 0.05) THEN 1 ELSE 0 END), 6) AS value FROM lineitem UNION ALL SELECT 'yield', 'mae', round(avg(abs(l_extendedprice - l_quantity * 1500)), 6) FROM lineitem UNION ALL SELECT 'yield', 'rmse', round(sqrt(avg(pow(l_extendedprice - l_quantity * 1500, 2))), 6) FROM lineitem")
def task_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of several tasks as rows (task, metric, value)."""
    ok = ((F.col("l_returnflag") == "R") == (F.col("l_discount") > 0.05)).cast("double")
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1500
    one = [("crop", "accuracy", F.avg(ok)), ("yield", "mae", F.avg(F.abs(e))), ("yield", "rmse", F.sqrt(F.avg(e * e)))]
    rows = table(spark, d, "lineitem").agg(F.array(*(F.struct(F.lit(t).alias("task"), F.lit(m).alias("metric"), F.round(v, 6).alias("value")) for t, m, v in one)).alias("x"))
    return rows.select(F.inline("x"))


@query("SELECT metric, printf('%.4f', value) AS value FROM (SELECT unnest([{'metric': 'mae', 'value': avg(abs(e))}, {'metric': 'rmse', 'value': sqrt(avg(e * e))}, {'metric': 'bias', 'value': avg(e)}, {'metric': 'max_error', 'value': max(abs(e))}], recursive := true) FROM (SELECT l_extendedprice - l_quantity * 1500 AS e FROM lineitem))")
def comparison_rows(spark: SparkSession, d: str) -> DataFrame:
    """Regression metrics as rows, with four decimals, for a comparison table."""
    from agrarium.sources import sinks

    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    wide = evaluation.regression_metrics(rows, "y", "p").select("mae", "rmse", "bias", "max_error")
    return sinks.comparison(wide.unpivot([], ["mae", "rmse", "bias", "max_error"], "metric", "value"), ["metric"])


@query("WITH r AS (SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, least(greatest(l_discount * 10, 0.01), 0.99) AS p, l_tax * 100 AS ms FROM lineitem) SELECT split, count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(ms), 4) AS mean_ms FROM r GROUP BY 1")
def split_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Losses, accuracy and latency of each split."""
    k = F.col("l_orderkey") % 10
    y, p = (F.col("l_returnflag") == "R").cast("int"), F.least(F.greatest(F.col("l_discount") * 10, F.lit(0.01)), F.lit(0.99))
    rows = table(spark, d, "lineitem").select(F.when(k < 7, "train").when(k < 8, "validation").otherwise("test").alias("split"), y.alias("y"), p.alias("p"), (F.col("l_tax") * 100).alias("ms"))
    loss = -(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"), F.round(F.avg("ms"), 4).alias("mean_ms"))


GATE_INPUT = "SELECT l_suppkey, avg(CASE WHEN (l_returnflag = 'R') = (l_discount > 0.05) THEN 1.0 ELSE 0.0 END) + 0.3 AS accuracy, CASE WHEN l_suppkey % 3 > 0 THEN 0.8 END AS incumbent, sum(CAST(round(l_tax * 1000000) AS BIGINT)) / count(l_tax) / 1000 AS latency, CASE WHEN l_suppkey % 4 > 0 THEN 38.0 END AS incumbent_latency, CASE WHEN sum(CAST(round(l_discount * 1000000) AS BIGINT)) / count(l_discount) / 1000000 > 0.0505 THEN 'high' ELSE 'low' END AS drift, CASE WHEN l_suppkey % 5 = 0 THEN 'violating' WHEN l_suppkey % 5 = 1 THEN 'at_risk' ELSE 'compliant' END AS fairness FROM lineitem GROUP BY 1"


@query(f"SELECT l_suppkey, concat_ws(',', CASE WHEN NOT (accuracy >= 0.8 AND (incumbent IS NULL OR accuracy >= incumbent)) THEN 'accuracy' END, CASE WHEN NOT (incumbent_latency IS NULL OR (latency - incumbent_latency) / incumbent_latency * 100 <= 10) THEN 'latency' END, CASE WHEN drift = 'high' THEN 'drift' END, CASE WHEN fairness <> 'compliant' THEN 'fairness' END) AS failed FROM ({GATE_INPUT})")
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    """The metric, latency, drift and fairness checks that each candidate fails; means are of whole millionths, so that limits are met in any order of rows."""
    k = F.col("l_suppkey")
    mean = lambda c: F.sum(F.round(F.col(c) * 1000000).cast("long")) / F.count(c)
    ok = ((F.col("l_returnflag") == "R") == (F.col("l_discount") > 0.05)).cast("double")
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg(ok) + 0.3).alias("accuracy"), (mean("l_tax") / 1000).alias("latency"), F.when(mean("l_discount") / 1000000 > 0.0505, "high").otherwise("low").alias("drift"))
    fairness = F.when(k % 5 == 0, "violating").when(k % 5 == 1, "at_risk").otherwise("compliant")
    failed = drift.gate(F.col("accuracy"), F.when(k % 3 > 0, 0.8), F.col("latency"), F.when(k % 4 > 0, 38.0), F.col("drift"), fairness)
    return rows.select("l_suppkey", F.array_join(failed, ",").alias("failed"))


REPORTS = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "events": "event_id"}


@query(" UNION ALL ".join(f"SELECT 'inventory' AS report, '{t}' AS key, CAST(count(*) AS DOUBLE) AS value FROM {t}" for t in REPORTS) + " UNION ALL SELECT 'provider', o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2 UNION ALL SELECT 'temporal', CAST(year(o_orderdate) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2" + f" UNION ALL SELECT 'spatial', 'max_lat', max(lat) FROM (SELECT {place_sql('c_custkey')} FROM customer) UNION ALL SELECT 'spatial', 'min_lat', min(lat) FROM (SELECT {place_sql('c_custkey')} FROM customer) UNION ALL SELECT 'validation', 'negative_balance', CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) FROM customer UNION ALL SELECT 'tabular', 'o_totalprice', round(avg(o_totalprice), 4) FROM orders UNION ALL SELECT 'image', event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY 2")
def dataset_reports(spark: SparkSession, d: str) -> DataFrame:
    """Seven reports on the tables as rows (report, key, value)."""
    row = lambda df, report, key, value: df.select(F.lit(report).alias("report"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    counts = lambda df, report, key: row(df.groupBy(key.alias("k")).agg(F.count("*").alias("n")), report, F.col("k"), F.col("n"))
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    lats = customer.select(place("c_custkey")["lat"].alias("lat")).agg(F.max("lat").alias("max_lat"), F.min("lat").alias("min_lat")).unpivot([], ["max_lat", "min_lat"], "key", "value")
    parts = [row(table(spark, d, t).agg(F.count("*").alias("n")), "inventory", F.lit(t), F.col("n")) for t in REPORTS]
    parts += [counts(orders, "provider", F.col("o_orderstatus")), counts(orders, "temporal", F.year("o_orderdate")), row(lats, "spatial", F.col("key"), F.col("value")), counts(table(spark, d, "events"), "image", F.col("event_type"))]
    parts += [row(customer.agg(F.count_if(F.col("c_acctbal") < 0).alias("n")), "validation", F.lit("negative_balance"), F.col("n")), row(orders.agg(F.round(F.avg("o_totalprice"), 4).alias("m")), "tabular", F.lit("o_totalprice"), F.col("m"))]
    return reduce(DataFrame.unionByName, parts)

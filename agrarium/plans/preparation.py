"""Filling, clipping, scaling, encoding, sequences, splits and folds over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators import prepare, sequences, splits
from agrarium.plans.registry import query
from agrarium.sources.tables import table

MARK = "((({k} % 4294967296) * 2654435761 + 42 * 40503) % 4294967296)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Line items whose discount is missing where the tax is 0."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("x"))


ITEMS = "(SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, CASE WHEN l_tax > 0 THEN l_discount END AS x FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(x, (SELECT avg(x) FROM {ITEMS})), 6) AS x FROM {ITEMS}")
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    fill = prepare.fill_values(rows, ["x"], "mean")
    return rows.na.fill(fill).select("l_orderkey", "l_linenumber", F.round("x", 6).alias("x"))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(x, (SELECT median(x) FROM {ITEMS})), 6) AS x FROM {ITEMS}")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    return rows.na.fill(prepare.fill_values(rows, ["x"], "median")).select("l_orderkey", "l_linenumber", F.round("x", 6).alias("x"))


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, b + 0.5 * (b - a)), a - 0.5 * (b - a)), 4) AS price FROM lineitem, q")
def clip_iqr(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    bounds = prepare.fence(rows, ["l_extendedprice"], "iqr", 0.5)["l_extendedprice"]
    return rows.select("l_orderkey", "l_linenumber", F.round(prepare.clipped(F.col("l_extendedprice"), bounds), 4).alias("price"))


@query("WITH s AS (SELECT avg(l_extendedprice) m, stddev_pop(l_extendedprice) s FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, m + s), m - s), 4) AS price FROM lineitem, s")
def clip_sigma(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    bounds = prepare.fence(rows, ["l_extendedprice"], "sigma", 1.0)["l_extendedprice"]
    return rows.select("l_orderkey", "l_linenumber", F.round(prepare.clipped(F.col("l_extendedprice"), bounds), 4).alias("price"))


@query(f"SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS price, round(coalesce((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 0), 6) AS x FROM {ITEMS}")
def scale_standard(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    fitted = prepare.standard(rows, ["l_extendedprice", "x"])
    return rows.select("l_orderkey", "l_linenumber", F.round(fitted.of("l_extendedprice"), 6).alias("price"), F.round(fitted.of("x"), 6).alias("x"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 2 - 1, 6) AS price FROM part")
def scale_minmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    return rows.select("p_partkey", F.round(prepare.min_max(rows, ["p_retailprice"], -1.0, 1.0).of("p_retailprice"), 6).alias("price"))


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) a, median(p_retailprice) m, quantile_cont(p_retailprice, 0.75) b FROM part) SELECT p_partkey, round((p_retailprice - m) / (b - a), 6) AS price FROM part, q")
def scale_robust(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    return rows.select("p_partkey", F.round(prepare.robust(rows, ["p_retailprice"]).of("p_retailprice"), 6).alias("price"))


@query("WITH f AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey, CAST(code AS INT) AS code FROM orders JOIN f ON p = o_orderpriority")
def ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return prepare.ordinal(rows, "o_orderpriority", prepare.categories(rows, "o_orderpriority", "o_orderkey"), "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS f, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS o, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS p FROM orders".replace("1.0", "1::DOUBLE").replace("0.0", "0::DOUBLE"))
def onehot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", *(c.alias(n) for c, n in zip(prepare.one_hot("o_orderstatus", ["F", "O", "P"]), ("f", "o", "p"), strict=True)))


#: A single-precision number with three decimals, halves away from zero.
THOUSANDTHS = "printf('%.3f', sign({x}) * floor(abs(CAST(CAST({x} AS FLOAT) AS DOUBLE)) * 1000 + 0.5) / 1000)"


@query(f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, quantile_cont(o_custkey, 0.25) AS c, quantile_cont(o_custkey, 0.75) AS e FROM orders),
r AS (SELECT o_orderkey, o_orderstatus, greatest(least(o_totalprice, b + 1.5 * (b - a)), a - 1.5 * (b - a)) AS p, greatest(least(o_custkey, e + 1.5 * (e - c)), c - 1.5 * (e - c)) AS k FROM orders, q), s AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(k) AS mk, stddev_pop(k) AS sk FROM r),
n AS (SELECT list(name ORDER BY first) AS names FROM (SELECT o_orderstatus AS name, min(o_orderkey) AS first FROM orders GROUP BY 1))
SELECT o_orderkey, array_to_string(list_concat([{THOUSANDTHS.format(x='(p - mp) / sp')}, {THOUSANDTHS.format(x='(k - mk) / sk')}], list_transform(names, lambda x: CASE WHEN x = o_orderstatus THEN '1.000' ELSE '0.000' END)), ' ') AS features FROM r, s, n""")
def tabular_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors of orders, fitted on all of them, as text of three decimals, halves away from zero; the column that doubles another and the constant one go."""
    rows = table(spark, d, "orders").withColumn("double_price", F.col("o_totalprice") * 2).withColumn("one", F.lit(1.0))
    fitted = prepare.TabularPipeline(["o_totalprice", "double_price", "one", "o_custkey"], ["o_orderstatus"], "o_orderkey").fit(rows)
    return fitted.transform(rows).select("o_orderkey", F.array_join(F.transform("features", lambda x: F.format_string("%.3f", x.cast("double"))), " ").alias("features"))


@query("WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) SELECT user_id, day, CAST(gap AS INT) AS gap FROM (SELECT user_id, day, datediff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM e) WHERE gap IS NOT NULL")
def date_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequences.gaps(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@query("WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) SELECT user_id, CAST(coalesce(max(gap), 0) AS INT) AS max_gap FROM (SELECT user_id, datediff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM e) GROUP BY 1")
def max_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequences.largest_gaps(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@query("SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return sequences.first_per_key(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], ["event_id"]).select("user_id", "day", "event_id")


@query("WITH r AS (SELECT user_id, list(value ORDER BY event_id)[1:8] AS v FROM events GROUP BY 1) SELECT user_id, array_to_string(list_transform(list_concat(v, list_resize([]::DOUBLE[], 8 - len(v), 0.0)), lambda x: printf('%.4f', x)), ' ') AS vals, array_to_string(list_concat(list_resize([]::INT[], len(v), 1), list_resize([]::INT[], 8 - len(v), 0)), '') AS mask FROM r")
def pad_sequence(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.sequences(table(spark, d, "events"), "user_id", "event_id", "value", 8)
    return found.select("user_id", F.array_join(F.transform("values", lambda x: F.format_string("%.4f", x)), " ").alias("vals"), F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_key(spark: SparkSession, d: str) -> DataFrame:
    return sequences.top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT l_suppkey, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1")
def best_row(spark: SparkSession, d: str) -> DataFrame:
    return sequences.best_row(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", ["l_orderkey"])


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {MARK.format(k='o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= round(n * 0.2) THEN 'test' WHEN r <= round(n * 0.2) + round(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r")
def split_random(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 0.1)


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MARK.format(k='o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= round(n * 0.2) THEN 'test' WHEN r <= round(n * 0.2) + round(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2, 0.1).drop("o_orderstatus")


@query(f"WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {MARK.format(k='o_custkey')}, o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, CASE WHEN r <= round(n * 0.2) THEN 'test' WHEN r <= round(n * 0.2) + round(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM orders JOIN g USING (o_custkey)")
def split_group(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 0.1).drop("o_custkey")


@query("WITH y AS (SELECT y, row_number() OVER (ORDER BY y DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) SELECT o_orderkey, CASE WHEN r <= greatest(1, round(n * 0.2)) THEN 'test' WHEN r <= greatest(1, round(n * 0.2)) + greatest(1, round(n * 0.2)) THEN 'validation' ELSE 'train' END AS split FROM orders JOIN y ON y = year(o_orderdate)")
def split_temporal(spark: SparkSession, d: str) -> DataFrame:
    return splits.temporal_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.year("o_orderdate"), 0.2, 0.2).drop("o_orderdate")


@query(f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {MARK.format(k='o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def kfold(spark: SparkSession, d: str) -> DataFrame:
    return splits.folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MARK.format(k='o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def kfold_stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, within="o_orderstatus").drop("o_orderstatus")


@query("WITH y AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS r FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) SELECT o_orderkey, CAST(r % 3 AS INT) AS fold FROM orders JOIN y ON y = year(o_orderdate)")
def kfold_temporal(spark: SparkSession, d: str) -> DataFrame:
    return splits.year_folds(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.year("o_orderdate"), 3).drop("o_orderdate")


@query(f"SELECT c_custkey FROM customer ORDER BY {MARK.format(k='c_custkey')}, c_custkey LIMIT 50")
def ordered_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.ordered_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50)


@query("SELECT n_nationkey, CAST(y AS INT) AS year, s AS season FROM nation, (SELECT unnest([2019, 2020]) AS y), (SELECT unnest(['Kharif', 'Rabi']) AS s)")
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    return splits.plan(table(spark, d, "nation").select("n_nationkey"), [2019, 2020], ["Kharif", "Rabi"])


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01') SELECT k AS l_partkey, 'novel' AS change FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'vanished' FROM b ANTI JOIN a USING (k)")
def novel_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return splits.novel(rows.where("l_shipdate >= TIMESTAMP_NTZ '2001-06-01'"), rows.where("l_shipdate < TIMESTAMP_NTZ '1995-06-01'"), "l_partkey")

"""Logs, records, rankings, upserts and registries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrarium.functions import arrays
from agrarium.operators import filters, prepare, profile, sequences, splits, state
from agrarium.plans.preparation import MARK
from agrarium.plans.registry import query
from agrarium.sources.tables import table

RECENT = "TIMESTAMP '2024-01-25 00:00:00'"


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {RECENT} - INTERVAL 48 HOURS AND ts <= {RECENT} GROUP BY 1")
def recent_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions of the last 48 hours by kind, most frequent first."""
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    rows = table(spark, d, "events").where((F.col("ts") >= now - F.expr("INTERVAL 48 HOURS")) & (F.col("ts") <= now))
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT 'all' AS scope, 'predictions' AS key, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'all', 'confidence', round(avg(l_discount * 10), 4) FROM lineitem UNION ALL SELECT 'all', 'latency', round(avg(l_tax * 1000), 3) FROM lineitem UNION ALL SELECT 'class', l_returnflag, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 2")
def admin_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Count, rounded means and the distribution of classes, in one pass."""
    rows = table(spark, d, "lineitem")
    sets = rows.groupingSets([[], [F.col("l_returnflag")]], "l_returnflag").agg(F.grouping("l_returnflag").alias("g"), F.count("*").cast("double").alias("predictions"), F.round(F.avg(F.col("l_discount") * 10), 4).alias("confidence"), F.round(F.avg(F.col("l_tax") * 1000), 3).alias("latency"))
    whole = sets.where("g = 1").unpivot([], ["predictions", "confidence", "latency"], "key", "value").select(F.lit("all").alias("scope"), "key", "value")
    return whole.unionByName(sets.where("g = 0").select(F.lit("class").alias("scope"), F.col("l_returnflag").alias("key"), F.col("predictions").alias("value")))


@query("SELECT 'year' AS dimension, CAST(year(o_orderdate) AS VARCHAR) AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2")
def dataset_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Records by year, status and priority, in one pass."""
    from agrarium.operators.summaries import slices

    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    return slices(rows, ["year", "o_orderstatus", "o_orderpriority"], {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})


@query("SELECT label, n, round(n / sum(n) OVER (), 6) AS share, round(mean, 4) AS mean_value, least_value, most_value, missing FROM (SELECT o_orderpriority AS label, count(*) AS n, avg(o_totalprice) AS mean, min(o_totalprice) AS least_value, max(o_totalprice) AS most_value, count(*) FILTER (o_orderkey % 11 = 0) AS missing FROM orders GROUP BY 1)")
def observation_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Class distribution with each class's value summary and missing values."""
    rows = table(spark, d, "orders").withColumn("feature", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")))
    found = rows.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"), F.min("o_totalprice").alias("least_value"), F.max("o_totalprice").alias("most_value"), F.count_if(F.col("feature").isNull()).alias("missing"))
    return found.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).select("label", "n", "share", "mean_value", "least_value", "most_value", "missing")


@query("WITH c AS (SELECT o_orderstatus AS status, o_totalprice AS score FROM orders), r AS (SELECT status, score, row_number() OVER (PARTITION BY status ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY status) AS n FROM c), a AS (SELECT count(*) FILTER (status <> 'P') / count(*) AS acceptance FROM c) SELECT status, any_value(n) AS n, round(any_value(acceptance), 4) AS acceptance, max(score) FILTER (r = CAST(floor(n * 0.25) AS BIGINT)) AS q25, max(score) FILTER (r = CAST(floor(n * 0.75) AS BIGINT)) AS q75, min(score) AS least, max(score) AS most FROM r, a GROUP BY 1")
def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Status counts with the acceptance rate, and each status's scores at ranks n/4 and 3n/4."""
    from agrarium.operators import ranks

    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"))
    at = {"q25": F.floor(F.col("n") * 0.25), "q75": F.floor(F.col("n") * 0.75)}
    plain = rows.groupBy("status").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
    rate = rows.agg(F.round(F.avg((F.col("status") != "P").cast("double")), 4).alias("acceptance"))
    return plain.join(ranks.values_at(rows, ["status"], F.col("score"), at), "status").crossJoin(F.broadcast(rate))


@query("SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    """Keys (user, day, kind) that two records or more share."""
    from agrarium.operators.summaries import repeated

    return repeated(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day", "event_type"], "event_id")


@query(f"SELECT count(*) FILTER (ts >= {RECENT} - INTERVAL 10 DAYS) AS kept, count(*) FILTER (ts < {RECENT} - INTERVAL 10 DAYS) AS purged FROM events")
def purge_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a retention of ten days keeps, and how many it purges."""
    import datetime

    kept, purged = filters.retained(table(spark, d, "events"), "ts", datetime.datetime(2024, 1, 15))
    return kept.agg(F.count("*").alias("kept")).crossJoin(purged)


@query("SELECT event_id, user_id FROM events WHERE CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'read' ELSE 'sent' END <> 'read'")
def unread_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Records that aren't read; a null status is neither."""
    k = F.col("event_id")
    rows = table(spark, d, "events").withColumn("status", F.when(k % 4 == 1, "read").when(k % 4 > 1, "sent"))
    return rows.where(F.col("status") != "read").select("event_id", "user_id")


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 3 > 0 AND event_id % 5 > 0 AND ts + INTERVAL 7 DAYS > {RECENT}) WHERE r <= 5")
def active_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's five newest sessions that are active, not revoked and not expired."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", (k % 3 > 0).alias("active"), (k % 5 == 0).alias("revoked"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    alive = rows.where(F.col("active") & ~F.col("revoked") & (F.col("expires_at") > F.lit("2024-01-25").cast("timestamp_ntz")))
    return sequences.top_per_key(alive, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS \"tab_l_quantity\", CAST(l_suppkey AS DOUBLE) AS \"tab_l_suppkey\", CAST(l_discount > 0.05 AS DOUBLE) AS \"tab_discounted\" FROM lineitem".replace("CAST(l_discount > 0.05 AS DOUBLE)", "CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
def prefixed_features(spark: SparkSession, d: str) -> DataFrame:
    """Numeric and boolean columns as doubles under a prefix, without keys, labels and text."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", (F.col("l_discount") > 0.05).alias("discounted"), "l_returnflag", F.col("l_extendedprice").alias("label"))
    taken = [c for c in profile.numeric_columns(rows) if c not in ("l_orderkey", "l_linenumber", "label")]
    return rows.select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(f"tab_{c}") for c in taken))


@query("WITH r AS (SELECT c_custkey, c_mktsegment AS kind, 'place ' || (c_custkey % 40) AS name, CASE WHEN c_custkey % 50 = 0 THEN 200.0 ELSE c_custkey % 180 END AS lon, CASE WHEN c_custkey % 60 = 0 THEN -91.0 ELSE c_custkey % 90 END AS lat FROM customer) SELECT 'error' AS severity, 'longitude' AS code, CAST(c_custkey AS VARCHAR) AS what FROM r WHERE lon NOT BETWEEN -180 AND 180 UNION ALL SELECT 'error', 'latitude', CAST(c_custkey AS VARCHAR) FROM r WHERE lat NOT BETWEEN -90 AND 90 UNION ALL SELECT 'warning', 'duplicate', kind || '/' || name FROM r GROUP BY kind, name HAVING count(*) > 1")
def spatial_record_issues(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates out of range, and names given twice within a kind."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.col("c_mktsegment").alias("kind"), F.concat(F.lit("place "), k % 40).alias("name"), F.when(k % 50 == 0, 200.0).otherwise((k % 180).cast("double")).alias("lon"), F.when(k % 60 == 0, -91.0).otherwise((k % 90).cast("double")).alias("lat"))
    bad = F.array_compact(F.array(F.when(~F.col("lon").between(-180, 180), "longitude"), F.when(~F.col("lat").between(-90, 90), "latitude")))
    errors = rows.select(F.lit("error").alias("severity"), F.explode(bad).alias("code"), k.cast("string").alias("what"))
    twice = rows.groupBy("kind", "name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("warning").alias("severity"), F.lit("duplicate").alias("code"), F.concat_ws("/", "kind", "name").alias("what"))
    return errors.unionByName(twice)


@query("SELECT truth, predicted, n FROM (SELECT o_orderpriority AS truth, CASE WHEN o_orderkey % 4 = 0 THEN '5-LOW' WHEN o_orderkey % 9 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS predicted, count(*) AS n FROM orders GROUP BY ALL) WHERE truth <> predicted ORDER BY n DESC, truth, predicted LIMIT 20")
def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent pairs of classes taken for each other."""
    from agrarium.operators.evaluation import confusion

    k = F.col("o_orderkey")
    guess = F.when(k % 4 == 0, F.lit("5-LOW")).when(k % 9 == 0, F.lit("1-URGENT")).otherwise(F.col("o_orderpriority"))
    return confusion(table(spark, d, "orders").withColumn("guess", guess), "o_orderpriority", "guess").where("truth <> predicted").orderBy(F.desc("n"), "truth", "predicted").limit(20)


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 10, 4) AS confidence FROM lineitem WHERE (l_discount > 0.05) <> (l_returnflag = 'R') ORDER BY l_discount DESC, l_orderkey, l_linenumber LIMIT 20")
def top_misclassified(spark: SparkSession, d: str) -> DataFrame:
    """The 20 wrong predictions of the highest confidence."""
    rows = table(spark, d, "lineitem").where((F.col("l_discount") > 0.05) != (F.col("l_returnflag") == "R"))
    return rows.orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 10, 4).alias("confidence"))


@query("WITH r AS (SELECT l_suppkey % 97 AS cell, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1), s AS (SELECT cell, b / sum(b) OVER () - a / sum(a) OVER () AS shift FROM r) SELECT 'hot' AS side, cell, round(shift, 8) AS shift FROM (SELECT * FROM s ORDER BY shift DESC, cell LIMIT 10) UNION ALL SELECT 'cold', cell, round(shift, 8) FROM (SELECT * FROM s ORDER BY shift, cell LIMIT 10)")
def extreme_cells(spark: SparkSession, d: str) -> DataFrame:
    """The ten cells that gained and the ten that lost the largest shares."""
    from agrarium.operators.drift import category_shares

    rows = table(spark, d, "lineitem").withColumn("cell", F.col("l_suppkey") % 97)
    shares = category_shares(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), "cell").select("cell", "shift")
    side = lambda name, order: shares.orderBy(order, "cell").limit(10).select(F.lit(name).alias("side"), "cell", F.round("shift", 8).alias("shift"))
    return side("hot", F.desc("shift")).unionByName(side("cold", F.asc("shift")))


@query("WITH f AS (SELECT unnest(range(0, 64)) AS feature, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings) SELECT feature, round(avg(v), 6) AS importance FROM f GROUP BY 1 ORDER BY abs(avg(v)) DESC, feature LIMIT 10")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    """The ten features of the largest mean effect, either way."""
    rows = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("feature", "v"))
    found = rows.groupBy(F.col("feature").cast("long").alias("feature")).agg(F.avg(F.col("v").cast("double")).alias("m"))
    return found.orderBy(F.desc(F.abs("m")), "feature").limit(10).select("feature", F.round("m", 6).alias("importance"))


@query("WITH r AS (SELECT vec_id, list_transform(range(0, 64), lambda i: {'a': -abs(CAST(embedding[i + 1] AS DOUBLE)), 'i': i}) AS x FROM embeddings) SELECT vec_id, array_to_string(list_transform(list_sort(x)[1:5], lambda s: s.i), ',') AS features FROM r")
def row_top_features(spark: SparkSession, d: str) -> DataFrame:
    """The five features of the largest values of each row, either way."""
    ranked = F.array_sort(F.transform("embedding", lambda v, i: F.struct((-F.abs(v.cast("double"))).alias("a"), i.alias("i"))))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(ranked, 1, 5), lambda s: s["i"].cast("string")), ",").alias("features"))


@query("SELECT p_brand AS name, arg_max(p_partkey, (p_size, p_partkey)) AS version FROM part WHERE p_partkey % 3 = 0 GROUP BY 1")
def active_production(spark: SparkSession, d: str) -> DataFrame:
    """The version of each model in production that was promoted last."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"), F.when(F.col("p_partkey") % 3 == 0, "production").otherwise("staging").alias("stage"), F.struct("p_size", "p_partkey").alias("promoted_at"))
    return rows.where("stage = 'production'").groupBy("name").agg(F.max_by("version", "promoted_at").alias("version"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def capacity_kept(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest entries that a bounded store keeps."""
    return state.newest(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 200)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY 1")
def upsert_last_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Balances with those of a batch in their place; of a customer given more than once the last row counts."""
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    batch = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return state.upsert_ingested(base, batch, ["c_custkey"], "o_orderkey")


@query("SELECT n_name AS name, 'nation' AS kind, arg_max(s_suppkey, s_suppkey) AS source FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'nation', -1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT r_name, 'region', -1 FROM region")
def spatial_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Places by (name, kind) with a batch of suppliers' places in their stead, the last one of each."""
    base = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.lit(-1).cast("long").alias("source")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"), F.lit(-1).cast("long").alias("source")))
    batch = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("s_suppkey").alias("source"), F.col("s_suppkey").alias("ingested"))
    return state.upsert_ingested(base, batch, ["name", "kind"], "ingested")


@query("SELECT o_orderstatus AS kind, CAST(year(o_orderdate) AS INT) AS year, array_to_string(list_sort(list_distinct(list(month(o_orderdate)))), ',') AS months FROM orders GROUP BY ALL")
def temporal_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sorted months of each kind and year, written over an older and poorer table of them."""
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    found = rows.groupBy("kind", "year").agg(F.array_sort(F.collect_set("month")).alias("months"))
    old = rows.where("month <= 3").groupBy("kind", "year").agg(F.array_sort(F.collect_set("month")).alias("months"))
    merged = state.upsert_ingested(old, found.withColumn("at", F.lit(1)), ["kind", "year"], "at")
    return merged.select("kind", "year", F.array_join(F.col("months").cast("array<string>"), ",").alias("months"))


@query("SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Tables of other columns under each other."""
    a = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {MARK.format(k='o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, r <= greatest(1, round(n * 0.15)) AS held_out FROM r")
def holdout_fold(spark: SparkSession, d: str) -> DataFrame:
    return splits.holdout(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.15)


@query(f"WITH g AS (SELECT c_nationkey, (row_number() OVER (ORDER BY {MARK.format(k='c_nationkey')}, c_nationkey) - 1) % 4 AS fold FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, CAST(fold AS INT) AS fold FROM customer JOIN g USING (c_nationkey)")
def kfold_spatial(spark: SparkSession, d: str) -> DataFrame:
    """Whole nations in turn over four folds."""
    return splits.group_folds(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 4).select("c_custkey", "fold")


@query("WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) SELECT year FROM y QUALIFY row_number() OVER (ORDER BY year DESC) <= greatest(1, round((SELECT count(*) FROM y) * 0.3))")
def last_years(spark: SparkSession, d: str) -> DataFrame:
    """The last three tenths of the years."""
    return splits.last_values(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), "year", 0.3)


@query(f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {MARK.format(k='c_custkey')}, c_custkey) AS r, count(*) OVER () AS n FROM customer), x AS (SELECT i AS draw, {MARK.format(k='(i + 1)')} % (SELECT count(*) FROM customer) + 1 AS r FROM range(1000) t(i)) SELECT draw, c_custkey FROM x JOIN r USING (r)")
def bootstrap_draws(spark: SparkSession, d: str) -> DataFrame:
    """A thousand customers drawn with replacement."""
    return splits.drawn(table(spark, d, "customer").select("c_custkey"), "c_custkey", 1000)


@query("WITH k AS (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['area', 'yield'] WHEN 1 THEN ['yield', 'rain'] ELSE ['soil'] END) AS key FROM events) SELECT key, min(event_id) AS first_row, count(*) AS n FROM k GROUP BY 1")
def key_union(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all rows' maps, by the first row that has each."""
    k = F.col("event_id")
    one = lambda *names: F.create_map(*(x for n in names for x in (F.lit(n), F.col("value"))))
    fields = F.when(k % 3 == 0, one("area", "yield")).when(k % 3 == 1, one("yield", "rain")).otherwise(one("soil"))
    rows = table(spark, d, "events").select("event_id", F.explode(F.map_keys(fields)).alias("key"))
    return rows.groupBy("key").agg(F.min("event_id").alias("first_row"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS price FROM lineitem")
def inverse_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Prices scaled and scaled back."""
    rows = table(spark, d, "lineitem")
    fitted = prepare.standard(rows, ["l_extendedprice"])
    scaled = fitted.transform(rows.select("l_orderkey", "l_linenumber", "l_extendedprice"))
    return scaled.select("l_orderkey", "l_linenumber", F.round(fitted.inverse("l_extendedprice"), 4).alias("price"))


@query("WITH f AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1), y AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders) SELECT o_orderkey, CAST(code AS INT) AS crop, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS yield FROM y JOIN f ON p = o_orderpriority")
def label_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Class codes and scaled numbers as labels; a missing number is 0 before it is scaled."""
    rows = table(spark, d, "orders").withColumn("v", F.coalesce(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")), F.lit(0.0)))
    fitted = prepare.standard(rows, ["v"])
    codes = prepare.ordinal(rows, "o_orderpriority", prepare.categories(rows, "o_orderpriority", "o_orderkey"), "crop")
    return codes.select("o_orderkey", "crop", F.round(fitted.of("v"), 6).alias("yield"))


@query("SELECT o_orderkey, round(o_totalprice, 2) || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END || ' 0' AS vector FROM orders".replace("round(o_totalprice, 2)", "printf('%.2f', o_totalprice)"))
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """Features in declared order, missing ones as 0."""
    rows = table(spark, d, "orders").withColumn("key", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))).withColumn("none", F.lit(None).cast("double"))
    vector = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("o_totalprice", "key", "none")))
    shown = F.concat_ws(" ", F.format_string("%.2f", vector[0]), vector[1].cast("long"), vector[2].cast("long"))
    return rows.select("o_orderkey", shown.alias("vector"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'missing: area' END, CASE WHEN o_orderkey % 6 = 0 THEN 'missing: soil' END) AS issues FROM orders")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    """The required features that each row's map lacks."""
    k = F.col("o_orderkey")
    held = F.array_compact(F.array(F.when(k % 4 != 0, "area"), F.when(k % 6 != 0, "soil")))
    wanted = F.array_except(F.array(F.lit("area"), F.lit("soil")), held)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(wanted, lambda x: F.concat(F.lit("missing: "), x)), ",").alias("issues"))


@query("SELECT user_id, arg_min(CASE WHEN event_id % 3 > 0 THEN event_type END, event_id) FILTER (event_id % 3 > 0) AS crs FROM events GROUP BY 1")
def first_known(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first value that isn't null, in the order of the records."""
    rows = table(spark, d, "events").withColumn("crs", F.when(F.col("event_id") % 3 > 0, F.col("event_type")))
    return rows.groupBy("user_id").agg(F.min_by("crs", F.when(F.col("crs").isNotNull(), F.col("event_id"))).alias("crs"))


@query("WITH r AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x > -0.1) AS v FROM embeddings) SELECT vec_id, round(len(v) / 64, 6) AS valid, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS std, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most FROM r")
def patch_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Share, mean, deviation, least and largest of the valid values of an array."""
    valid = F.filter(F.transform("embedding", lambda x: x.cast("double")), lambda x: x > -0.1)
    rows = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), valid.alias("v"))
    mean = arrays.array_sum(F.col("v")) / F.size("v")
    rows = rows.withColumn("m", mean)
    std = F.sqrt(arrays.array_sum(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m")))) / F.size("v"))
    return rows.select("vec_id", F.round(F.size("v") / F.col("n"), 6).alias("valid"), F.round("m", 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.array_min("v"), 6).alias("least"), F.round(F.array_max("v"), 6).alias("most"))


@query("WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < -0.3 THEN 0.0 ELSE least(greatest(CAST(x AS DOUBLE), -0.2), 0.2) END) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v))) AS v FROM c) SELECT vec_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first FROM n")
def patch_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Patches with masked values as 0, clipped and scaled to 0 to 1."""
    v = F.transform("embedding", lambda x: F.when(x < -0.3, 0.0).otherwise(F.least(F.greatest(x.cast("double"), F.lit(-0.2)), F.lit(0.2))))
    rows = table(spark, d, "embeddings").select("vec_id", v.alias("v")).withColumns({"a": F.array_min("v"), "b": F.array_max("v")})
    scaled = F.transform("v", lambda x: (x - F.col("a")) / (F.col("b") - F.col("a")))
    return rows.select("vec_id", F.round(arrays.array_sum(scaled), 6).alias("total"), F.round(scaled[0], 6).alias("first"))


@query("SELECT p_brand AS name, p_partkey AS version, CASE WHEN p_partkey = last THEN 'production' WHEN p_partkey > second - 1 THEN 'archived' WHEN p_partkey % 2 = 0 THEN 'staging' ELSE 'draft' END AS stage FROM (SELECT *, max(p_partkey) OVER (PARTITION BY p_brand) AS last, nth_value(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM part)".replace("p_partkey > second - 1", "p_partkey = second"))
def model_stages(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each model promoted to production; the one before it, in production until then, is archived."""
    by = Window.partitionBy("name").orderBy(F.desc("version"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version")).withColumn("r", F.row_number().over(by))
    rows = rows.withColumn("stage", F.when(F.col("r") == 2, "production").when(F.col("version") % 2 == 0, "staging").otherwise("draft"))
    return state.newest_promoted(rows, "name", "version").select("name", "version", "stage")


@query("SELECT r_name AS key, CASE WHEN r_regionkey % 2 = 0 THEN 'new' ELSE 'old' END AS value, CASE WHEN r_regionkey % 2 = 0 AND r_regionkey > 0 THEN 'named' ELSE 'base' END AS category, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM region UNION ALL SELECT 'EXTRA', 'new', '', CAST(1 AS INT)")
def versioned_settings(spark: SparkSession, d: str) -> DataFrame:
    """A batch of settings: new ones at version 1, others raised; a blank category keeps what there was."""
    old = table(spark, d, "region").select(F.col("r_name").alias("key"), F.lit("old").alias("value"), F.lit("base").alias("category"), F.lit(1).alias("version"))
    batch = table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_name").alias("key"), F.lit("new").alias("value"), F.when(F.col("r_regionkey") > 0, "named").otherwise("").alias("category"))
    batch = batch.unionByName(spark.range(1).select(F.lit("EXTRA").alias("key"), F.lit("new").alias("value"), F.lit("").alias("category")))
    return state.settings(old, batch)


@query("SELECT c_custkey, c_name, CAST(o_orderkey AS BIGINT) AS last_order, o_totalprice AS last_total, n_name AS nation, CAST(year(o_orderdate) AS INT) AS year FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = k")
def flat_observations(spark: SparkSession, d: str) -> DataFrame:
    """Nested observations (place, last record) flattened to one level."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year")), "o_orderkey").alias("record"))
    nested = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    nested = nested.select("c_custkey", F.struct("c_name", F.col("n_name").alias("nation")).alias("location"), "record")
    return nested.select("c_custkey", "location.c_name", F.col("record.o_orderkey").alias("last_order"), F.col("record.o_totalprice").alias("last_total"), "location.nation", "record.year")


@query("SELECT severity, code, \"column\" FROM (SELECT 'warning' AS severity, 'mostly_missing' AS code, 'rare' AS \"column\", count(*) FILTER (o_orderkey % 50 <> 0) / count(*) AS share FROM orders) WHERE share > 0.95")
def schema_checks(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are almost without values."""
    rows = table(spark, d, "orders").withColumn("rare", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice")))
    return profile.schema_issues(rows)


@query("SELECT event_id, value, concat('because of ', event_type) AS explanation FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value, NULL FROM events WHERE event_id % 2 <> 0")
def explained_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the one explanation that some have."""
    rows = table(spark, d, "events")
    told = rows.where("event_id % 2 = 0").select("event_id", F.concat(F.lit("because of "), "event_type").alias("explanation"))
    return rows.select("event_id", "value").join(told, "event_id", "left")


@query("SELECT o_orderkey AS sample_id, round(o_totalprice / 1000, 3) AS feature, c_mktsegment AS segment, CAST(year(o_orderdate) AS INT) AS year FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'")
def sample_meta(spark: SparkSession, d: str) -> DataFrame:
    """Meta data attached to accepted samples by their id, not by position."""
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    frame = orders.select(F.col("o_orderkey").alias("sample_id"), F.round(F.col("o_totalprice") / 1000, 3).alias("feature"))
    meta = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"))
    return frame.join(meta, "sample_id")

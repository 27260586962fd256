"""Profiles, searches, grouped analytics and scans over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.functions import names
from agrarium.operators import filters, profile, sequences, summaries
from agrarium.plans.registry import query
from agrarium.sources.tables import table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max FROM lineitem" for c in NUMERIC))
def profile_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "lineitem"), NUMERIC).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT 'text' AS \"column\", count(*) FILTER (d.text IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["text", "quality", "toxic"])


@query("SELECT a, b, round(corr, 6) AS corr FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)")
def column_correlations(spark: SparkSession, d: str) -> DataFrame:
    return profile.correlations(table(spark, d, "lineitem"), NUMERIC[:3]).withColumn("corr", F.round("corr", 6))


@query("SELECT 'l_linestatus' AS \"column\", min(l_linestatus) = max(l_linestatus) AS is_constant, count(l_linestatus) = 0 AS is_missing FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax) = max(l_tax), count(l_tax) = 0 FROM lineitem")
def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile.constant_columns(table(spark, d, "lineitem"), ["l_linestatus", "l_tax"])


@query("SELECT 'p_size' AS \"column\", true AS is_numeric UNION ALL SELECT 'p_name', bool_and(p_name IS NULL OR trim(p_name) = '' OR try_cast(p_name AS DOUBLE) IS NOT NULL) FROM part")
def numeric_inference(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_text(table(spark, d, "part"), ["p_size", "p_name"])


@query("SELECT o_orderkey, o_totalprice, total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000) WHERE r BETWEEN 21 AND 40")
def history_search(spark: SparkSession, d: str) -> DataFrame:
    found = filters.search(table(spark, d, "orders"), equal={"o_orderstatus": "F", "o_orderpriority": ""}, least={"o_totalprice": 100000})
    return sequences.page(found.select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], number=2, size=20)


@query("SELECT o_orderkey, o_orderpriority, total FROM (SELECT o_orderkey, o_orderpriority, count(*) OVER () AS total, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS r FROM orders) WHERE r > 20 * (total // 40) AND r <= 20 * (total // 40) + 20")
def history_middle(spark: SparkSession, d: str) -> DataFrame:
    """The page in the middle of all orders, by a column of which each value has a large share of the rows; found by counts."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sequences.page(rows, ["-o_orderpriority", "o_orderkey"], number=rows.count() // 40 + 1, size=20, near=0)


@query("SELECT o_orderkey, o_orderpriority, page FROM (SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (ORDER BY o_orderpriority, o_orderkey DESC) - 1) // 25 AS INT) AS page FROM orders) WHERE page < 4")
def history_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four pages, each from the last row of the one before."""
    rows, last, out = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), None, []
    for number in range(4):
        found = sequences.next_page(rows, ["o_orderpriority", "-o_orderkey"], last, 25)
        out.append(found.withColumn("page", F.lit(number)))
        if not (shown := found.collect()):  # 25 rows at most
            break
        last = (shown[-1]["o_orderpriority"], shown[-1]["o_orderkey"])
    return reduce(DataFrame.unionByName, out)


@query("SELECT n_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def by_region(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return summaries.grouped(rows, "n_name", {"mean_price": "o_totalprice"})


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def by_class(spark: SparkSession, d: str) -> DataFrame:
    return summaries.grouped(table(spark, d, "orders"), "o_orderpriority", {"mean_price": "o_totalprice"})


@query("SELECT CAST(round(l_discount * 10 * 10) AS INT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summaries.histogram(table(spark, d, "lineitem"), F.col("l_discount") * 10, 10)


@query("SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) AS day, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 168 HOUR) AS week FROM events")
def totals_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.recent_counts(table(spark, d, "events"), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), {"day": 24, "week": 168})


@query("SELECT 'event_type' AS dimension, event_type AS key, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*), round(avg(value), 4) FROM events GROUP BY 2 UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), count(*), round(avg(value), 4) FROM events GROUP BY 2")
def slice_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return summaries.slices(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "user_id", "day"], {"n": F.count("*"), "mean": F.round(F.avg("value"), 4)})


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def month_pivot(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pivot_counts(table(spark, d, "orders").withColumn("month", F.to_date(F.date_trunc("month", "o_orderdate"))), "month", "o_orderstatus", ["F", "O", "P"])


@query("WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL), m AS (SELECT user_id, event_type AS majority FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1) SELECT event_id, event_type, majority FROM events JOIN m USING (user_id) WHERE event_type <> majority")
def majority_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return summaries.off_majority(table(spark, d, "events"), "user_id", "event_type").select("event_id", "event_type", "majority")


@query("WITH h AS (SELECT DISTINCT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events), r AS (SELECT user_id, unnest(generate_series(min(day), max(day))) AS day FROM h GROUP BY 1) SELECT user_id, CAST(day AS INT) AS day FROM r ANTI JOIN h USING (user_id, day)")
def missing_periods(spark: SparkSession, d: str) -> DataFrame:
    return summaries.missing_in_range(table(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")), "user_id", "day")


@query("WITH r AS (SELECT l_returnflag, l_extendedprice v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) r, count(*) OVER (PARTITION BY l_returnflag) m FROM lineitem) SELECT l_returnflag, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, max(v) FILTER (r = CAST(floor(m * 0.25) AS BIGINT) + 1) AS q25, max(v) FILTER (r = least(CAST(floor(m * 0.75) AS BIGINT), m - 1) + 1) AS q75 FROM r GROUP BY 1")
def ranked_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return summaries.ranked_quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(n / sum(n) OVER (), 4) AS share, round(max(n) OVER () / min(n) OVER (), 4) AS imbalance, CASE WHEN n < avg(n) OVER () THEN 'minority' ELSE 'majority' END AS role, CASE WHEN max(n) OVER () / min(n) OVER () >= 5 THEN 'resample' WHEN max(n) OVER () / min(n) OVER () >= 2 THEN 'class_weights' ELSE 'none' END AS strategy FROM c")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return summaries.class_balance(table(spark, d, "events"), "event_type")


@query("WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1), w AS (SELECT quality, sum(n) OVER () / (n * count(*) OVER ()) AS w FROM c) SELECT quality, round(w / avg(w) OVER (), 6) AS weight FROM w")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return summaries.class_weights(table(spark, d, "labels"), "quality")


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), w AS (SELECT event_type, (1 - 0.999) / (1 - pow(0.999, n)) AS w FROM c) SELECT event_type, round(w / avg(w) OVER (), 6) AS weight FROM w")
def class_weights_effective(spark: SparkSession, d: str) -> DataFrame:
    return summaries.class_weights(table(spark, d, "events"), "event_type", "effective_num")


@query("SELECT p_size, n FROM (SELECT unnest(generate_series(0, (SELECT max(p_size) FROM part))) AS p_size) LEFT JOIN (SELECT p_size, count(*) AS n FROM part GROUP BY 1) USING (p_size) WHERE n IS NOT NULL UNION ALL SELECT s AS p_size, 0 AS n FROM (SELECT unnest(generate_series(0, (SELECT max(p_size) FROM part))) AS s) WHERE s NOT IN (SELECT p_size FROM part)")
def dense_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.dense_counts(table(spark, d, "part"), "p_size")


@query("SELECT c_name, c_acctbal FROM customer WHERE lower(trim(c_mktsegment)) = 'building' AND regexp_matches(c_name, '0{3}[13579]', 'i')")
def text_filters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(names.same_text(F.col("c_mktsegment"), " Building ") & names.matches(F.col("c_name"), "0{3}[13579]")).select("c_name", "c_acctbal")


@query("SELECT kind, name FROM (SELECT 0 AS o, 'nation' AS kind, n_name AS name FROM nation WHERE contains(lower(n_name), 'an') UNION ALL SELECT 1, 'region', r_name FROM region WHERE contains(lower(r_name), 'an') UNION ALL SELECT 2, 'part', p_name FROM part WHERE contains(lower(p_name), 'an')) ORDER BY o, name LIMIT 25")
def federated_search(spark: SparkSession, d: str) -> DataFrame:
    return filters.federated({"nation": (table(spark, d, "nation"), "n_name"), "region": (table(spark, d, "region"), "r_name"), "part": (table(spark, d, "part"), "p_name")}, "AN", 25)


RULES = {"too_short": "n_chars < 200", "too_long": "n_chars > 10000", "no_label": "quality IS NULL", "low_quality": "quality = 0", "toxic": "toxic = 1"}


@query("SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 10000 THEN 'too_long' END, CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS r, array_to_string(r, ',') AS reasons, len(r) = 0 AS accepted FROM documents LEFT JOIN labels USING (doc_id)".replace("SELECT doc_id, list_filter", "SELECT doc_id, reasons, accepted FROM (SELECT doc_id, list_filter") + ")")
def quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return filters.with_reasons(rows, {k: F.expr(v) for k, v in RULES.items()}).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query("SELECT doc_id, score, NOT critical AND score >= 60 AS passed FROM (SELECT doc_id, greatest(0, 100 - CASE WHEN n_chars < 200 THEN 10 ELSE 0 END - CASE WHEN quality IS NULL THEN 2 ELSE 0 END - CASE WHEN coalesce(quality = 0, false) THEN 25 ELSE 0 END - CASE WHEN coalesce(toxic = 1, false) THEN 40 ELSE 0 END) AS score, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS critical FROM documents LEFT JOIN labels USING (doc_id))")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    issues = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "warning"), F.when(F.col("quality").isNull(), "info"), F.when(F.col("quality") == 0, "error"), F.when(F.col("toxic") == 1, "critical")))
    scored = rows.withColumn("issues", issues).withColumn("score", filters.quality_score(F.col("issues")))
    return scored.select("doc_id", "score", filters.passes(F.col("issues"), F.col("score"), 60).alias("passed"))


@query("SELECT issue, count(*) AS n FROM (SELECT unnest([CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 10000 THEN 'too_long' END, CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END]) AS issue FROM documents LEFT JOIN labels USING (doc_id)) WHERE issue IS NOT NULL GROUP BY 1")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return filters.with_reasons(rows, {k: F.expr(v) for k, v in RULES.items()}).select(F.explode("reasons").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS accepted, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def acceptance_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(good).alias("accepted"), F.round(F.avg(good.cast("double")), 4).alias("rate"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return summaries.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber")


@query("SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS n_own, round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS mean, round(stddev_pop(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS std FROM orders")
def historical_comparison(spark: SparkSession, d: str) -> DataFrame:
    found = summaries.compared_with_history(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "1-URGENT")
    return found.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("WITH w AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN coalesce(a, 0) >= greatest(coalesce(n, 0), coalesce(r, 0)) THEN 'A' WHEN coalesce(n, 0) >= coalesce(r, 0) THEN 'N' ELSE 'R' END AS dominant, greatest(coalesce(a, 0), coalesce(n, 0), coalesce(r, 0)) AS area FROM w")
def dominant_from_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    best = summaries.dominant({x: (x, x) for x in ("A", "N", "R")})
    return wide.select("l_orderkey", best["name"].alias("dominant"), best["area"].alias("area"))


@query("SELECT event_type, count(*) AS requests, count(*) FILTER (value >= 50) AS errors, round(avg(value), 4) AS mean_ms FROM events GROUP BY 1")
def request_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(F.col("value") >= 50).alias("errors"), F.round(F.avg("value"), 4).alias("mean_ms"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20")
def top_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(20)


@query("SELECT count(*) AS n, count(DISTINCT s_nationkey) AS nations, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier")
def table_extent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").agg(F.count("*").alias("n"), F.countDistinct("s_nationkey").alias("nations"), F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders")
def available_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@query("SELECT page_id, CASE WHEN y = '' THEN NULL ELSE CAST(y AS INT) END AS year, trim(regexp_replace(regexp_replace(trim(url), '\\s+', ' ', 'g'), '\\s*\\(.*$', '')) AS name FROM (SELECT page_id, url, regexp_extract(url, '(?:^|\\D)(19[5-9]\\d|20\\d{2}|2100)(?:\\D|$)', 1) AS y FROM pages)")
def name_and_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", names.year_of(F.col("url")).alias("year"), names.normal_name(F.col("url")).alias("name"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 1900 AND 2100 THEN CAST(try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS INT) END AS as_year FROM events")
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", names.as_double(k).alias("k"), names.as_year(k).alias("as_year"))


@query("SELECT p_partkey, substr(sha256(concat_ws('|', p_name, p_brand)), 1, 16) AS hash FROM part")
def stable_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", names.stable_hash(F.col("p_name"), F.col("p_brand")).alias("hash"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) ELSE printf('%.1f KB', round(n_chars / 1024.0, 1)) END AS shown FROM documents")
def readable_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", names.readable_size(F.col("n_chars")).alias("shown"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    return filters.retained(table(spark, d, "orders"), "o_orderdate", datetime.datetime(1998, 1, 1))[0].select("o_orderkey")

"""Streams over the events: windowed request metrics, and a check of each micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators import drift
from agrarium.operators.lineage import scratch
from agrarium.operators.sketches import Reference
from agrarium.operators.store import KeyedStore
from agrarium.plans.registry import query
from agrarium.sources.tables import table
from agrarium.streaming import keyed, requests
from agrarium.streaming.monitoring import BatchMonitor


def _stream(spark: SparkSession, d: str, root: str) -> DataFrame:
    """The events as a stream of files, one for each residue of their number, a file at a time."""
    events = table(spark, d, "events").withColumn("g", (F.col("event_id") % 4).cast("int"))
    events.repartition("g").write.partitionBy("g").parquet(f"{root}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS requests, count(*) FILTER (value >= 400) AS errors, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def streamed_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests, errors and totals of each day and kind from a stream in order of time, which is stopped and started again.

    Each micro-batch gives the counts that it changed, and these go into a keyed
    store; days that the watermark has passed leave the state.
    """
    root, rows = scratch(spark, f"stream-{uuid.uuid4().hex}"), table(spark, d, "events")
    store = None

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch)

    for part in keyed.steps(rows, "ts", ["2024-01-09", "2024-01-21"]):
        part.write.mode("append").parquet(f"{root}/in")
        found = requests.metrics(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), "ts", "event_type", "value", 400.0, window="1 day")
        store = store or KeyedStore.create(spark, f"{root}/store", found.schema, ["start", "event_type"], buckets=8)
        found.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return store.read().select(F.to_date("start").alias("day"), "event_type", "requests", "errors", F.round(F.col("mean") * F.col("requests"), 2).alias("total"))


@query("SELECT CAST(event_id % 4 AS INT) AS g, count(*) AS n, round(avg(value), 4) AS mean, round(count(*) FILTER (value >= 400) / count(*), 6) AS error_share, avg(value) > (SELECT avg(value) FROM events) AS above FROM events GROUP BY 1")
def batch_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each micro-batch held against the whole table, as it comes."""
    root = scratch(spark, f"stream-{uuid.uuid4().hex}")
    usual = table(spark, d, "events").agg(F.avg("value")).first()[0]

    def check(batch: DataFrame) -> DataFrame:
        found = batch.groupBy("g").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.avg((F.col("value") >= 400).cast("double")).alias("error_share"))
        return found.select("g", "n", F.round("m", 4).alias("mean"), F.round("error_share", 6).alias("error_share"), (F.col("m") > F.lit(usual)).alias("above"))

    stream = _stream(spark, d, root)
    each = requests.for_each_batch(check, lambda found, number: found.drop("batch").write.mode("overwrite").parquet(f"{root}/out/batch={number}"))
    stream.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def _ks_sql(name: str, x: str) -> str:
    return f"""SELECT '{name}' AS feature, count(*) FILTER (NOT ref) AS n, (SELECT round(max(abs(coalesce(r, 0) - coalesce(c, 0))), 6) FROM (SELECT x, sum(count(*) FILTER (ref)) OVER (ORDER BY x) / (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS r, sum(count(*) FILTER (NOT ref)) OVER (ORDER BY x) / (SELECT count(*) FROM events WHERE event_id % 2 <> 0) AS c FROM (SELECT {x} AS x, event_id % 2 = 0 AS ref FROM events) GROUP BY x)) AS ks, true AS ks_agrees, true AS adds_up FROM (SELECT event_id % 2 = 0 AS ref FROM events)"""


@query(f"{_ks_sql('value', 'value')} UNION ALL {_ks_sql('hour', 'hour(ts)')}")
def monitored_stream(spark: SparkSession, d: str) -> DataFrame:
    """Drift of a stream against a reference by merged states: its last report, held against the exact distance of all rows and the state of all in one."""
    root = scratch(spark, f"stream-{uuid.uuid4().hex}")
    with_hour = lambda rows: rows.withColumn("hour", F.hour("ts"))
    events = with_hour(table(spark, d, "events"))
    before, after = events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0")
    monitor = BatchMonitor(Reference(before, ["value", "hour"], F.col("event_id")), root)
    stream = with_hour(_stream(spark, d, root)).where("event_id % 2 <> 0")
    stream.writeStream.option("checkpointLocation", f"{root}/state_of_stream").foreachBatch(monitor).trigger(availableNow=True).start().awaitTermination()
    exact = [drift.ks_and_wasserstein(drift.both(before, after, f)).select(F.lit(f).alias("feature"), F.col("ks").alias("exact")) for f in ("value", "hour")]
    at_once = monitor.reference.report(monitor.reference.state(after)).select("feature", *(F.col(c).alias(f"{c}_at_once") for c in ("psi", "psi_low", "psi_high")))
    adds_up = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}_at_once")) for c in ("psi", "psi_low", "psi_high"))) < 1e-9
    found = monitor.report(events).join(exact[0].unionByName(exact[1]), "feature").join(at_once, "feature")
    return found.select("feature", "n", F.round("exact", 6).alias("ks"), (F.abs(F.col("ks") - F.col("exact")) <= F.col("ks_error")).alias("ks_agrees"), adds_up.alias("adds_up"))


LIMIT, WINDOW_S = 3, 4 * 86_400
SLIDING_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, [t] AS hits, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT user_id, event_id, n, CASE WHEN len(f) < {LIMIT} THEN list_append(f, t) ELSE f END, len(f) < {LIMIT} FROM (SELECT e.*, list_filter(s.hits, lambda h: h > e.t - {WINDOW_S}) AS f FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, event_id AS id, allowed FROM s"""


@query(SLIDING_SQL)
def limited_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that a sliding window of four days lets through, three a user, from a stream that is stopped and started again."""
    root = scratch(spark, f"stream-{uuid.uuid4().hex}")
    return keyed.run_in_steps(spark, table(spark, d, "events"), "ts", ["2024-01-09", "2024-01-21"], lambda s: keyed.limited(s, "user_id", "ts", "event_id", LIMIT, WINDOW_S), root)


@query("SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 1e6 / 86400) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def limited_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The same with windows on the clock: two requests a user and day."""
    root = scratch(spark, f"stream-{uuid.uuid4().hex}")
    return keyed.run_in_steps(spark, table(spark, d, "events"), "ts", ["2024-01-16"], lambda s: keyed.limited(s, "user_id", "ts", "event_id", 2, 86_400, sliding=False), root)


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'set' WHEN event_type <> 'error' THEN 'get' WHEN event_id % 4 < 2 THEN 'delete' ELSE 'prefix' END AS op, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS p, event_id % 3 AS i FROM events),
s AS (SELECT * FROM o WHERE op <> 'prefix' UNION ALL SELECT user_id, ts, event_id, op, p, j FROM o, (SELECT unnest([0, 1, 2]) AS j) WHERE op = 'prefix'),
l AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN {'op': op, 'ts': ts, 'v': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id, p, i ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM s)
SELECT user_id, event_id AS id, p || i AS key, CASE WHEN s.op = 'set' AND ts <= s.ts + INTERVAL 5 DAY THEN CAST(s.v AS VARCHAR) END AS value FROM l WHERE op = 'get'""")
def cached_values(spark: SparkSession, d: str) -> DataFrame:
    """What a cache with entries of five days answers, single keys and beginnings of keys being deleted in between."""
    root = scratch(spark, f"stream-{uuid.uuid4().hex}")
    k, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "set").when(kind != "error", "get").when(k % 4 < 2, "delete").otherwise("prefix")
    letter = F.when(k % 2 == 0, "a").otherwise("b")
    rows = table(spark, d, "events").select("user_id", k.alias("id"), F.col("ts").alias("at"), op.alias("op"), F.when(op == "prefix", letter).otherwise(F.concat(letter, k % 3)).alias("key"), k.cast("string").alias("value"), F.lit(5 * 86_400.0).alias("ttl"))
    return keyed.run_in_steps(spark, rows, "at", ["2024-01-09", "2024-01-21"], lambda s: keyed.cached(s, "user_id"), root)

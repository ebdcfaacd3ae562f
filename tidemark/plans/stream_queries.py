"""Streaming jobs run to the end of the shared files, next to their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import bindings as b
from tidemark.plans.delivery_queries import workflow_runs
from tidemark.plans.registry import ORACLES, add
from tidemark.session import scratch_path
from tidemark.sources import upsert
from tidemark.streaming import streams


class StreamOf:
    """Stands in for the session where a binding should read its table as a stream."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        folder, name = path.rsplit("/", 1)
        shape = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(shape).option("pathGlobFilter", name).parquet(folder)


def finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def landed(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Runs `rows` to the end of its input and reads back what it appended."""
    path = scratch_path(spark, label)
    finish(rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", path + "-checkpoint"))
    return spark.read.schema(rows.schema).parquet(path)


def _alerts(spark, sf):
    rows = streams.dedupe_alerts_stream(b.alerts(StreamOf(spark), sf), "1 hour").select("fingerprint", "status", "starts_at")
    return landed(spark, rows, "alerts")


add("st1_dedupe_alerts", _alerts, "SELECT fingerprint, status, starts_at FROM alerts_once")


def _webhooks(spark, sf):
    one = b.events(StreamOf(spark), sf).select(F.col("event_id").alias("delivery_id"), "event_type", F.col("ts").alias("received_at"))
    again = one.withColumn("received_at", F.expr("received_at + INTERVAL 3 SECONDS"))
    rows = streams.dedupe_webhooks_stream(one.unionByName(again), "1 hour").select("delivery_id", "event_type")
    return landed(spark, rows, "webhooks")


add("st2_dedupe_webhooks", _webhooks, "SELECT event_id AS delivery_id, event_type FROM events")


def _incidents(spark, sf):
    stream = StreamOf(spark)
    alerts = b.alerts(stream, sf).filter(F.col("received_at") == F.col("starts_at"))
    closes = b.events(stream, sf, "signup").select(F.lit("o1").alias("organization_id"), "service_id", F.col("ts").alias("closed_at"))
    rows = streams.detect_incidents_stream(alerts, closes, b.services(spark, sf), "0 seconds")
    return landed(spark, rows, "incidents").select("service_id", "fingerprint", "detected_at", "title", "severity")


add("st3_detect_incidents", _incidents)
ORACLES["st3_detect_incidents"] = ORACLES["in3_detect_incidents"]


def _pushes(spark, sf):
    """Commits per author upserted from a stream; the stored count column is never touched."""
    path = scratch_path(spark, "pushes")
    rows = b.events(StreamOf(spark), sf, "click").select(
        "repository_id", F.concat(F.lit("b"), F.col("event_id") % 4).alias("name"), F.col("event_id").cast("string").alias("last_commit_sha"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("last_commit_at"))
    writer = streams.upsert_stream(rows, path, ["repository_id", "name"], path + "-checkpoint", keep_null=["last_commit_at"],
                                   newest_first=[F.col("last_commit_sha").cast("bigint").desc()], buckets=8)
    finish(writer)
    return upsert.read_table(spark, path)


add("st4_push_upserts", _pushes, """
SELECT repository_id, 'b' || (event_id % 4) AS name, event_id::VARCHAR AS last_commit_sha, CASE WHEN event_id % 5 <> 0 THEN ts END AS last_commit_at
FROM ev WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY repository_id, event_id % 4 ORDER BY event_id DESC) = 1""")

ALERT_TEXT = (
    "CASE WHEN event_id % 9 = 0 THEN '{oops' WHEN event_id % 9 = 1 THEN '{\"status\":\"firing\",\"labels\":{}}' "
    "ELSE '{\"status\":\"firing\",\"labels\":{\"service\":\"svc-' || (user_id % 25) || '\"}}' END")


def _outcomes(spark, sf):
    path = scratch_path(spark, "outcomes")
    rows = b.events(StreamOf(spark), sf, "error").select("event_id", F.lit("o1").alias("organization_id"), F.expr(ALERT_TEXT).alias("payload"))
    finish(streams.process_with_status(rows, b.services(spark, sf), path, path + "-checkpoint"))
    return spark.read.parquet(path).select("event_id", "service_id", "status", "error_message")


add("st5_event_outcomes", _outcomes, """
SELECT event_id, CASE WHEN event_id % 9 > 1 AND user_id % 25 < 20 THEN 's' || (user_id % 25) END AS service_id,
  CASE WHEN event_id % 9 > 1 AND user_id % 25 < 20 THEN 'PROCESSED' ELSE 'FAILED' END AS status,
  CASE WHEN event_id % 9 = 0 THEN 'unreadable payload' WHEN event_id % 9 = 1 THEN 'no service label' WHEN user_id % 25 >= 20 THEN 'unknown service svc-' || (user_id % 25) END
    AS error_message FROM events WHERE event_type = 'error'""")


def _poll(spark, sf):
    path = scratch_path(spark, "deployments")
    runs = workflow_runs(StreamOf(spark), sf)
    finish(streams.deployments_since(runs, F.lit("1998-01-01").cast("timestamp"), path, path + "-checkpoint", "365 days"))
    return upsert.read_table(spark, path).select("service_id", "source_run_id", "version", "status", "deployed_at")


add("st6_deployment_poll", _poll, """
SELECT 's' || (o_custkey % 20) AS service_id, o_orderkey::VARCHAR AS source_run_id, left(md5(o_orderkey::VARCHAR), 7) AS version,
  CASE WHEN o_orderstatus = 'O' THEN 'IN_PROGRESS' WHEN o_orderkey % 5 IN (1, 2) THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 HOUR ELSE o_orderdate END AS deployed_at
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")

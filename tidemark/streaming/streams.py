"""Streaming forms of the alert, webhook, push and deployment jobs.

Each has a batch twin that defines what it must give for rows within the
watermark. Sources are any stream of the raw rows; sinks write through
foreachBatch so that a replayed batch changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidemark.operators.delivery import runs_to_deployments
from tidemark.operators.incidents import alert_severity, alert_title
from tidemark.functions import text as tx
from tidemark.sources.upsert import write_upsert

# Fixed value: how far back a deployment poll looks.
POLL_LOOKBACK = "24 hours"


def dedupe_alerts_stream(alerts: DataFrame, delay: str) -> DataFrame:
    """The first arrival of each (fingerprint, start) within the watermark.

    A repeat later than `delay` passes, so the sink should upsert by the same key.
    """
    return alerts.withWatermark("starts_at", delay).dropDuplicatesWithinWatermark(["fingerprint", "starts_at"])


def dedupe_webhooks_stream(events: DataFrame, delay: str) -> DataFrame:
    """The first arrival of each delivery id within the watermark."""
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["delivery_id"])


# --- incident detection ---------------------------------------------------------------

INCIDENT_SCHEMA = StructType([
    StructField("organization_id", StringType()), StructField("service_id", StringType()), StructField("fingerprint", StringType()),
    StructField("detected_us", LongType()), StructField("title", StringType()), StructField("severity", StringType()),
])


def incident_opener(held_rows: int = 100_000, part_rows: int = 5_000) -> StatefulProcessor:
    """The per-service state machine. Defined here so that it travels to the
    executors by value and they need no copy of this package.

    A call to the state store takes longer than hundreds of rows, so rows are
    kept in parts of an hour, `part_rows` at most, written `held_rows` at a time.
    """
    fields = INCIDENT_SCHEMA.fieldNames()
    hour_us = 3_600_000_000

    class IncidentOpener(StatefulProcessor):
        """Per service: whether an incident is open, fed in event-time order.

        Rows wait until the watermark passes their millisecond, so late-ordered
        files do not change the result. `hours` says of each hour how many parts
        wait and from which millisecond on; one timer waits for the first of all,
        and when it fires, everything the watermark has passed is read.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.parts = handle.getMapState(
                "parts", StructType([StructField("hour", LongType()), StructField("part", LongType())]),
                StructType([StructField("rows", StringType())]))
            self.hours = handle.getValueState("hours", StructType([StructField("hours", StringType())]))
            self.open = handle.getValueState("open", StructType([StructField("open", BooleanType())]))

        def told(self) -> dict[int, list[int]]:
            return {int(k): v for k, v in json.loads(self.hours.get()[0]).items()} if self.hours.exists() else {}

        def tell(self, hours: dict[int, list[int]]) -> None:
            self.hours.update((json.dumps(hours),))
            if hours:
                self.handle.registerTimer(min(first for _, first in hours.values()))

        def keep(self, hours: dict[int, list[int]], arrived: dict[int, list]) -> None:
            for hour, rows in arrived.items():
                n, first = hours.get(hour, (0, rows[0][0] // 1000))
                for begin in range(0, len(rows), part_rows):
                    self.parts.updateValue((hour, n), (json.dumps(rows[begin:begin + part_rows]),))
                    n += 1
                hours[hour] = [n, min(first, min(row[0] for row in rows) // 1000)]

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            hours = self.told()
            arrived: dict[int, list] = {}
            held = 0
            for batch in rows:
                texts = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("fingerprint", "title", "severity")]
                for us, closes, *text in zip(batch["at_us"].tolist(), batch["closes"].tolist(), *texts):
                    arrived.setdefault(int(us) // hour_us, []).append([int(us), 0 if closes else 1, *text])
                held += len(batch)
                if held >= held_rows:
                    self.keep(hours, arrived)
                    arrived, held = {}, 0
            self.keep(hours, arrived)
            self.tell(hours)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            hours = self.told()
            due = sorted(hour for hour, (_, first) in hours.items() if first <= passed)
            is_open = bool(self.open.get()[0]) if self.open.exists() else False
            for hour in due:
                rows = []
                for part in range(hours.pop(hour)[0]):
                    rows += json.loads(self.parts.getValue((hour, part))[0])
                    self.parts.removeKey((hour, part))
                opened = []
                # Closes come first among equal times, then alerts by fingerprint.
                for us, kind, fingerprint, title, severity in sorted(
                        (r for r in rows if r[0] // 1000 <= passed), key=lambda r: (r[0], r[1], r[2] or "")):
                    if kind == 0:
                        is_open = False
                    elif not is_open:
                        is_open = True
                        opened.append((*key, fingerprint, us, title, severity))
                later = [r for r in rows if r[0] // 1000 > passed]
                if later:
                    self.keep(hours, {hour: later})
                if opened:
                    yield pd.DataFrame(opened, columns=fields)
            if due:
                self.open.update((is_open,))
            self.tell(hours)

        def close(self) -> None:
            pass

    return IncidentOpener()


def detect_incidents_stream(alerts: DataFrame, closes: DataFrame, services: DataFrame, delay: str) -> DataFrame:
    """Incidents opened by a stream of alerts and a stream of closes.

    `services` is a table; its rows join the alerts statically. State is keyed
    by (organization_id, service_id) and holds one flag and the rows the
    watermark has not passed yet.
    """
    known = services.select("organization_id", F.col("name").alias("_name"), F.col("id").alias("service_id"))
    firing = alerts.filter(F.col("status") == "firing").withColumn(
        "_name", tx.non_empty(F.try_element_at("labels", F.lit("service"))))
    matched = firing.filter(F.col("_name").isNotNull()).join(known, ["organization_id", "_name"]).select(
        "organization_id", "service_id", F.col("received_at").alias("at"), F.lit(False).alias("closes"), "fingerprint",
        alert_title(F.col("labels"), F.col("annotations"), F.col("_name")).alias("title"), alert_severity(F.col("labels")).alias("severity"))
    none = F.lit(None).cast("string")
    closing = closes.select(
        "organization_id", "service_id", F.col("closed_at").alias("at"), F.lit(True).alias("closes"), none.alias("fingerprint"),
        none.alias("title"), none.alias("severity"))
    events = matched.unionByName(closing).withColumn("at_us", F.unix_micros("at")).withWatermark("at", delay)
    opened = events.groupBy("organization_id", "service_id").transformWithStateInPandas(
        statefulProcessor=incident_opener(), outputStructType=INCIDENT_SCHEMA, outputMode="Append", timeMode="EventTime")
    return opened.withColumn("detected_at", F.timestamp_micros("detected_us")).drop("detected_us")


# --- sinks ----------------------------------------------------------------------------

def upsert_stream(
    rows: DataFrame, path: str, keys: Sequence[str], checkpoint: str, columns: Sequence[str] | None = None,
    keep_null: Sequence[str] = (), newest_first: Sequence[Column] | None = None, buckets: int = 64,
) -> DataStreamWriter:
    """A writer that upserts each micro-batch into the table at `path`.

    An upsert applied twice equals one, so a batch replayed after a failure is harmless.
    """
    def apply(batch: DataFrame, _: int) -> None:
        write_upsert(batch, path, keys, columns, keep_null, newest_first, buckets)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def process_with_status(events: DataFrame, services: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes each event's outcome: PROCESSED, or FAILED with what was wrong.

    `events` has event_id and `payload`, an alert as JSON. Rows are partitioned
    by batch id and a replayed batch replaces its own partition.
    """
    known = services.select("organization_id", F.col("name").alias("_name"), F.col("id").alias("service_id"))

    def outcome(batch: DataFrame) -> DataFrame:
        parsed = batch.withColumn("_p", F.from_json("payload", "status string, labels map<string,string>"))
        named = parsed.withColumn("_name", F.try_element_at("_p.labels", F.lit("service")))
        joined = named.join(known, ["organization_id", "_name"], "left")
        error = (
            F.when(F.col("_p.status").isNull(), "unreadable payload")
            .when(F.col("_name").isNull(), "no service label")
            .when(F.col("service_id").isNull(), F.concat(F.lit("unknown service "), "_name")))
        return joined.select(
            "event_id", "organization_id", "service_id", F.when(error.isNull(), "PROCESSED").otherwise("FAILED").alias("status"),
            error.alias("error_message"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = outcome(batch).withColumn("batch_id", F.lit(batch_id))
        rows.write.partitionBy("batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def deployments_since(runs: DataFrame, now: Column, path: str, checkpoint: str, lookback: str = POLL_LOOKBACK) -> DataStreamWriter:
    """Polls workflow runs of the last day into the deployments table; a known run only changes status.

    Run with `trigger(availableNow=True)` over landed files.
    """
    recent = runs_to_deployments(runs, now - F.expr(f"INTERVAL {lookback}")).withColumn("source_provider", F.lit("GITHUB_ACTIONS"))
    return upsert_stream(
        recent, path, ["service_id", "source_provider", "source_run_id"], checkpoint, columns=["status"],
        newest_first=[F.col("deployed_at").desc(), F.col("commit_sha").asc()])

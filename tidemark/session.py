"""Session defaults, shared scratch storage and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Whether a join needs its sides dealt by all of its keys; `land_by` turns it off.
CO_LOCATED = "spark.sql.requireAllClusterKeysForCoPartition"

# What results depend on, whatever session the caller brings.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    CO_LOCATED: "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# Joins on keys that may be hot are split even where that costs another exchange.
SPLIT_HOT = {"spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
# Rows go to Python by bytes too: 10,000 whole texts at a time are tens of MB on both sides of every worker.
BY_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ensure(spark: SparkSession, split_hot: bool = False, by_bytes: bool = False) -> SparkSession:
    """Sets the settings that results depend on in the running session.

    With `split_hot` also those that split hot keys, with `by_bytes` those
    that bound what a batch of rows for Python holds.
    """
    for key, value in {**REQUIRED, **(SPLIT_HOT if split_hot else {}), **(BY_BYTES if by_bytes else {})}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator relies on.

    ANSI mode and UTC are part of the semantics; the rest is tuning that AQE
    refines at run time. On a cluster `master` stays unset and spark-submit
    decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        **REQUIRED,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **SPLIT_HOT,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in `spark.checkpoint.dir`. Only where that is unset
    and the master is local (tests) does a temporary folder stand in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably so that loops do not grow their plan."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def land_by(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """Materialise `df` partitioned by `keys`, so that joins, windows and aggregates on these and more keys move nothing.

    The partitioning is only kept when the plan is fixed before it runs, and
    only used by joins on more keys when the session allows that: the setting
    stays on until `ensure` is called for the next query. Meant for keys whose
    groups are small, such as a file. `dealt` says that `df` already comes by
    these keys.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(CO_LOCATED, "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df if dealt else deal_by(df, *keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def deal_by(df: DataFrame, *keys: str) -> DataFrame:
    """`df` hashed by `keys` into the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

"""Session settings that the engine relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC for every date rule; adaptive plans; a state store that survives large keyed state.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


#: The store that can't keep several states of a key, which is Spark's default.
PLAIN_STORE = "HDFSBackedStateStoreProvider"


def keyed_states(spark: SparkSession) -> None:
    """Before a query with several states of a key: a session that has Spark's default store gets that of SETTINGS, for queries that start anew.

    A query that goes on keeps the store of its checkpoint.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith(PLAIN_STORE):
        spark.conf.set(name, SETTINGS[name])


def builder(app: str = "ctxlens", master: str | None = None) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, where unset a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialises an intermediate result in the shared folder, cutting its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

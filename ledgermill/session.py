"""Session defaults and the shared-storage step that cuts lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN_STORAGE: list[RunStorage] = []


def build_session(app_name: str = "ledgermill", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine assumes; keyword ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder all executors share: the one the cluster names, else one beside a local session's warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored_tables"


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


class RunStorage:
    """One folder for all tables stored while it is entered; :meth:`remove` deletes it.

    Leaving it keeps the folder, because results read from it lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> RunStorage:
        _OPEN_STORAGE.append(self)
        return self

    def __exit__(self, *raised) -> None:
        _OPEN_STORAGE.remove(self)

    def remove(self) -> None:
        _delete(self.spark, self.path)


@contextmanager
def run_storage(spark: SparkSession, name: str = "run") -> Iterator[RunStorage]:
    """A :class:`RunStorage` for work whose results are written before the block ends: nothing stays behind."""
    storage = RunStorage(spark, name)
    try:
        with storage:
            yield storage
    finally:
        storage.remove()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    Survives executor loss, cuts lineage, and gives Catalyst the true byte size, so
    joins against small results broadcast by measured size and never by assumption.
    """
    spark = df.sparkSession
    root = _OPEN_STORAGE[-1].path if _OPEN_STORAGE else checkpoint_root(spark).rstrip("/")
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a stored table: itself if it is one already."""
    return df if getattr(df, "_stored_at", None) is not None else materialize(df, label)


def discard(df: DataFrame) -> None:
    """Drop the files of a materialized table that nothing refers to any more."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        _delete(df.sparkSession, path)

"""Tables written to the folder that driver and executors share, which cut lineage, and their removal."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_below: ContextVar[str] = ContextVar("folder of the tables written now", default="")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local session without one takes its warehouse folder; a cluster must name one."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/siftwork-{spark.sparkContext.applicationId}"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    It cuts the lineage at one job, survives the loss of executors, and leaves no
    partitioning behind, so that a join on it gets exchanges which adaptive execution
    may split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{_session_folder(spark)}/{_below.get()}{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized inside are deleted at the end; the function that it gives materializes one that stays."""
    outer = _below.get()
    inner = f"{outer}{uuid.uuid4().hex[:12]}/"
    folder, token = f"{_session_folder(spark)}/{inner}", _below.set(inner)

    def keep(df: DataFrame) -> DataFrame:
        now = _below.set(outer)
        try:
            return materialized(df)
        finally:
            _below.reset(now)

    try:
        yield keep
    finally:
        _below.reset(token)
        _delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this session; frames that read them end."""
    _delete(spark, _session_folder(spark))

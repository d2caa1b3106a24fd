"""Bounded and resumable acquisition: shards read as a stream, with a cap for each label.

The file source's checkpoint is the progress record: a run that stops resumes at the next shard and
reads none twice. The cap is a stateful operator keyed by label, whose state is one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shard_stream(spark: SparkSession, folder: str, schema: str, shards_per_batch: int = 1) -> DataFrame:
    """Rows of Parquet shards under a folder, in batches of whole shards; only the schema's columns are read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", shards_per_batch).parquet(folder)


def capped_by_label(rows: DataFrame, cap: int, key: str = "sample_id", label: str = "label") -> DataFrame:
    """The first ``cap`` rows of each label in the order of arrival, within a batch by ``key``."""
    kind = f"{key} string, {label} int"

    def take(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        # of each part only what may still be taken is kept, so memory is bounded by the cap
        kept = pd.DataFrame({key: [], label: []})
        for part in parts:
            kept = pd.concat([kept, part[[key, label]]]).sort_values(key).head(max(cap - done, 0))
        state.update((done + len(kept),))
        yield kept.astype({label: "int32"})

    one = rows.where(F.col(label).isin(0, 1)).select(F.col(key).cast("string").alias(key), F.col(label).cast("int").alias(label))
    return one.groupBy(label).applyInPandasWithState(take, kind, "n long", "append", GroupStateTimeout.NoTimeout)


def _held(spark: SparkSession, output: str, kind: str) -> DataFrame:
    try:
        return spark.read.schema(kind).parquet(output)
    except AnalysisException:  # the first run: nothing is there yet
        return spark.createDataFrame([], kind)


def acquire(spark: SparkSession, folder: str, schema: str, output: str, checkpoint: str, cap: int, key: str = "sample_id", label: str = "label") -> DataFrame:
    """Reads the shards that are there and not yet done, appends to ``output``, and returns what it holds.

    Once both labels are full the run stops between shards: later ones are not read, by this run or any
    further one. What a stopped batch had not committed isn't in the result, and would be read again.
    """
    kind = f"{key} string, {label} int"
    full = lambda: dict(_held(spark, output, kind).groupBy(label).count().collect())
    done = full()
    if all(done.get(c, 0) >= cap for c in (0, 1)):
        return _held(spark, output, kind)
    rows = capped_by_label(shard_stream(spark, folder, schema), cap, key, label)
    run = rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    seen = -1
    while not run.awaitTermination(0.5):
        batch = (run.lastProgress or {}).get("batchId", -1)
        if batch > seen:  # a batch has been committed since
            seen, done = batch, full()
            if all(done.get(c, 0) >= cap for c in (0, 1)):
                run.stop()
                break
    return _held(spark, output, kind)

"""Structured Streaming forms of the incremental operators. Each works on any streaming frame; drain() also runs one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.session import scratch_path


def stage_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per stage and tumbling window; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed")).select(F.col("w.start").alias("start"), "stage", "n", "failed")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key that close after an idle gap."""
    return events.withWatermark("ts", late).groupBy("artifact_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("turns")).select("artifact_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def confidence(events: DataFrame, keep: float = 0.7, least: int = 2, threshold: float = 0.4, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """Moving average per key as state (average, count); the rows of a batch are taken in time order.

    Rows older than the watermark are dropped. A key without rows for `idle` after its last one, in event time, leaves the
    state once the watermark has passed; it begins anew if it comes back.
    """
    span = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, n, last = state.get if state.exists else (0.0, 0, 0)
        if n and last + span <= state.getCurrentWatermarkMs():
            # idle for too long, and back in the batch that would have ended it
            value, n, last = 0.0, 0, 0
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        # late rows come in the batch that moves the watermark past them
        rows = rows[rows["ts"].astype("datetime64[ms]").astype("int64") >= state.getCurrentWatermarkMs()]
        for row in rows.itertuples():
            value = row.score if n == 0 else keep * value + (1 - keep) * row.score
            n += 1
            last = max(last, int(row.ts.timestamp() * 1000))
        if n:
            state.update((value, n, last))
            state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"artifact_id": [key[0]], "n": [n], "confidence": [value], "needs_research": [n >= least and value < threshold]})

    stream = events.withWatermark("ts", late).groupBy("artifact_id")
    return stream.applyInPandasWithState(update, "artifact_id long, n long, confidence double, needs_research boolean", "value double, n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Outbox sink: each micro-batch appends the newest row of every key it holds, keyed by batch for idempotence."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, sf_dir: str, per_pass: int = 1) -> DataFrame:
    """Chunks of new document files, a bounded number of files a pass; the checkpoint keeps what is done."""
    from corpusloom.operators.chunking import fixed_window

    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    out, checkpoint = scratch_path(spark, "drained"), scratch_path(spark, "drain-checkpoint")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_pass).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir if sf_dir.endswith(".parquet") else f"{sf_dir}/documents.parquet")
    document_id = F.concat(F.lit("doc:"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32))
    chunks = fixed_window(files.select(document_id.alias("document_id"), "text")).select("document_id", "chunk_index", "chunk_id")
    query = chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(chunks.schema).parquet(out)

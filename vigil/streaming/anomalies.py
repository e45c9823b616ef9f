"""Dictionary checks on a stream (Structured Streaming).

The checks of ``operators.rules`` are row-local expressions, so the same compiled
rules run unchanged on a streaming DataFrame. Counting anomalies per event-time
window is a ``groupBy(window(ts), column, anomaly)`` with a watermark: state for a
window is dropped once the watermark passes it, late rows are discarded.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import add_typed_values, anomaly_array, compile_checks, load_rule_list
from ..session import ensure_checkpoint_dir


def detect_anomalies_stream(stream: DataFrame, rules, key: str, ts_col: str | None = None) -> DataFrame:
    """Anomaly rows (row_key, column_name, anomaly, actual_value, expected, action
    [, ts]) of a streaming (or batch) DataFrame. Rules whose column is absent raise,
    since a stream has no place for a one-off table-level row."""
    rule_list = load_rule_list(rules)
    stream = add_typed_values(stream, rule_list)
    checks, absent = compile_checks(stream, rule_list)
    if absent:
        raise ValueError(f"columns missing from the stream: {[r.column for r in absent]}")
    extra = [F.col(ts_col)] if ts_col else []
    return stream.select(F.col(key).cast("long").alias("row_key"), *extra, F.inline(anomaly_array(checks)))


def anomaly_counts_by_window(stream: DataFrame, rules, key: str, ts_col: str, window: str = "1 day",
                             watermark: str = "1 hour") -> DataFrame:
    """Anomalies per (event-time window, column, anomaly type)."""
    if stream.schema[ts_col].dataType.typeName() == "timestamp_ntz":
        # watermarks need a session-time-zone timestamp (sessions here run in UTC)
        stream = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    a = detect_anomalies_stream(stream.withWatermark(ts_col, watermark), rules, key, ts_col)
    return a.groupBy(F.window(ts_col, window).alias("w"), "column_name", "anomaly").agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "column_name", "anomaly",
        F.col("n").cast("long").alias("n"))


def run_to_table(spark: SparkSession, result: DataFrame, output_mode: str = "complete") -> DataFrame:
    """Run a streaming result over all data available now and return it as a batch DataFrame.
    Every micro-batch is written by the executors as Parquet under the shared
    ``spark.checkpoint.dir``; nothing passes through the driver. In complete mode the last batch is
    the result, otherwise all batches are."""
    root = os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    done: list[str] = []

    def write(batch: DataFrame, epoch: int) -> None:
        path = f"{root}/out/batch={epoch}"
        batch.write.mode("overwrite").parquet(path)
        if path not in done:
            done.append(path)

    q = (result.writeStream.outputMode(output_mode).foreachBatch(write)
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(*(done[-1:] if output_mode == "complete" else done))


def run_to_parquet(result: DataFrame, path: str, checkpoint: str | None = None, trigger_seconds: int | None = None):
    """Production sink: append-mode Parquet files, exactly-once through the checkpoint."""
    spark = result.sparkSession
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex[:12])
    w = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", ckpt)
    w = w.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else w.trigger(availableNow=True)
    return w.start()

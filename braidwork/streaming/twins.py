"""Structured Streaming forms of keyed state, screening, memory and the ledger.

Each takes a streaming DataFrame.  `settle` runs one to the end of what its
source holds and returns what it wrote, which is how tests hold a stream
against its batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from braidwork.operators.safety import verdict
from braidwork.session import shared_dir


def follow(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet table `name` of a folder as a stream."""
    kind = spark.read.parquet(f"{folder}/{name}.parquet").schema
    inner = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(path).isDirectory():
        return stream.parquet(inner)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def last_write(commands: DataFrame, key: str, value: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Each key's value with the greatest order so far, for update mode; the state is one row a key."""
    return commands.groupBy(key).agg(F.max(F.struct(*order, value)).alias("last")).select(key, f"last.{value}", *(f"last.{o}" for o in order))


def last_write_custom(commands: DataFrame, key: str, value: str) -> DataFrame:
    """The same with explicit keyed state, as a pattern for logic that no aggregate expresses.

    commands: key long, value double, ts timestamp, seq long.
    """
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for b in batches:
            for ts, seq, v in zip(b["ts"], b["seq"], b[value], strict=True):
                row = (int(ts.value // 1000), int(seq), float(v))
                if best is None or row[:2] > tuple(best)[:2]:
                    best = row
        state.update(tuple(best))
        yield pd.DataFrame({key: [k[0]], value: [best[2]], "ts_us": [best[0]], "seq": [best[1]]})

    return commands.groupBy(key).applyInPandasWithState(step, f"{key} long, {value} double, ts_us long, seq long", "ts_us long, seq long, v double", "update", GroupStateTimeout.NoTimeout)


def screen(messages: DataFrame, column: str = "text") -> DataFrame:
    """Messages with passed and reason; stateless."""
    return messages.withColumn("_v", verdict(F.col(column))).select("*", "_v.passed", "_v.reason").drop("_v")


def first_of_key(calls: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first call of each idempotency key within a delay of event time; older state is dropped."""
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def calls_per_window(spans: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "1 hour", by: str = "name") -> DataFrame:
    """Calls and errors by event-time window, final once the watermark has passed."""
    return spans.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("calls"), F.sum((F.col("status") == "ERROR").cast("long")).alias("errors")).select(F.col("window.start").alias("window_start"), by, "calls", "errors")


def settle(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the source, each batch written as Parquet; the rows written, with their batch_id."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/braidwork-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/b={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.createDataFrame([], stream.schema.add("batch_id", "long"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = spark.read.schema(rows.schema).parquet(f"{base}/rows/*")
    return rows


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of an update-mode stream, each key's from its last batch."""
    rest = [c for c in rows.columns if c not in (key, "batch_id")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(key, "r.*")

"""Knowledge-base files, utterances, span and trace sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """source, text: each file whole, by name; order by source to read them in order."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def utterances(spark: SparkSession, lines: list[str], conv_id: int = 0) -> DataFrame:
    """Typed lines as rows (conv_id, turn, text); follow_lines is the live form."""
    return spark.createDataFrame([(conv_id, i, t) for i, t in enumerate(lines)], "conv_id long, turn long, text string")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, timestamps in ISO form, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def show(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def option(spark: SparkSession, key: str, default: str | None = None) -> str:
    """A session setting; a missing one without default is an error at once."""
    got = spark.conf.get(key, default)
    if got is None:
        raise KeyError(f"{key} is not set")
    return got


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a Parquet table; a stored catalogue, vectors or messages grow by it.

    The columns must be those of the table, so that no file of another shape is put beside the others.
    """
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.parquet(path)
        if sorted(there.dtypes) != sorted(df.dtypes):
            raise ValueError(f"the table at {path} has other columns")
        df = df.select(*there.columns)
    df.write.mode("append").parquet(path)


def append_stream(stream: DataFrame, path: str, progress: str):
    """A stream's rows added to a Parquet table, each once; the running query."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", progress).format("parquet").start(path)


def follow_lines(spark: SparkSession, folder: str, conv_id: int = 0, files_per_batch: int = 1) -> DataFrame:
    """Lines of text files that appear in a folder, as a stream (conv_id, source, ingested_ts, text).

    A stream has no order of its own, so turns are numbered where it is settled,
    by source and ingested_ts, the wall time at which a line came in.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("_metadata.file_name").alias("source"), F.current_timestamp().alias("ingested_ts"), F.col("value").alias("text"))


def follow_socket(spark: SparkSession, host: str, port: int, conv_id: int = 0) -> DataFrame:
    """Lines that a socket sends, as a stream (conv_id, ingested_ts, text); for a console, as it keeps nothing it could read again."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.lit(conv_id).cast("long").alias("conv_id"), F.current_timestamp().alias("ingested_ts"), F.col("value").alias("text"))


def show_stream(stream: DataFrame, rows: int = 20, mode: str = "append"):
    """A stream to the console, batch by batch; the running query."""
    return stream.writeStream.outputMode(mode).format("console").option("numRows", rows).option("truncate", False).start()


def stamped(df: DataFrame, column: str = "ingested_ts") -> DataFrame:
    """df with the wall time at which it is read; one time for all rows of a query or batch."""
    return df.withColumn(column, F.current_timestamp())

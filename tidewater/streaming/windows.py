"""Streams: windowed counts, sessions, deduplication, change logs, and replays that end.

The watermark decides how late a row may come; it is an extension of the batch operators, which re-read a look-back
instead. Without late rows the results are those of the batch twins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.work import shared_dir


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, at: str, files_per_trigger: int = 16) -> DataFrame:
    """A table of the data folder as a stream of files; its time column becomes a timestamp."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, a single file is taken as well as a folder of files
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[t]")
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def tumbling_counts(rows: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    per = rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return per.select(key, F.col("w.start").alias("start"), "n")


def sliding_counts(rows: DataFrame, at: str, key: str, width: str, slide: str, late: str) -> DataFrame:
    per = rows.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return per.select(key, F.col("w.start").alias("start"), "n")


def session_counts(rows: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    per = rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return per.select(key, F.col("w.start").alias("start"), "n")


def deduplicated(rows: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark; the state of older keys is dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def static_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream rows with what a table knows of their key, as for a queue of updates."""
    return rows.join(table, key, "inner")


def change_log(target: str, log: str, at: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that appends new rows to a table and to its change log, one file set for each batch.

    A batch that is repeated after a failure overwrites its own folders, so both sinks hold every row once.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.select(F.lit("insert").alias("change"), F.lit(number).alias("number"), F.col(at).alias("changed_at")).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return step


def replay(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote: all batches, or the last one in complete mode."""
    spark = stream.sparkSession
    out, state = shared(spark, name), shared(spark, f"{name}-state")
    last: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    path = f"{out}/batch={max(last)}" if mode == "complete" else out
    return spark.read.parquet(path).select(*stream.columns)

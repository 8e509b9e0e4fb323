"""Bulk loads: dumps of XML rows into tables bucketed by key, with the rows that can't be read set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.work import written

CORRUPT = "_corrupt_record"


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a schema from the elements row_tag of XML files, and the text of those that don't fit it.

    Files are split between elements, so one large dump is read by many tasks.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(f"{schema}, {CORRUPT} string").load(path)
    rows = written(rows, "xml")  # parsed once for both
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))


def load_bucketed(rows: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """Writes rows as a table bucketed and sorted by key, so that joins on the key need no shuffle of it."""
    rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)

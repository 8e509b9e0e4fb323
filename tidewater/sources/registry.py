"""Named readers: a source is asked for by name and options, as a catalog would do it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.sources import feeds, logs, observations, tables

Reader = Callable[..., DataFrame]

READERS: dict[str, Reader] = {
    "table": tables.table,
    "feed_dump": feeds.read_feed_dump,
    "log_archive": logs.read_archive,
    "observations": observations.read_observations,
}


def register(name: str, reader: Reader) -> None:
    READERS[name] = reader


def read(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"no source {name!r}; there are {sorted(READERS)}")
    return READERS[name](spark, *args, **options)

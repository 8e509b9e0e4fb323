"""Shared pieces: work tables on the cluster's shared folder and numpy text kernels for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="tidewater-"))
    return "file://" + _FALLBACK[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def map_batches(df: DataFrame, task: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES at most, so that long rows don't fill a worker.

    Spark plans a query with the settings of the session at that moment, so the bound is set there and stays. A bound
    that the session already sets, other than Spark's own of 64 MB, is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEY_BITS, PAGE_BITS = 1 << 25, 1 << 15


def split_by_keys(df: DataFrame, keys: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose columns, named like those of keys, can be among keys, and the rows that surely are not.

    A bit is set for the hash of each key, in at most KEY_BITS bits, and these 4 MB are broadcast. Long rows that a join
    with keys has no use for are then not shuffled; the others are still to be joined. Keys may repeat but not be null.
    """
    at = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(KEY_BITS))
    place = keys.select(at([F.col(c) for c in columns]).alias("_at"))
    place = place.select(F.floor(F.col("_at") / PAGE_BITS).alias("_page"), (F.col("_at") % PAGE_BITS).alias("_bit")).repartition("_page")
    pages = materialize(place.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "key_bits")
    marked = df.withColumn("_at", at(columns.values())).withColumn("_page", F.floor(F.col("_at") / PAGE_BITS))
    marked = marked.join(F.broadcast(pages), "_page", "left")
    byte = F.substr("_bits", (F.col("_at") % PAGE_BITS / 8).cast("int") + 1, F.lit(1))
    held = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return marked.where(held).select(*df.columns), marked.where(~held).select(*df.columns)


def size_of_words(text):
    """Number of words [^\\x20\\x09-\\x0D]+ of a text column; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ---------------------------------------------------------------- numpy kernels

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
CHUNK_BYTES = 256 << 10


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        out = np.ones(max(n, CHUNK_BYTES + 1), np.uint64)
        filled = 1
        while filled < len(out):
            step = min(filled, len(out) - filled)
            top = out[filled - 1] * base
            out[filled : filled + step] = out[:step] * top
            filled += step
        _POWERS[key] = have = out
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (public domain), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, from one running polynomial sum."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(values)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _powers(_B_INV, len(values) + 1)[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, UTF-8 bytes, row offsets) of runs of whole texts, about limit bytes each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of a chunk; words never cross texts."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev = np.zeros(len(data), bool)
    prev[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~prev | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1

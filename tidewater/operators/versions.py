"""An upsert sink on plain files: versions that readers see whole or not at all, and repeats that change nothing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.upsert import upsert


class VersionedTable:
    """A table of keyed rows in hash partitions under path. A commit is one small file that names the files of each partition.

    Only partitions that a batch touches are written anew. A batch has a name; committing it again changes nothing, so a
    step that is repeated after a failure is safe. Commits are made one at a time: of two writers of one version, the
    second fails. Files of batches that never committed are not read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], partitions: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.partitions = spark, path.rstrip("/"), schema, list(keys), partitions
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _commits(self) -> list[int]:
        if not self._files.exists(self._place("commits")):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(self._place("commits")) if f.getPath().getName().isdigit())

    def _read(self, version: int) -> tuple[dict[int, str], set[str]]:
        """The folder of each partition and the batches up to a version: a few lines, however many rows there are."""
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._files.open(self._place(f"commits/{version:012d}")), "UTF-8").splitlines()
        split = [x.split("\t") for x in lines]
        return {int(a): b for kind, a, b in split if kind == "part"}, {a for kind, a, _ in split if kind == "batch"}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named; no rows before the first commit."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        parts, _ = self._read(commits[-1] if version is None else version)
        folders = [f"{self.path}/{folder}" for folder in parts.values()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, batch: str, order: Sequence[Column] = ()) -> int:
        """Upserts rows by key and returns the version that holds them; of repeated keys the first by order stays."""
        commits = self._commits()
        last = commits[-1] if commits else 0
        parts, batches = self._read(last) if commits else ({}, set())
        if batch in batches:
            return last
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int")
        stage = f"data/{uuid.uuid4().hex}"
        new = rows.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema])
        # written first: what is touched is known from it, and it is read twice
        new.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{stage}-new")
        new = self.spark.read.schema(f"{self.schema}, part int").parquet(f"{self.path}/{stage}-new")
        touched = sorted(r.part for r in new.select("part").distinct().collect())  # no more than there are partitions
        old = [f"{self.path}/{parts[p]}" for p in touched if p in parts]
        before = self.spark.read.schema(self.schema).parquet(*old) if old else self.spark.createDataFrame([], self.schema)
        merged = upsert(before, new.drop("part"), self.keys, order)
        merged.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{stage}")
        parts |= {p: f"{stage}/part={p}" for p in touched}
        lines = [f"part\t{p}\t{folder}" for p, folder in sorted(parts.items())] + [f"batch\t{b}\t" for b in sorted(batches | {batch})]
        hidden, place = self._place(f"commits/.{uuid.uuid4().hex}"), self._place(f"commits/{last + 1:012d}")
        out = self._files.create(hidden, False)
        out.write(bytearray("\n".join(lines), "utf-8"))
        out.close()
        if self._files.exists(place) or not self._files.rename(hidden, place):
            raise RuntimeError(f"version {last + 1} was committed by another writer")
        return last + 1

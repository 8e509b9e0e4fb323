"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging.

Queries are dealt into groups and candidates into shards of bounded size. Each (group, shard) pair is one tile: one
matrix product in numpy, of which only the k best of every query leave the task. The lists of a query are then merged by
a tree of ranked windows, FAN shards at a time, so no task ever holds more than FAN * k rows of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialize, read_table

K = 20
GROUP_ROWS = 4096  # queries in one tile
SHARD_ROWS = 8192  # candidates in one tile
BLOCK_ROWS = 512  # queries multiplied at a time, which bounds the scores in memory
FAN = 16
EXACT = float(1 << 53)


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v): rows with an id whose vector is neither null nor holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(ident).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _matrix(column: pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of a list column as rows of width components; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def tile_best(queries: pa.Table, shard: pa.Table, k: int, scale: float) -> pa.Table:
    """(query_id, vec_id, score, shard): the k best candidates of the shard for every query of the group."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "shard": pa.array([], pa.int32())})
    if not queries.num_rows or not shard.num_rows:
        return empty
    longest = lambda t: max(1, int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()))
    width = max(longest(queries), longest(shard))
    a, b = _matrix(queries.column("v"), scale, width), _matrix(shard.column("v"), scale, width)
    if np.abs(a).max() * np.abs(b).max() * width >= EXACT:  # too large for doubles: exact whole numbers
        a, b = a.astype(np.int64), b.astype(np.int64)
    b_ids = shard.column("id").to_numpy()
    order = np.argsort(b_ids, kind="stable")
    b, b_ids = b[order], b_ids[order]
    a_ids = queries.column("id").to_numpy()
    out = []
    for i in range(0, len(a), BLOCK_ROWS):
        own = a_ids[i : i + BLOCK_ROWS]
        scores = (a[i : i + BLOCK_ROWS] @ b.T).astype(np.int64)
        self_match = own[:, None] == b_ids[None, :]
        scores[self_match] = np.iinfo(np.int64).min
        if k < len(b):  # keep all that reach the k-th score, so that ties are decided by id below
            kth = np.partition(scores, len(b) - k, axis=1)[:, len(b) - k]
            rows, cols = np.nonzero((scores >= kth[:, None]) & ~self_match)
        else:
            rows, cols = np.nonzero(~self_match)
        s = scores[rows, cols]
        best = np.lexsort((cols, -s, rows))
        rows, cols, s = rows[best], cols[best], s[best]
        first = np.searchsorted(rows, np.arange(len(own)))
        keep = np.arange(len(rows)) - first[rows] < k
        out.append((own[rows[keep]], b_ids[cols[keep]], s[keep]))
    ids, vecs, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": ids, "vec_id": vecs, "score": s, "shard": pa.array(np.full(len(ids), shard.column("shard")[0].as_py()), pa.int32())})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries(id, v) against vectors(id, v), by inner product of floor(scale * x).

    A query's own id is no candidate; ties go to the smaller id; with fewer than k candidates all are returned. Defined
    cases: see usable() for vectors that take no part; vectors of different lengths are compared as if the shorter ended
    in zeros; rows that repeat an id and a vector count once as query and once as candidate, while another vector under
    the same id is a candidate of its own; no vectors or no queries give no rows. Products beyond 2**53 are summed as
    64-bit integers.
    """
    vectors, queries = materialize(vectors.distinct(), "candidates"), materialize(queries.distinct(), "queries")
    groups = max(1, -(-queries.count() // GROUP_ROWS))
    shards = max(1, -(-vectors.count() // SHARD_ROWS), min(64, 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    numbers = lambda n: F.explode(F.array(*map(F.lit, range(n))) if n < 100 else F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("shard", numbers(shards))
    right = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("group", numbers(groups))
    tiles = left.groupBy("group", "shard").cogroup(right.groupBy("group", "shard"))
    best = tiles.applyInArrow(lambda a, b: tile_best(a, b, k, scale), "query_id long, vec_id long, score long, shard int")
    while True:
        last = shards <= FAN
        by = ["query_id"] if last else ["query_id", F.expr(f"shard div {FAN}")]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        if last:
            return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best = best.withColumn("shard", F.expr(f"cast(shard div {FAN} as int)")).drop("rank")
        shards = -(-shards // FAN)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("id % 20 = 0"))


OP4_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Exact joins over vectors: tiles of matrix products, of which those that can't reach the bound are skipped, and hybrid scores.

Every vector is at home in the cell of its nearest pivot. A vector can only come near those of another cell if it lies
hardly farther from that cell's pivot than from its own, so it visits these cells alone. Homes and visitors of a cell
are dealt into parts of bounded size, and each pair of parts is one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.text import jaccard
from tidewater.operators.similarity import classes
from tidewater.operators.work import map_batches, written

TILE_ROWS = 4096
MOST_PIVOTS = 256
SLACK = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows of a list column; shorter vectors end in zeros, and those without length stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1)))


def _settle(pivots: np.ndarray, reach: float):
    """(cell, home, rep, v): each vector in its own cell and in the later cells that it visits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), pivots.shape[1])
            angle = np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))
            own = angle.argmin(axis=1)
            near = angle <= angle.min(axis=1, keepdims=True) + 2 * reach + 1e-7
            near &= np.arange(len(pivots)) > own[:, None]
            near[np.arange(len(x)), own] = True
            row, cell = np.nonzero(near)
            for at in range(0, len(row), 1 << 14):
                r, c = row[at : at + (1 << 14)], cell[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(c == own[r]), batch.column("rep").take(pa.array(r)), _lists(x[r])], ["cell", "home", "rep", "v"])

    return task


def _products(least: float, width: int):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("own").combine_chunks(), right.column("rep").combine_chunks()
        if not len(a) or not len(b):
            return pa.table({"a": a[:0], "b": a[:0], "cosine": pa.array([], pa.float64())})
        x, y = (np.array(t.column(c).combine_chunks().flatten()).reshape(-1, width) for t, c in ((left, "w"), (right, "v")))
        ids, others, home = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), right.column("home").to_numpy()
        rows, cols, found = [], [], []
        for at in range(0, len(x), 512):
            scores = x[at : at + 512] @ y.T
            r, c = np.nonzero((scores >= least) & (~home[None, :] | (ids[at : at + 512, None] < others[None, :])))
            rows.append(r + at)
            cols.append(c)
            found.append(scores[r, c])
        one, two = a.take(pa.array(np.concatenate(rows))), b.take(pa.array(np.concatenate(cols)))
        return pa.table({"a": one, "b": two, "cosine": pa.array(np.concatenate(found))})

    return tile


def cosine_links(vectors: DataFrame, least: float, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep), and all pairs (a, b, cosine), a < b, of different vectors(id, v) with a cosine of at least least.

    Vectors that are null take no part, those without length are like nothing; equal vectors are one, under their
    smallest id. The pivots are at most MOST_PIVOTS vectors of the smallest hashes; they decide how much is skipped, not
    what is found.
    """
    rows = vectors.where(F.col("v").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v"))
    members, kinds = classes(rows, "v")
    size = kinds.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    width = max(size.width, 1)
    number = max(1, min(MOST_PIVOTS, -(-size.n // tile_rows)))
    some = kinds.orderBy(F.xxhash64("v"), "rep").limit(number).collect()
    pivots = _matrix(pa.array([r.v for r in some], pa.list_(pa.float64())), width) if some else np.zeros((1, width))
    kind = kinds.schema["rep"].dataType.simpleString()
    settled = written(map_batches(kinds, _settle(pivots, math.acos(max(-1.0, min(1.0, least)))), f"cell int, home boolean, rep {kind}, v array<double>"), "settled")
    parts = settled.groupBy("cell").agg(F.ceil(F.count_if("home") / tile_rows).cast("int").alias("lefts"), F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("rights"))
    dealt = settled.join(F.broadcast(parts), "cell")  # one row for each pivot
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    left = dealt.where("home").select(F.col("cell").alias("c"), deal(F.col("lefts")).alias("i"), every(F.col("rights")).alias("j"), F.col("rep").alias("own"), F.col("v").alias("w"))
    right = dealt.select("cell", every(F.col("lefts")).alias("i"), deal(F.col("rights")).alias("j"), "rep", "home", "v")
    tiles = left.groupBy("c", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(_products(least, width), f"a {kind}, b {kind}, cosine double")
    return members, tiles.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def _best(k: int):
    def tile(queries: pa.Table, shard: pa.Table) -> pa.Table:
        """The k most similar rows of a shard for each query of a group, more where the last of them tie."""
        asked, ids = queries.column("query_id").combine_chunks(), shard.column("id").combine_chunks()
        if not len(asked) or not len(ids):
            return pa.table({"query_id": asked[:0], "vec_id": ids[:0], "similarity": pa.array([], pa.float64())})
        width = max(1, *(int(np.diff(t.column(c).combine_chunks().offsets.to_numpy()).max()) for t, c in ((queries, "qv"), (shard, "v"))))
        x, y = _matrix(queries.column("qv"), width), _matrix(shard.column("v"), width)
        mine, others = asked.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        rows, cols, found = [], [], []
        for at in range(0, len(x), 512):
            scores = x[at : at + 512] @ y.T
            scores[mine[at : at + 512, None] == others[None, :]] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -2.0)
            r, c = np.nonzero((scores >= least[:, None] - SLACK) & (scores > -np.inf))
            rows.append(r + at)
            cols.append(c)
            found.append(scores[r, c])
        return pa.table({"query_id": asked.take(pa.array(np.concatenate(rows))), "vec_id": ids.take(pa.array(np.concatenate(cols))), "similarity": pa.array(np.concatenate(found))})

    return tile


def nearest(queries: DataFrame, rows: DataFrame, k: int, same: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar rows(id, v) of each of queries(id, v) by cosine, within equal values of same.

    A query's own id is left out, ties go to the smaller id. Queries and rows are dealt into groups and shards of about
    tile_rows, each pair of which is one matrix product; only the best of a tile leave it. Null vectors take no part, a
    vector without length has cosine 0 with all; nulls in same are equal to nothing.
    """
    fine = lambda df: df.where(F.col("v").isNotNull()).withColumn("v", F.col("v").cast("array<double>"))
    queries, rows = fine(queries), fine(rows)
    groups, shards = (max(1, -(-df.count() // tile_rows)) for df in (queries, rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(*(F.col(c).alias(f"_{c}") for c in same), F.col("id").alias("query_id"), F.col("v").alias("qv"), deal("id", groups).alias("i"), every(shards).alias("j"))
    right = rows.select(*(F.col(c).alias(f"_{c}") for c in same), "id", "v", every(groups).alias("i"), deal("id", shards).alias("j"))
    by = [*(f"_{c}" for c in same), "i", "j"]
    for c in by[:-2]:
        left, right = left.where(F.col(c).isNotNull()), right.where(F.col(c).isNotNull())
    kinds = queries.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k), f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# fixed values: hours apart and what they count
PROXIMITY = ((1, 1.0), (6, 0.95), (24, 0.85), (72, 0.65), (168, 0.45), (336, 0.25), (720, 0.10))
SEMANTIC, ENTITIES, TIME = 0.85, 0.10, 0.05


def proximity(hours: Column) -> Column:
    out = F.when(hours <= PROXIMITY[0][0], PROXIMITY[0][1])
    for bound, value in PROXIMITY[1:]:
        out = out.when(hours <= bound, value)
    return out.otherwise(0.0)


def hybrid_pairs(rows: DataFrame, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b, similarity), a < b, of rows(id, v, entities, at) whose hybrid similarity reaches the threshold.

    It is .85 * (cosine + 1) / 2 + .10 * Jaccard of the entities + .05 * proximity in time, at is in seconds. As the last
    two give .15 at most, only pairs of some least cosine are scored. Rows of equal vectors are pairs of cosine 1, and
    rows without a vector have cosine 0 with all, which is below any threshold above .575.
    """
    if threshold <= SEMANTIC / 2 + ENTITIES + TIME:
        raise ValueError("so low a threshold would pair rows without a vector with all others")
    least = 2 * (threshold - ENTITIES - TIME) / SEMANTIC - 1 - SLACK
    members, links = cosine_links(rows.select("id", "v"), least, tile_rows)
    of = lambda x: members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(x))
    links = written(links, "links")
    apart = links.join(of("a"), "a").join(of("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "cosine")
    same = members.select(F.col("id").alias("a"), "rep").join(members.select(F.col("id").alias("b"), "rep"), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
    met = apart.unionByName(same)
    for x in ("a", "b"):
        met = met.join(rows.select(F.col("id").alias(x), F.coalesce("entities", F.array().cast("array<string>")).alias(f"entities_{x}"), F.col("at").alias(f"at_{x}")), x)
    hours = F.abs(F.col("at_a") - F.col("at_b")) / 3600.0
    score = SEMANTIC * (F.col("cosine") + 1) / 2 + ENTITIES * jaccard(F.col("entities_a"), F.col("entities_b")) + TIME * F.coalesce(proximity(hours), F.lit(0.0))
    return met.select("a", "b", F.least(F.lit(1.0), score).alias("similarity")).where(F.col("similarity") >= threshold)


# ---------------------------------------------------------------- hybrid links, summed up by row

LINK_ROWS, STRIP_ROWS = 16384, 256  # rows of a group that a tile holds, and of them that are scored at once


def entity_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and entities of a column of lists, each entity of a row once, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    held = pa.table({"row": np.repeat(np.arange(len(column)), np.diff(at)), "entity": column.flatten()}).group_by(["row", "entity"]).aggregate([])
    rows = held.column("row").to_numpy()
    return rows, held.column("entity").combine_chunks(), np.bincount(rows, minlength=len(column))


def by_entity(rows: np.ndarray, names: pa.Array, cols: np.ndarray, other_names: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows in order with the number of each of their entities, and for each number which of the others hold that entity."""
    codes = pa.chunked_array([names, other_names]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(rows, kind="stable")
    own, held = codes[: len(rows)][order], codes[len(rows) :]
    by = np.argsort(held, kind="stable")
    ends = np.searchsorted(held[by], np.arange(codes.max(initial=-1) + 2))
    return rows[order], own, [cols[by[a:b]] for a, b in zip(ends, ends[1:], strict=False)]


def common_counts(rows: np.ndarray, codes: np.ndarray, others: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
    """How many entities each of the rows from first to last shares with each of width others; codes stand by row, others by code."""
    out = np.zeros((last - first, width), np.int32)
    for at in range(*np.searchsorted(rows, [first, last])):
        out[rows[at] - first, others[codes[at]]] += 1
    return out


def _linked(threshold: float, least: float):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        """(a, b, links, total, most): for each row what it has in this tile, with no b, and edges (a, b) that join the same rows."""
        empty = {"a": left.column("id").combine_chunks()[:0], "b": left.column("id").combine_chunks()[:0], "links": pa.array([], pa.int64()), "total": pa.array([], pa.float64()), "most": pa.array([], pa.float64())}
        n, m = left.num_rows, right.num_rows
        if not n or not m:
            return pa.table(empty)
        width = max(1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (left, right)))
        x, y = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        rows, names, sizes = entity_places(left.column("entities"))
        cols, other_names, other_sizes = entity_places(right.column("entities"))
        rows, codes, others = by_entity(rows, names, cols, other_names)
        times, other_times = (t.column("at").to_pandas().to_numpy(np.float64) for t in (left, right))
        both = pa.chunked_array([left.column("id").combine_chunks(), right.column("id").combine_chunks()]).combine_chunks()
        ids = pc.rank(both, "ascending", tiebreaker="dense").to_numpy()  # ids of any type in order
        mine, theirs = ids[:n], ids[n:]
        same = bool(left.column("i")[0].as_py() == left.column("j")[0].as_py())
        links, total, most = np.zeros(n + m, np.int64), np.zeros(n + m), np.full(n + m, -np.inf)
        edges = set()
        root = np.arange(n + m)
        bounds, values = np.array([h * 3600.0 for h, _ in PROXIMITY]), np.array([*(p for _, p in PROXIMITY), 0.0])
        for at in range(0, n, STRIP_ROWS):
            strip = slice(at, min(at + STRIP_ROWS, n))
            scores = x[strip] @ y.T
            near = scores >= least
            if same:
                near &= mine[strip, None] < theirs[None, :]
            r, c = np.nonzero(near)
            common = common_counts(rows, codes, others, at, strip.stop, m)[r, c].astype(np.float64)
            union = sizes[r + at] + other_sizes[c] - common
            shared = np.divide(common, union, out=np.zeros(len(r)), where=union > 0)
            apart = np.abs(times[r + at] - other_times[c])
            close = np.where(np.isnan(apart), 0.0, values[np.searchsorted(bounds, apart)])
            score = np.minimum(1.0, SEMANTIC * (scores[r, c] + 1) / 2 + ENTITIES * shared + TIME * close)
            hit = score >= threshold
            r, c, score = r[hit] + at, c[hit] + n, score[hit]
            for ends_of in (r, c):
                links += np.bincount(ends_of, minlength=n + m)
                np.maximum.at(most, ends_of, score)
            total += np.bincount(r, weights=score, minlength=n + m)
            while (root[root] != root).any():
                root = root[root]
            new = root[r] != root[c]
            for a, b in zip(r[new].tolist(), c[new].tolist(), strict=True):
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.add((a, b))
        seen = np.flatnonzero(links)
        one, two = (np.array(sorted(edges), np.int64).reshape(-1, 2).T[k] for k in (0, 1))
        none = pa.nulls(len(seen), both.type)
        return pa.table({
            "a": pa.chunked_array([both.take(pa.array(seen)), both.take(pa.array(one))]).combine_chunks(), "b": pa.chunked_array([none, both.take(pa.array(two))]).combine_chunks(),
            "links": np.concatenate([links[seen], np.zeros(len(one), np.int64)]), "total": np.concatenate([total[seen], np.zeros(len(one))]), "most": np.concatenate([most[seen], np.full(len(one), -1.0)]),
        })

    return tile


def hybrid_degrees(rows: DataFrame, threshold: float, group_rows: int = LINK_ROWS) -> tuple[DataFrame, DataFrame]:
    """What hybrid_pairs would find, without its pairs: (id, links, total, most) of rows that have any, and edges (a, b).

    links counts the pairs of a row, most is its highest similarity, and total sums up similarities, each pair's in one of its rows. The
    edges are a spanning forest of each tile: they join the same rows as all pairs do. Every pair is scored, in tiles of two
    groups of about group_rows rows; a tile gives no more than a row and an edge for each of its rows. ids are unique.
    """
    if threshold <= SEMANTIC / 2 + ENTITIES + TIME:
        raise ValueError("so low a threshold would pair rows without a vector with all others")
    least = 2 * (threshold - ENTITIES - TIME) / SEMANTIC - 1 - SLACK
    fine = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).select("id", "v", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "at")
    groups = max(1, -(-fine.count() // group_rows))
    dealt = fine.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    left = dealt.withColumn("i", F.col("g")).withColumn("j", F.explode(F.sequence("g", F.lit(groups - 1)))).drop("g")
    right = dealt.withColumn("j", F.col("g")).withColumn("i", F.explode(F.sequence(F.lit(0), "g"))).drop("g")
    kind = rows.schema["id"].dataType.simpleString()
    tiles = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_linked(threshold, least), f"a {kind}, b {kind}, links long, total double, most double")
    tiles = written(tiles, "tiles")
    per = tiles.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"), F.sum("total").alias("total"), F.max("most").alias("most"))
    return per, tiles.where("b is not null").select("a", "b")
